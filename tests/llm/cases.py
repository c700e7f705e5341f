"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SYL = ["an", "be", "co", "du", "el", "fi", "go", "hu"]


def text(seed: int, n: int, end: str = " ") -> str:
    r = random.Random(seed)
    return end.join("".join(r.choice(SYL) for _ in range(r.randint(1, 4))) + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd_docs(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one", None, None), (None, "null id text here", "en", "a"), (4, text(1, 400), "en", "b"), (4, text(1, 400), "en", "b"), (5, text(2, 30_000), "en", "b"), (6, " \n\t ", "en", "c")]
    rows = [(*r, 1.0, 1, True, None, "x") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n_words int, kept boolean, n_chars long, size string")


def no_docs(spark):
    return odd_docs(spark).limit(0)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
