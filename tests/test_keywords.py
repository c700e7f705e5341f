"""The trigram index: the rows of a scan, fewer files."""

import random
import time

import pytest

from quillspark.operators import keywords
from quillspark.operators.keywords import KeywordIndex, like, pieces

ROWS = [(i, f"Title {i}", f"common words and number{i:03d} of file" + (" Straße ÉCLAIR" if i == 7 else "") + (" 100%_sure" if i == 9 else "") + ("x" * 4095 + "needle" if i == 11 else "")) for i in range(40)]


def test_pieces():
    assert pieces(r"a%bc_d\%e") == ["a", "bc", "d%e"] and pieces("%%_") == [] and pieces("\\\\") == ["\\"]


@pytest.mark.parametrize(("kw", "most"), [("number007", 1), ("ER00_", 3), ("éclair", 1), ("straße", 1), ("of%fi", 10), ("co", 10), ("%", 10), (r"100\%\_su", 1), ("needle", 1), ("nothing at all", 0), ("number00%file", 3)])
def test_same_rows_fewer_files(spark, tmp_path, kw, most):
    docs = spark.createDataFrame(ROWS, "id long, title string, content string").repartitionByRange(10, "id")
    docs.write.parquet(f"{tmp_path}/docs")
    index = KeywordIndex(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/docs")
    want = sorted(r.id for r in docs.filter(like(kw, "title", "content")).collect())
    assert sorted(r.id for r in index.search(kw).collect()) == want  # before anything is indexed
    assert index.update() == 10 and index.update() == 0
    assert sorted(r.id for r in index.search(kw).collect()) == want
    assert len(index.files(kw)) <= most


def test_new_files_are_read_before_they_are_indexed(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "a", "alpha"), (2, None, None)], "id long, title string, content string").coalesce(1).write.parquet(path)
    index = KeywordIndex(spark, f"file://{tmp_path}/index", path)
    index.update()
    spark.createDataFrame([(3, "b", "omega")], "id long, title string, content string").coalesce(1).write.mode("append").parquet(path)
    assert [r.id for r in index.search("omega").collect()] == [3] and len(index.files("omega")) == 1
    assert index.update() == 1
    assert [r.id for r in index.search("alph").collect()] == [1] and len(index.files("alph")) == 1


def test_every_trigram_of_long_texts_in_linear_time(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ÉŞ\n𝔸😀0123") for _ in range(400_000))
    rows = [("a", long), ("a", "xy"), ("a", "Z"), ("a", ""), ("b", "ΑΣ" * 20), ("b", "İi")]
    want = {(f, low[i : i + 3]) for f, low in ((f, x.lower()) for f, x in rows) for i in range(len(low) - 2)}
    t = time.time()
    texts = spark.createDataFrame(rows, "file string, text string")
    got = keywords.grams(texts).collect()
    # lower-casing and counting from the start of the piece for each trigram took a minute for 100,000 characters
    assert len(got) == len(want) and {tuple(g) for g in got} == want and time.time() - t < 60
