"""Labelled rows for the classifiers: a bounded sample, one label per document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(by)), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, part) of about `most` labelled rows that aren't held out, one for each text.

    `most` bounds what is fitted, whatever the size of the corpus. Rows are picked by a hash of the
    id, so reruns agree; the picked ids are at most about `most` rows of 16 bytes, which bounds the
    broadcast. Null ids, null labels and null texts are left out. part is 0 to 9, by text.
    """
    pool = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, by) != held)).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    n = pool.count()
    share = min(1.0, most / max(n, 1))
    pool = pool.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    got = rows.join(F.broadcast(pool.withColumnRenamed(id_col, "_id")), "_id")
    return got.withColumn("_key", F.xxhash64("_text")).dropDuplicates(["_key"]).select("_id", "_text", "_label", F.pmod("_key", F.lit(10)).cast("int").alias("_part"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (last: constant) of a logistic fit by Newton steps; a few features, a bounded sample."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge * max(len(y), 1))
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
