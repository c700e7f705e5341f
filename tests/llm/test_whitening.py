"""Whitening: the spectrum against the library's, whole results against a plain version, odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening
from quillspark.llm.queries import op12_qdwh_whitening


@pytest.mark.parametrize("kind", ["random", "equal", "diagonal", "low rank", "zero", "wide"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_spectrum(kind, n):
    r = np.random.default_rng(n)
    q, _ = np.linalg.qr(r.normal(size=(n, n)))
    b = r.normal(size=(n, max(1, n // 2)))
    a = {"random": r.normal(size=(n, n)), "equal": q @ np.diag(r.integers(0, 3, n) * 1.0) @ q.T, "diagonal": np.diag(r.random(n)), "low rank": b @ b.T, "zero": np.zeros((n, n)), "wide": q @ np.diag(10.0 ** r.uniform(-8, 4, n)) @ q.T}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.spectrum(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() / scale < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() / scale < 1e-12


def test_polar_factor_is_the_sign():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(20, 20)))
    signs = np.where(r.random(20) < 0.4, -1.0, 1.0)
    a = q @ np.diag(signs * 10.0 ** r.uniform(-9, 3, 20)) @ q.T
    assert np.abs(whitening.polar((a + a.T) / 2) - q @ np.diag(signs) @ q.T).max() < 1e-6


def plain(rows):
    """{id: (deviation, whitened up to signs)}, n, explained, by whole numbers and fractions."""
    x = {k: [math.floor(256 * float(c)) for c in v] for k, v in rows}
    distinct = sorted({tuple(v) for v in x.values()})
    n, dim = len(distinct), len(distinct[0])
    sums = [sum(v[d] for v in distinct) for d in range(dim)]
    apart = [[Fraction(n * c - s, n) for c, s in zip(v, sums, strict=True)] for v in distinct]
    v = np.array([[float(sum(a[i] * a[j] for a in apart) / n) for j in range(dim)] for i in range(dim)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    white = {k: np.array([float(Fraction(n * c - s, n)) for c, s in zip(y, sums, strict=True)]) @ q[:, :4] / np.sqrt(e[:4]) for k, y in x.items()}
    return {k: (sum((n * c - s) ** 2 for c, s in zip(y, sums, strict=True)), white[k]) for k, y in x.items()}, n, e[:4] / np.trace(v)


def compare(got, rows, dim=4):
    want, n, explained = plain(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert set(by) == {(k, c) for k in want for c in range(1, min(dim, 4) + 1)}
    for c in range(1, min(dim, 4) + 1):
        y = np.array([by[k, c][0].whitened for k in want])
        z = np.array([want[k][1][c - 1] for k in want])
        assert min(np.abs(y - z).max(), np.abs(y + z).max()) < 1e-8
    for (k, c), many in by.items():
        for r in many:
            assert r.deviation == want[k][0] and r.n == n
            assert abs(r.explained - explained[c - 1]) < 1e-6 * explained[c - 1] and r.identity_error < 1e-8


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op12_qdwh_whitening(spark, sf).collect(), rows)


def test_odd_rows(spark):
    r = np.random.default_rng(9)
    good = [(i, [float(c) for c in r.normal(size=5) * [3, 2, 1, 1e-3, 5]]) for i in range(30)]
    good += [(100 + i, list(good[0][1])) for i in range(20)] + [(None, list(good[1][1])), (7, list(good[7][1]))]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in good + odd], "vec_id long, embedding array<double>, n int, whitened double").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(good)
    compare([x for x in got if x.vec_id is not None], [x for x in good if x[0] is not None])
    assert {x.vec_id for x in got} == {x[0] for x in good}
    empty = whitening.whiten(df.limit(0))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    assert whitening.whiten(df.filter("vec_id >= 200")).count() == 2  # the one that is left has two dimensions
    with pytest.raises(ValueError, match="of its own"):
        whitening.whiten(df, id_col="n")


def test_few_dimensions_and_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained) for x in sorted(one, key=lambda x: (x.vec_id, x.component))] == [(v, c, 1, 0, None, 0.0) for v in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0, 3.0]), (2, [1.0, 1.0, 3.0]), (3, [4.0, 1.0, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert all((x.whitened is None) == (x.component > 1) for x in flat) and all(x.identity_error < 1e-9 for x in flat)


def test_large_entries_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in 1e9 + r.normal(size=3) * 1e4]) for i in range(50)]
    compare(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 3)
    huge = whitening.whiten(spark.createDataFrame([(i, [1e15 * (i + 1), 1.0 * i * i]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all(x.deviation is None and x.whitened is not None for x in huge)
