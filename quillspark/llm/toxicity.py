"""Toxic passages as maximum-scoring segments, and a calibrated score for each document.

1. Terms (whole words and their first four and five bytes, lower-cased) are counted in labelled
   texts. Log-odds between toxic and clean text under a Dirichlet prior proportional to the pooled
   counts, kept where they pass a z-test, make a lexicon.
2. A word in the lexicon scores its log-odds, any other word a small loss; both are logarithms of a
   likelihood ratio, so segment scores follow the Karlin-Altschul law with lambda = 1.
3. One linear scan finds all maximal-scoring segments (Ruzzo and Tompa). A segment of score S in a
   text of n words has the expected count K n exp(-S) by chance; those at or under `expect` are
   reported as passages. K comes from clean calibration texts.
4. The best segment's and the passages' extreme-value statistics become a probability by a logistic
   fit on labelled texts that didn't build the lexicon.

Null and empty texts, and texts without a term, have no passage and get the lowest score. Very long
texts are scanned whole. Repeated rows are scored alike; the ids are only carried. Other columns of
the input, whatever their names, aren't touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import arrowtext as at
from quillspark.llm.labelled import logistic, sample
from quillspark.llm.store import by_text, table

#: Labelled rows that are fitted on at most, about.
MAX_TRAIN_ROWS = 30_000
#: Terms that a lexicon holds at most; the most significant stay. Bounds what tasks are sent.
MAX_TERMS = 50_000
_PREFIXES = (0, 4, 5)


@dataclass
class ToxicModel:
    terms: np.ndarray  # sorted hashes
    scores: np.ndarray
    loss: float
    k: float
    weights: np.ndarray
    expect: float = 0.01


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end, one array of hashes for each kind of term)."""
    row, start, end, h = at.words(data, offsets, at.NOT_TERM, lower=True)
    kinds = [h]
    if len(row):
        low = at.LOWER[data]
        for n in _PREFIXES[1:]:
            acc = np.full(len(start), n, np.uint64)
            for j in range(n):
                p = start + j
                acc = acc * np.uint64(0x100000001B3) + np.where(p < end, low[np.minimum(p, len(low) - 1)], 0).astype(np.uint64)
            kinds.append(at.mix(acc))
    else:
        kinds += [h, h]
    return row, start, end, kinds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, toxic, clean, pending = [], [], [], 0

    def summed():
        h = np.concatenate(hashes)
        u, inv = np.unique(h, return_inverse=True)
        return u, np.bincount(inv, np.concatenate(toxic)).astype(np.int64), np.bincount(inv, np.concatenate(clean)).astype(np.int64)

    for batch in batches:
        labels = np.asarray(batch.column("_label").to_numpy(zero_copy_only=False), np.int64)
        for lo, _, data, offsets in at.slices(batch.column("_text")):
            row, _, _, kinds = _terms(data, offsets)
            y = labels[lo + row]
            for h in kinds:
                hashes.append(h), toxic.append(y), clean.append(1 - y)
                pending += len(h)
            if pending > 2_000_000:
                u, a, b = summed()
                hashes, toxic, clean, pending = [u], [a], [b], 0
    if hashes:
        u, a, b = summed()
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000].view(np.int64)), pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["term", "toxic", "clean"])


def log_odds(counts: DataFrame, prior_share: float = 0.05, z: float = 3.0, most: int = MAX_TERMS) -> tuple[DataFrame, float, float]:
    """(term, odds, share_toxic, share_clean, z) of the terms that speak for toxic text, and both totals.

    The prior of a term is prior_share of its pooled count, so a term must be seen often, and mostly
    in toxic text, to pass.
    """
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = float(n1 or 0) / len(_PREFIXES), float(n0 or 0) / len(_PREFIXES)
    if not n1 or not n0:
        return counts.sparkSession.createDataFrame([], "term long, odds double, share_toxic double, share_clean double, z double"), n1, n0
    prior = prior_share * (F.col("toxic") + F.col("clean"))
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    a1, a0 = n1 + prior_share * (n1 + n0), n0 + prior_share * (n1 + n0)
    odds = F.log(y1 / (a1 - y1)) - F.log(y0 / (a0 - y0))
    scored = counts.select("term", odds.alias("odds"), (y1 / a1).alias("share_toxic"), (y0 / a0).alias("share_clean"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    return scored.filter((F.col("z") >= z) & (F.col("odds") > 1)).orderBy(F.desc("z"), "term").limit(most), n1, n0


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of a sequence, in time linear in its length.

    Each candidate keeps the place of its nearest earlier one of a lesser sum before it, so a search
    never passes the same candidates twice.
    """
    found: list[list] = []  # sum before it, sum with it, first, last, nearest earlier of a lesser sum before it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        item = [before, total, i, i]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= item[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= item[1]:
                found.append([*item, j])
                break
            item, earlier = [found[j][0], item[1], found[j][2], item[3]], found[j][4]
            del found[j:]
            j = earlier
    return [(r - l, a, b) for l, r, a, b, _ in found]


def _hits(m: ToxicModel, data: np.ndarray, offsets: np.ndarray):
    row, start, end, kinds = _terms(data, offsets)
    best = np.zeros(len(row))
    if len(m.terms):
        for h in kinds:
            p = np.minimum(np.searchsorted(m.terms, h), len(m.terms) - 1)
            best = np.maximum(best, np.where(m.terms[p] == h, m.scores[p], 0))
    return row, start, end, best


def _scan(m: ToxicModel, data: np.ndarray, offsets: np.ndarray):
    """For each row: words, [(score, first byte, byte after the last)]."""
    rows = len(offsets) - 1
    row, start, end, best = _hits(m, data, offsets)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    out: list[list] = [[] for _ in range(rows)]
    at_hit = np.flatnonzero(best > 0)
    for r in np.unique(row[at_hit]):
        hit = at_hit[np.searchsorted(at_hit, first[r]) : np.searchsorted(at_hit, first[r + 1])]
        seq = []
        for k, p in enumerate(hit):
            if k:
                seq.append(-m.loss * float(p - hit[k - 1] - 1))
            seq.append(float(best[p]))
        out[r] = [(s, int(start[hit[a // 2]]), int(end[hit[b // 2]])) for s, a, b in segments(seq)]
    return count, out


def _stats(m: ToxicModel, n: int, segs: list) -> tuple[float, float]:
    """Extreme-value statistics: of the best segment, and of all passages together."""
    if not segs:
        return 0.0, 0.0
    base = math.log(max(m.k, 1e-12) * max(n, 1))
    over = [s - base for s, _, _ in segs]
    return max(0.0, max(over)), math.log1p(sum(x for x in over if x >= -math.log(m.expect)))


def fit(docs: DataFrame, labels: DataFrame, by: int = 4, held: int = 2, max_rows: int = MAX_TRAIN_ROWS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on labelled rows whose crc32(id) modulo `by` isn't `held`, on about max_rows at most.

    Without labels of both kinds there is no lexicon, and every text gets the same low score.
    """
    rows = table(sample(docs, labels, label, by, held, max_rows, id_col, text_col), "toxic-sample")
    counts = by_text(rows.filter("_part < 7").select("_text", "_label")).mapInArrow(_count, "term long, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the more texts, the more terms are tried, and the stricter the test
    tried = rows.filter("_part < 7").count()
    lexicon, _, _ = log_odds(table(counts, "toxic-terms"), z=max(3.0, 0.5 * math.log(max(tried, 1)) + 0.3))
    got = lexicon.toArrow().to_pandas()
    terms = got["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(terms)
    p1, p0 = got["share_toxic"].sum() / 3, got["share_clean"].sum() / 3
    loss = max(1e-3, math.log1p(-min(p0, 0.5)) - math.log1p(-min(p1, 0.9))) if len(got) else 0.01
    m = ToxicModel(terms[order], got["odds"].to_numpy(float)[order], loss, 1.0, np.array([0.0, 0.0, -3.0]))

    def calibration(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_label").to_pylist()
            for lo, _, data, offsets in at.slices(batch.column("_text")):
                count, out = _scan(m, data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([y[lo + i] for i in range(len(out))], pa.int32()), pa.array(count.astype(np.int64)), pa.array([[s for s, _, _ in x] for x in out], pa.list_(pa.float64()))], names=["y", "n", "s"])

    part = by_text(rows.filter("_part >= 7").select("_text", "_label")).mapInArrow(calibration, "y int, n long, s array<double>").toArrow().to_pandas()
    if part.empty or part["y"].nunique() < 2:
        return m
    clean = part[part["y"] == 0]
    chance = sum(len(s) for s in clean["s"])
    low = math.exp(min([float(min(s)) for s in clean["s"] if len(s)], default=float(m.scores.min()) if len(m.scores) else 0.0))
    m.k = (chance + 0.5) * low / max(float(clean["n"].sum()), 1.0)
    x = np.array([_stats(m, n, [(v, 0, 0) for v in s]) for n, s in zip(part["n"], part["s"], strict=True)])
    m.weights = logistic(x, part["y"].to_numpy(float))
    return m


def passages(docs: DataFrame, m: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): score 0 to 1; passages hold code points start and end, segment score, expected count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("segment_score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in at.slices(batch.column(1)):
                count, out = _scan(m, data, offsets)
                x = np.array([_stats(m, int(n), s) for n, s in zip(count, out, strict=True)]).reshape(-1, 2)
                z = np.clip(x @ m.weights[:2] + m.weights[2], -30, 30)
                spans = []
                for i, segs in enumerate(out):
                    base = offsets[i]
                    own = []
                    for s, a, b in segs:
                        e = m.k * int(count[i]) * math.exp(-s)
                        if e <= m.expect:
                            points = np.cumsum((data[base:b] & 0xC0) != 0x80)  # bytes that begin a code point
                            begin = int(points[a - base]) - 1
                            own.append({"start": begin, "end": int(points[-1]), "segment_score": s, "expected": e})
                    spans.append(own)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-z))), pa.array(spans, kind)], names=[id_col, "score", "passages"])

    field = docs.schema[id_col]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("segment_score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([T.StructField(id_col, field.dataType), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(span))])
    return by_text(docs.select(id_col, text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, m: ToxicModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is `threshold` or more; no shuffle, all columns as they were."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, data, offsets in at.slices(batch.column(place)):
                count, out = _scan(m, data, offsets)
                x = np.array([_stats(m, int(n), s) for n, s in zip(count, out, strict=True)]).reshape(-1, 2)
                z = np.clip(x @ m.weights[:2] + m.weights[2], -30, 30)
                keep += (1 / (1 + np.exp(-z)) < threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return by_text(docs).mapInArrow(run, docs.schema)
