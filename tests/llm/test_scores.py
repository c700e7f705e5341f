"""Toxicity and quality."""

import random

from pyspark.sql import functions as F

from quillspark.llm import quality, toxicity
from tests.llm.cases import labels, no_docs, odd_docs, text


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best segment, then both sides."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None or best[0] <= 0:
        return []
    _, i, j = best
    left = brute_segments(scores[:i])
    right = [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(scores[j + 1 :])]
    return [*left, best, *right]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [round(rng.uniform(-3, 3), 3) for _ in range(rng.randint(0, 12))]
        got, want = toxicity.segments(s), brute_segments(s)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want], s
        assert all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["vilest", "rotten", "scoundrel"]
    rows, marks = [], []
    for i in range(600):
        words = text(i + 10, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    m = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.passages(docs, m).collect()}
    assert sum((got[i].score >= 0.3) == bool(t) for i, _, t in marks) >= 590
    p = got[0].passages[0]
    assert rows[0][1][p.start : p.end].split()[0].strip(".") in bad
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(7)), m)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].score < 0.3)
    odd = toxicity.passages(odd_docs(spark), m).collect()
    assert len(odd) == 8
    assert len({r.score for r in odd if r.doc_id in (1, 2, 6)}) == 1
    assert toxicity.passages(no_docs(spark), m).count() == 0
    assert toxicity.passages(docs, toxicity.fit(docs, lab.limit(0))).select("score").distinct().count() == 1


def test_quality(spark):
    rows = [(i, text(i, 120) if i % 3 else text(i, 120, "!! ").upper()) for i in range(400)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(i, int(i % 3 > 0), 0) for i in range(400)])
    m = quality.fit(docs, lab)
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    assert sum((s >= 0.5) == (i % 3 > 0) for i, s in got.items()) >= 390
    odd = quality.score(odd_docs(spark), m).collect()
    assert len(odd) == 8
    assert all(0 <= r.score <= 1 for r in odd)
    assert quality.score(no_docs(spark), m).count() == 0
    assert quality.fit(docs, lab.limit(0)).weights[-1] == 0.0
