"""Benchmark items of any length, copied and varied."""

import random

import numpy as np

from quillspark.llm import decontaminate
from tests.llm.cases import text


def kept(words, share, seed):
    r = random.Random(seed)
    return [w if r.random() < share else f"other{r.randrange(10**6)}" for w in words]


def test_items_of_any_length(spark):
    items = {i: [f"{w.strip('.')}{i}x{k % 7}" for k, w in enumerate(text(500 + i, n).split())] for i, n in enumerate((10, 20, 64, 150, 300, 1_000))}
    far = " ".join(f"pad{k % 50}" for k in range(90))
    rows, want = [], {}
    for i, w in items.items():
        for k, shift in enumerate((0, 7, 333)):  # copied in full
            rows.append((100 * i + k, f"{text(900 + i + k, shift)} {' '.join(w)} answer{i} {far} {text(950 + i + k, 200)}"))
            want[rows[-1][0]] = i
        if len(w) >= 64:  # four words of five in their places
            rows.append((100 * i + 10, f"{text(980 + i, 41)} {' '.join(kept(w, 0.8, i))} answer{i} {far}"))
            want[rows[-1][0]] = i
        rows.append((100 * i + 20, f"{text(990 + i, 60)} {' '.join(w[: len(w) // 2])} {far}"))  # half of one
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w), f"answer{i}") for i, w in items.items()], "item_id long, text string, answer string")
    for answer in (None, "answer"):
        got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(d, b, answer_col=answer).collect()}
        assert {k: v for k, v in got.items() if v} == {k: [i] for k, i in want.items()}
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {r[0] for r in rows} - set(want)
    wrong = b.selectExpr("item_id", "text", "'nowhere' AS answer")
    assert not any(r.contaminated for r in decontaminate.contaminated(d, wrong, answer_col="answer").collect())


def test_short_copies_in_other_words_of_the_benchmark(spark):
    """Copies of 8 to 20 words are candidates, whatever lies around them."""
    pool = [f"term{k}" for k in range(400)]
    r = random.Random(3)
    items = [(i, " ".join(r.choice(pool) for _ in range(8 + i % 13))) for i in range(200)]
    rows = [(i, f"{' '.join(r.choice(pool) for _ in range(25 + i % 9))} {t} {' '.join(r.choice(pool) for _ in range(40))}") for i, t in items]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), cosine=0.5)
    assert all(x.doc_id in x.item_ids for x in got.collect())


def test_singular_vectors():
    """Of a matrix of falling singular values, against the plain decomposition."""
    rng = np.random.default_rng(2)
    a = np.linalg.qr(rng.standard_normal((300, 40)))[0] * (2.0 ** -np.arange(40)) @ np.linalg.qr(rng.standard_normal((120, 40)))[0].T
    omega = rng.standard_normal((120, 24))
    u, s = decontaminate.singular_vectors(a.T @ (a @ omega), omega)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s[:8], want[:8], rtol=2e-2)  # of a sketch of 24 columns
    assert np.allclose(np.abs((vt[:8] * u[:, :8].T).sum(axis=1)), 1, atol=1e-3)


def test_paraphrases_whatever_the_blocks(spark, monkeypatch):
    """The same rows for blocks of 3 items and of all, among them paraphrases that only the latent space finds; recall at the limit."""
    pool = [w.strip(".") + str(k % 60) for k, w in enumerate(text(77, 1500).split())]
    r = random.Random(8)
    items = [(i, " ".join(r.choice(pool) + (str(i) if r.random() < 0.7 else "") for _ in range(24 + i % 30))) for i in range(60)]
    rows = [(i, f"{text(1000 + i, 120)} {' '.join(kept(t.split(), 0.78, i))} {text(2000 + i, 90)}") for i, t in items]
    rows += [(1000 + i, text(3000 + i, 200)) for i in range(100)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for block in (3, 50_000):
        monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", block)
        found.append(sorted((x.doc_id, tuple(x.item_ids), round(x.best_overlap, 9)) for x in decontaminate.contaminated(d, b).collect()))
    assert found[0] == found[1]
    got = {x[0]: x[1] for x in found[0]}
    share = {i: decontaminate.common_subsequence(*(np.array([hash(w) for w in x.split()], np.int64) for x in (t, rows[i][1]))) / len(t.split()) for i, t in items}
    due = [i for i in share if share[i] >= decontaminate.OVERLAP]
    assert len(due) > 40 and sum(i in got[i] for i in due) >= 0.9 * len(due)
    assert not any(got[1000 + i] for i in range(100))
