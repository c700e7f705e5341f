import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import brown
from quillspark.llm.labelled import remainder
from tests.llm.cases import no_docs, odd_docs, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*(t or "").translate(LOWER).encode().split(), None]


def held_against_plain(rows, got):
    c = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    for (_, t), r in zip(rows, got, strict=True):
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))


def test_base_and_gain(spark, monkeypatch):
    rows = [(i, text(i % 180, 60).capitalize() + f" rare{i} Rare{i}") for i in range(200)]  # some texts twice
    d = spark.createDataFrame(rows, "doc_id long, text string")
    v = brown.vocabulary(d, head=300, entries=100)
    train = remainder("doc_id", 5) != 1
    counted = brown.table(brown.count(d, v, train), "t")
    m, sums = brown.fit(counted, v)
    got = sorted(brown.score(d, m, sums).collect(), key=lambda r: r.doc_id)
    held_against_plain(rows, got)
    # a proper model: transitions, emissions and the words of each group sum to 1
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    assert np.allclose(np.bincount(m.cls, 10**m.emission), 1)


def test_odd(spark):
    odd = odd_docs(spark).filter("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = brown.score_all(odd, remainder("doc_id", 5) != 1).collect()
    by = {r.doc_id: r for r in got}
    held_against_plain(rows, [by[i] for i, _ in rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert brown.score_all(no_docs(spark), F.lit(True)).count() == 0
    none = brown.score_all(odd, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0}


def test_exchange_finds_classes():
    """Two kinds of words that alternate are told apart."""
    n, rng = 21, np.random.default_rng(3)
    pairs = np.zeros((n, n), np.int64)
    for _ in range(6000):
        a, b = rng.integers(0, 10), rng.integers(10, 20)
        pairs[a, b] += 1
        pairs[b, rng.integers(0, 10)] += 1
    pairs[20, 0] = pairs[10, 20] = 5
    cls = brown.exchange(pairs, classes=3)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10] and cls[20] == 0


def test_entries_by_counts_of_all_documents(spark):
    """Beyond 4,000 documents too, and where a text copied over and over holds words of its own."""
    copies = " ".join(f"copied{k}" for k in range(10))
    rows = [(i, copies if i % 3 == 0 else " ".join(f"word{k}" for k in range(150) if i % (k + 2) == 0) + f" rare{i}") for i in range(9_000)]
    count = collections.Counter(w for _, t in rows for w in t.split())
    assert count["copied0"] == 3_000
    v = brown.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), head=300, entries=100)
    cut = count.most_common(100)[-1][1]
    name = {int(brown.at.hash_words([w])[0]): w for w in count}
    own = {name[int(h)] for h in v.head[v.entry >= 0]}
    assert len(own) == 100 and min(count[w] for w in own) == cut
    assert {w for w, n in count.items() if n > cut} <= own


def test_entries_grow(spark, monkeypatch):
    monkeypatch.setattr(brown, "ENTRIES", 10)
    monkeypatch.setattr(brown, "GATHERED", 500)
    rows = [(i, " ".join(f"w{(i * 20 + k) % 10_000}" for k in range(40))) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert brown.vocabulary(d).entries == 100
    held_against_plain(rows, sorted(brown.score_all(d, remainder("doc_id", 5) != 1).collect(), key=lambda r: r.doc_id))


def two_kinds():
    """Texts in which words of two kinds, of the same endings, take turns; most of them seldom."""
    rng = np.random.default_rng(5)
    name = lambda kind, i: f"{kind}{i}zz"
    pick = lambda: int(rng.integers(0, 8)) if rng.random() < 0.6 else int(rng.integers(8, 300))
    return [(i, " ".join(name("ab"[k % 2], pick()) for k in range(40))) for i in range(400)]


def modelled(d, head):
    train = remainder("doc_id", 5) != 1
    v = brown.learn(d.filter(train), brown.vocabulary(d, head=head, entries=16))
    counted = brown.table(brown.count(d, v, train), "t")
    m, sums = brown.fit(counted, v)
    return v, m, {r.doc_id: r for r in brown.score(d, m, sums).collect()}


def test_every_word_finds_its_class(spark):
    """Words that aren't entries are grouped by their own neighbours (by their last two bytes only, before), whether tasks hold them or not."""
    rows = two_kinds()
    d = spark.createDataFrame([*rows, (1_000, rows[3][1]), (1_001, "a1zz never b9zz seen a9zz")], "doc_id long, text string")
    v, m, got = modelled(d, 5_000)
    words = sorted({w for _, t in rows for w in t.split()})
    place = dict(zip(words, v.look_up(brown.at.hash_words(words)), strict=True))
    free = [w for w in words if v.entry[place[w]] < 0]
    kinds = [{int(v.group[place[w]]) for w in free if w[0] == k} for k in "ab"]
    assert len(free) > 500 and not kinds[0] & kinds[1]
    assert v.size == v.entries + brown.GROUPS + 1

    def plain(t):
        out, before = 0.0, v.end
        for w in [*t.split(), None]:
            k = -1 if w is None else int(v.look_up(brown.at.hash_words([w]))[0])
            e = v.end if w is None else int(v.entry[k]) if v.entry[k] >= 0 else v.entries + int(v.group[k])
            out += m.transition[m.cls[before], m.cls[e]] + m.emission[e]
            if v.entries <= e < v.end:
                out += math.log10(m.head[k] + 0.5) - m.group[e - v.entries]
            before = e
        return out

    for i, t in rows[:60]:
        assert abs(got[i].score - plain(t)) < 1e-6 * abs(plain(t))
    # with only the entries held by tasks, side by side or not, the same
    _, _, apart = modelled(d, 16)
    assert all(abs(apart[i].score - r.score) < 1e-6 * abs(r.score) and abs(apart[i].base_score - r.base_score) < 1e-6 * abs(r.base_score) for i, r in got.items())
