"""Mixing, tokens, rules and secrets against plain versions."""

import collections
import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillspark.llm import mixing, rules, secrets, tokens
from tests.llm.cases import no_docs, odd_docs, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(i, 10 + i % 90), "en" if i % 2 else "de", f"s{i % 7 if i % 3 else 0}") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def fill(sizes, weights, most=3):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if t[s] > most * sizes[s] + 1e-9} - capped
        if not over:
            return t
        capped |= over


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
    want = fill(sizes, mixing.WEIGHTS)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = {r[0]: r[4] for r in con.sql(mixing.ORACLE_SQL).fetchall()}
    assert sql == {r.doc_id: r.taken for r in got}


def test_mixing_odd(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 8
    assert {r["size"] for r in got if r.doc_id in (1, 2, 6)} == {0}
    assert mixing.mix(no_docs(spark)).count() == 0


def test_pareto_weights(spark):
    """Documents of three times the weight are taken about three times as often."""
    rows = [(i, "w " * 10, "a", 3.0 if i % 2 else 1.0) for i in range(2000)] + [(9000 + i, "w " * 10, "b", 1.0) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = mixing.mix(d, weight_col="w", weights=(1, 12)).filter("source = 'a'").collect()
    n = collections.Counter((r.doc_id % 2, r.copies) for r in got)
    share = n[1, 1] / max(n[0, 1], 1)
    assert 2.2 < share < 3.8, n


def test_tokens(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        v = tokens.prove(f.read())
    assert v.splits and v.feed and len(v.whole) > 10_000
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    c, rng = tokens.Counter(v), random.Random(4)
    bits = [" ", "\n", "a", "the", "▁", "é", "\t", "  ", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "ing", "日本", "𝒳", " ", "\r\n"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert c.count([t]) == [len(sp.encode(t))], repr(t)
    odd = odd_docs(spark)
    got = {r.doc_id: r for r in tokens.count_tokens(odd, v).collect()}
    for r in odd.collect():
        t = r.text or ""
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes) == (len(sp.encode(t)), len(t.encode()))
    assert got[5].over_limit
    assert tokens.count_tokens(no_docs(spark), v).count() == 0


def plain_counts(t):
    w = WORD.findall(t or "")
    n = len(w)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover = {j for i in range(n - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_rules(spark):
    rng = random.Random(5)
    rows = [(i, text(i, 90), "en") for i in range(60)]
    rows += [(100 + i, (text(i, 30) + "\n") * rng.randint(1, 4) + "#| é😀\t" + text(i, 9), "en") for i in range(20)]
    rows += [(200 + i, " ".join("#$%" + w.upper() + "%%&" for w in text(i, 90).split()), "en") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.judge(d).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t), i
    assert all(got[i].kept for i in range(60))
    assert not any(got[200 + i].kept for i in range(5))
    odd = {r.doc_id: r for r in rules.judge(odd_docs(spark)).collect()}
    assert odd[1].base_failed and odd[1].n_words == 0 and not odd[1].kept
    assert odd[5].n_words == 30_000
    assert rules.judge(no_docs(spark)).count() == 0


def test_secrets(spark):
    hexa = hashlib.sha1(b"x").hexdigest()
    rng = random.Random(6)
    noise = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(40))
    rows = [
        (1, f'x token = "{hexa}" y'),
        (2, "AKIA" + "A1B2C3D4E5F6G7H8 and AKIASHORT"),
        (3, 'Api_Key:abc PASSWORD="longer-one" é😀 secret=token=abcdefgh'),
        (4, "token=token: abcdefgh"),
        (5, f"note {noise} get_user_name_from_session_context_2 ende"),
        (6, None),
        (7, "ff" * 12),
    ]
    rows += [(100 + i, f"{text(i, 40)} account_manager_service user-profile-settings secret={hashlib.md5(str(i).encode()).hexdigest()[:10]}{noise[i : i + 20]}") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = [("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile("([0-9a-f]+)"), 24)]
    got = {r.doc_id: r for r in secrets.scan(d).select("doc_id", secrets.joined(F.col("spans"), 2).alias("base"), secrets.joined(F.col("spans")).alias("every")).collect()}
    for i, t in rows:
        want = sorted((m.start(), k, name, m.end()) for k, (name, p, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[1]) >= least)
        assert got[i].base == ",".join(f"{n}:{a}:{b}" for a, _, n, b in want), i
    assert got[5].every == f"markov:5:{5 + len(noise)}"
    odd = secrets.scan(odd_docs(spark)).collect()
    assert len(odd) == 8 and not any(r.spans for r in odd)
    assert secrets.scan(no_docs(spark)).count() == 0
