"""Chains of op10: runs of any length, identifiers of all texts."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import secrets
from quillspark.llm.store import table
from tests.llm.cases import text


def test_whole_runs_and_identifiers_of_all_texts(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))
    rows = [(100 + i, f"{text(i, 40)} account_manager_service user-profile-settings secret={hashlib.md5(str(i).encode()).hexdigest()[:10]}{noise(20)}") for i in range(20)]
    # a style that only texts without a base match have
    rows += [(200 + i, f"{text(300 + i, 10)} " + "-".join(["QX7"] * 8)) for i in range(300)]
    rows += [(600 + i, f"{text(i, 9)} " + "account_manager_service user-profile-settings session_context_2 " * 10) for i in range(600)]
    name = "account_manager_service_2_"
    rows += [(1, f"a {name * 12}{noise(2_000)} b"), (2, f"a {noise(300)}{name * 200} b"), (3, f"a {noise(40)} b"), (4, f"a {noise(4_000)} b")]
    got = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(2, 2 + 12 * len(name) + 2_000)]  # judged by its first part before
    assert not got[2]  # as was this one
    assert len(got[3]) == len(got[4]) == 1
    assert not any(got[200 + i] for i in range(300))


def plain_scan(rows):
    """The whole operator in plain Python: spans of each text."""
    kinds = [re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("(AKIA[A-Z0-9]{16,})"), re.compile("([0-9a-f]{24,})")]
    run = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
    base = {i: sorted((m.start(), k, m.end(), m[1]) for k, p in enumerate(kinds) for m in p.finditer(t) if len(m[1]) >= 6) for i, t in rows}
    random_ = collections.Counter(v.replace(".", "") for b in base.values() for *_, v in b if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(v) >= 16)
    ordinary = collections.Counter(m[0] for i, t in rows for m in run.finditer(t) if not any(v in m[0] for *_, v in base[i]))
    return base, random_, ordinary, run


def test_against_a_plain_version(spark):
    """Spans, ratios and threshold agree; random strings of 12 to 40 characters are found, words, names, paths and numbers left."""
    rng = random.Random(11)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789+/"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f"{text(i, 60)} account_manager_service /usr/share/{text(i, 1)}-config{i} call 555-{i:04d} or {4_000_000_000_000_000 + i * 7_919_111_333}") for i in range(400)]
    rows += [(1000 + i, f"{text(i, 20)} secret={noise(40)} token: {noise(24)} {text(i + 1, 20)}") for i in range(200)]
    planted = {2000 + i: noise(12 + i % 29) for i in range(120)}
    rows += [(i, f"{text(i, 15)} {v} {text(i + 1, 15)}") for i, v in planted.items()]
    base, random_, ordinary, run = plain_scan(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scanned = table(secrets.scanned(d), "secrets")
    strings = secrets.samples(scanned).collect()
    assert {(r.v, r.times) for r in strings if r.m == 0} == set(random_.items())
    assert {(r.v, r.times) for r in strings if r.m == 1} == set(ordinary.items())
    held = {r.v for r in strings if r.held}
    k = len(secrets.ALPHABET)
    prior = math.log(sum(ordinary.values()) / sum(random_.values()))

    def ratio_by(samples):
        n, total = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
        for m, counts in enumerate(samples):
            for v, times in counts.items():
                if v not in held:
                    for a, b in zip("\0" + v, v, strict=False):
                        n[m][a, b] += times
                        total[m][a] += times
        log = lambda m, a, b: math.log((n[m][a, b] + 0.5) / (total[m][a] + 0.5 * k))
        return lambda v: sum(log(0, a, b) - log(1, a, b) for a, b in zip("\0" + v, v, strict=False))

    first = ratio_by((random_, ordinary))
    left = {v: n for v, n in ordinary.items() if first(v) <= prior}
    ratio = ratio_by((random_, left))
    model = secrets.models(secrets.samples(scanned))
    scores = [[(ratio(v), n) for v, n in counts.items() if v in held] for counts in (random_, left)]
    step = next(s for s in range(10_000) if sum(n for x, n in scores[1] if x >= s * 0.25) <= 1e-3 * sum(n for _, n in scores[1]))
    most = max(int(x // 0.25) for x, _ in scores[0] if sum(n for y, n in scores[0] if y // 0.25 < x // 0.25) <= 0.01 * sum(n for _, n in scores[0]))
    assert model.threshold == min(max(step, math.ceil(prior / 0.25)), most) * 0.25
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans] for r in secrets.scan(d).collect()}
    for i, t in rows:
        runs = [(m.start(), 3, m.end()) for m in run.finditer(t) if not any(s < m.end() and m.start() < e for s, _, e, _ in base[i]) and ratio(m[0]) > model.threshold]
        assert got[i] == sorted([b[:3] for b in base[i]] + runs), i
    found = sum(any(t[s[0] : s[2]] == planted[i] for s in got[i]) for i, t in rows if i in planted)
    assert found >= 0.95 * len(planted)
    assert sum(s[1] == 3 for i in range(400) for s in got[i]) <= 4


def test_places_of_many_matches(spark):
    t = " ".join(f"secret={'é' * (i % 3)}abcdef{i}" for i in range(700))
    (r,) = secrets.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    want = [(m.start(), m.end()) for m in re.finditer(r"secret=[A-Za-z0-9+/_.=-]{6,}", t)]
    assert [(s.start, s.end) for s in r.spans] == want


def repeats(n=300):
    """Texts that repeat a secret bare, after or before its assignment, among ordinary ones."""
    rng = random.Random(21)
    noise = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))
    rows = [(i, f"{text(i, 30)} account_manager_service user-profile-settings {text(i + 1, 9)}") for i in range(n)]
    rows += [(1000 + i, f"{text(i, 9)} secret={noise(32)} {text(i, 9)}") for i in range(60)]
    values = {2000 + i: noise(27) for i in range(9)}
    rows += [(i, (f"token={v} and later plain {v} again" if i % 2 == 0 else f"plain {v} before token={v}") + f" {text(i, 5)}") for i, v in values.items()]
    return rows, values


@pytest.mark.parametrize("limit", [0, 100_000])
def test_bare_repeats_of_a_secret_are_found(spark, monkeypatch, limit):
    """By place, and the same as DuckDB says; whether strings and texts are broadcast or not."""
    monkeypatch.setattr(secrets, "ODD_STRINGS", limit)
    monkeypatch.setattr(secrets, "ODD_TEXTS", limit)
    rows, values = repeats()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).select("doc_id", secrets.joined(F.col("spans")).alias("spans")).collect()}
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    assert {r[0]: r[-1] for r in con.sql(f"SELECT doc_id, spans FROM ({secrets.ORACLE_SQL})").fetchall()} == {i: r.spans for i, r in got.items()}
    for i, t in rows:
        if i in values:
            places = {m.start() for m in re.finditer(re.escape(values[i]), t)}
            spans = [x.split(":") for x in got[i].spans.split(",")]
            covered = {p for p in places if any(int(a) <= p < int(b) for _, a, b in spans)}
            assert covered == places, (t, got[i].spans)
