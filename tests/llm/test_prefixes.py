"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quillspark.llm import prefixes
from quillspark.llm.queries import op11_prefix_trie


def plain(rows):
    """Nodes from (conv_id, turn, role, text) by dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, m, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    depth = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + t[h:]
        depth[c] = len(path)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ended = ",".join(str(c) for c in sorted(c for c in m if depth[c] == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def ours(df, **how):
    return sorted(map(tuple, prefixes.trie(df, **how).collect()), key=lambda r: (r[1], r[0]))


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, n_convs=60, turns=9, texts=3):
    r = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(r.randint(1, turns)):
            rows.append((r.choice([c, c + 100, c + 1000]), t, r.choice(["user", "assistant"]), f"t{r.randint(1, texts)}é" * r.randint(0, 3)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_plain_trie(spark, seed):
    rows = made(seed)
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_long_conversations_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 8)
    monkeypatch.setattr(prefixes, "IDS", 4)
    rows = made(3, 20)
    for c in (7, 8, 307, 400):  # the same 40 turns, then of their own
        rows += [(c, 100 + t, "user", f"x{t}" if t < 40 else f"{c}-{t}") for t in range(24 + c % 5 * 8)]
    for c in range(500, 540):
        rows += [(c, t, "user", "copy") for t in range(17)]
    rows += [(650, t, "user", str(t % 3)) for t in range(16)]
    rows += [(651, t, "user", "copy") for t in range(8)]
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = made(4, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    monkeypatch.setattr(prefixes, "LEAST_CELLS", 64)
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    assert ours(df, most_cells=64) == want
    assert ours(df, most_cells=1024) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, "user", ""), (5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "user", "b"), (-250, 0, "u", "neg"), (-200, 0, "u", "neg"), (-200, 1, "u", "neg2"), (0, 0, "u", "long " * 20_000), (100, 1, None, "y"), (102, 1, "user", "one"), (103, 1, "user", "one"), (2**62, 3, "é", "ü")]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA + ", depth int, x1 string")
    assert ours(df) == plain(rows)
    assert prefixes.trie(df.limit(0)).collect() == []
    alone = [(c, 1, "user", "only") for c in range(40) if zlib.crc32(str(c).encode()) % 6 > 0 and c]  # nothing is left of any
    assert ours(spark.createDataFrame(alone, SCHEMA)) == plain(alone)
    assert len(plain(alone)) == 1


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op11_prefix_trie(spark, sf).collect()), key=lambda r: (r[1], r[0]))
    assert got == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(con.sql(prefixes.ORACLE_SQL).fetchall(), key=lambda r: (r[1], r[0])) == got
