"""Near-duplicates, lines and benchmark passages against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrowtext, decontaminate, lines, neardup
from quillspark.llm.components import components
from quillspark.llm.store import spread_join
from tests.llm.cases import no_docs, odd_docs, text


def sets_of(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def varied(t, seed, n):
    r, w = random.Random(seed), t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def signature(texts, weight=None):
    ((lo, hi, data, offsets),) = arrowtext.slices(pa.array(texts))
    row, _, _, h = arrowtext.words(data, offsets)
    return neardup.signatures(*arrowtext.shingles(row, h, hi - lo), hi - lo, weight)


def test_signatures_estimate_similarity():
    errors = []
    for k in range(40):
        a = text(1000 + k, 300)
        b = varied(a, k, k % 12)
        s = signature([a, b])
        errors.append((s[0] == s[1]).mean() - jaccard(sets_of(a), sets_of(b)))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.07
    assert (signature(["", "a b"])[0] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_weighted_signatures():
    """Agreement follows the weighted similarity: sum of minima over sum of maxima."""
    rng = np.random.default_rng(1)
    errors = []
    for k in range(60):
        x = arrowtext.mix(np.arange(100 * k + 1, 100 * k + 61, dtype=np.uint64))
        wa, wb = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
        s = neardup.signatures(np.repeat([0, 1], 60), np.concatenate([x, x]), 2, np.concatenate([wa, wb]))
        errors.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_near_duplicates(spark):
    rows = [(i, text(i, 80 + i)) for i in range(30)]
    k = 100
    for i in range(12):
        for n in range(1, 6):
            rows.append((k, varied(rows[i][1], k, n)))
            k += 1
    rows += [(k + i, rows[3][1]) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    s = {i: sets_of(t) for i, t in rows}
    for a, b in itertools.combinations(s, 2):
        if jaccard(s[a], s[b]) >= 0.8:
            assert got[a].class_id == got[b].class_id, (a, b)
    by = collections.defaultdict(list)
    for i, r in got.items():
        by[r.class_id].append(i)
    for c, members in by.items():
        assert c == min(members)
        seen, todo = {c}, [c]
        while todo:
            x = todo.pop()
            for y in members:
                if y not in seen and jaccard(s[x], s[y]) >= 0.8:
                    seen.add(y), todo.append(y)
        assert seen == set(members)
    kept = neardup.keep_one(d.withColumn("class_id", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(by)
    assert kept.columns == ["doc_id", "text", "class_id"]


def family(base, share, seed, n, start):
    """n texts around one base, in each of which some words were changed, and n that share its first half only."""
    r, rows = random.Random(seed), []
    for k in range(n):
        rows.append((start + k, varied(base, seed * 1000 + k, r.randrange(0, share))))
    half = " ".join(base.split()[: len(base.split()) // 2])
    return rows + [(start + n + k, half + " " + text(seed * 77 + k, len(base.split()) // 2)) for k in range(n)]


def test_near_duplicates_of_a_skewed_table_lose_no_link(spark):
    """Against brute force: a large group around one text, and as many texts that share half of it."""
    rows = family(text(1, 300), 14, 1, 150, 0) + [(1000 + i, text(5000 + i, 120)) for i in range(60)]
    random.Random(3).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    s = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(s, 2):
        if jaccard(s[a], s[b]) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in s}


def test_prefix_pairs_hold_all_similar_pairs(spark):
    """The exact step alone, without any links before it."""
    rows = family(text(2, 60), 5, 2, 25, 0) + [(100 + k, text(2, 60 + k)) for k in range(20)]
    s = {i: sets_of(t) for i, t in rows}
    sets = neardup.table(neardup.shingle_sets(spark.createDataFrame(rows, "node long, _text string")), "test-sets")
    none = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in neardup.rest_pairs(*neardup._meetings(neardup.prefixes(sets, 0.8), none, 0.8), 0.8).collect()}
    want = {(max(p), min(p)) for p in itertools.combinations(s, 2) if jaccard(s[p[0]], s[p[1]]) >= 0.8}
    assert want and want <= got


def test_keep_one_with_clashing_names(spark):
    rows = [(1, text(1, 50), 7), (2, text(1, 50), 8), (3, text(2, 50), 9), (3, text(2, 50), 9), (None, text(3, 40), 1), (None, text(3, 40), 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, v int")
    d = d.select("*", *(F.col("v").alias(c) for c in ("_turn", "_keep", "_h1", "_h2", "_row", "_least", "node", "_id", "class_id", "copy_of")))
    out = neardup.keep_one(d)
    assert out.columns == d.columns
    assert sorted((r[0] or 0, *r[2:]) for r in out.collect()) == [(i, *[v] * 11) for i, v in ((0, 1), (1, 7), (3, 9))]
    assert neardup.keep_one(d.limit(0)).count() == 0


def test_spread_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 5), (3, 6)], "k int, i int")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = spread_join(rows, one, ["k"], F.xxhash64("i")).collect()
    assert sorted((r.k, r.i, r.v) for r in got) == sorted([(1, i, "a") for i in range(300)] + [(2, 5, "b")])
    assert spread_join(rows, one, ["k"], F.xxhash64("i"), "left").filter("v is null").count() == 1


def test_near_duplicates_odd(spark):
    got = neardup.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 8
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == 1
    assert by[5] == 5 and by[3] == 3 and by[4] == 4
    kept = [r.doc_id for r in neardup.keep_one(odd_docs(spark)).collect()]
    assert kept.count(4) == 1 and kept.count(None) == 1
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


CUT = re.compile(r"(?<=\n)|(?<=[.,;?] )")


def plain_lines(rows, least=lines.MIN_CHARS):
    """One pass over the documents in the order of their ids."""
    first, gone = {}, collections.defaultdict(set)
    split = {i: [x for x in CUT.split(t)] for i, t in rows}
    for i, _ in sorted(rows):
        u = split[i]
        for p in range(len(u) - 2):
            w = tuple(x.strip(" ") for x in u[p : p + 3])
            if sum(map(len, u[p : p + 3])) < least:
                continue
            if w in first:
                gone[i] |= {p, p + 1, p + 2}
            else:
                first[w] = i
    return {i: "".join(x for p, x in enumerate(split[i]) if p not in gone[i]) for i, _ in rows}


def test_lines(spark):
    rng = random.Random(9)
    pool = [text(i, rng.randint(2, 9)) for i in range(50)]
    rows = [(i, rng.choice(["\n", ". ", ", "]).join(pool[(j + rng.randint(0, 1)) % 50] if rng.random() < 0.9 else text(1000 * i + j, 6) for j in range(s, s + rng.randint(1, 12)))) for i, s in enumerate(rng.randrange(40) for _ in range(80))]
    passage = ". ".join(text(7000 + i, 9) for i in range(7)) + ". "
    rows += [(500 + i, text(8000 + i, 60) + " " + passage + text(9000 + i, 60)) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine"))
    out = lines.dedup_lines(d).collect()
    assert {r.doc_id: r.text for r in out} == plain_lines(rows)
    assert {r.n_lines for r in out} == {"mine"}
    inner = passage.split(". ")[3]
    assert sum(inner in r.text for r in out) == 1


def test_lines_odd(spark):
    odd = odd_docs(spark)
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    before = collections.Counter((r.doc_id, r.text) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == before
    assert lines.dedup_lines(no_docs(spark)).count() == 0


def test_common_subsequence():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_decontamination(spark):
    items = [(i, text(50_000 + i, 40 + i % 15), f"answer{i}") for i in range(30)]
    rows = [(i, text(i, 50 + 7 * i)) for i in range(60)]
    for i in range(30):
        w = text(90_000 + i, 300).split()
        x = items[i][1].split()
        if i % 3 == 1:  # a paraphrase: some words dropped, some replaced
            r = random.Random(i)
            x = [y if r.random() > 0.1 else "other" for y in x if r.random() > 0.1]
        at = (i * 13) % 250
        rows.append((1000 + i, " ".join(w[:at] + x + ([f"answer{i}"] if i % 2 else []) + w[at:])))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit(1))
    b = spark.createDataFrame([*items, (99, None, None), (98, "", None)], "item_id long, text string, answer string")
    got = {r.doc_id: r for r in decontaminate.contaminated(d, b).collect()}
    for i in range(30):
        assert got[1000 + i].item_ids == [i], i
    assert not any(got[i].contaminated for i in range(60))
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()) == list(range(60))
    answered = {r.doc_id for r in decontaminate.contaminated(d, b, answer_col="answer").collect() if r.contaminated}
    assert answered == {1000 + i for i in range(30) if i % 2}
    odd = decontaminate.contaminated(odd_docs(spark), b).collect()
    assert len(odd) == 8 and not any(r.contaminated for r in odd)
    assert decontaminate.contaminated(no_docs(spark), b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contaminated(d, b.limit(0)).collect())
