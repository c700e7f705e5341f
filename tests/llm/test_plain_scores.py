"""Scores of op1, op2 and op9, and the search of op8, against plain versions that share no code with them but the hash of a word."""

import collections
import itertools
import math
import random
import re

import numpy as np
import zstandard

from quillspark.llm import arrowtext, brown, decontaminate, quality, toxicity
from quillspark.llm.labelled import remainder
from tests.llm.cases import text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hash(w, lower=False):
    return int(arrowtext.hash_words([w], np.zeros(256, bool), lower)[0])


def test_quality_scores(spark):
    rows = [(i, text(i, 20 + 37 * (i % 19)) + ("" if i % 3 else " éü" * 400)) for i in range(60)] + [(100, ""), (101, None)]
    good, bad = (quality.dictionary([text(k, 300).encode() for k in range(a, a + 30)]) for a in (500, 700))
    m = quality.QualityModel(good, bad, np.array([3.0, 1.5, -0.7, 0.4, -0.2]))

    def plain(t):
        if not t:
            x = [0.0] * 4
        else:
            b, parts = t.encode(), []
            while b:
                parts.append(b[:1024])
                b = b[1024:]
            if len(parts) > 1 and len(parts[-1]) < 256:
                last = parts.pop()
                parts[-1] += last
            size = [[len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(p)) for p in parts] for d in (good, bad)]
            per = sorted((b - g) / len(p) for g, b, p in zip(*size, parts, strict=True))
            worst = per[: max(1, len(per) // 4)]
            n = len(t.encode())
            x = [(sum(size[1]) - sum(size[0])) / n, sum(worst) / len(worst), min(1, sum(size[0]) / n), 64 / (64 + n)]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, m.weights, strict=False)) + m.weights[4])))

    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t in rows)


def test_toxic_scores(spark):
    rng = random.Random(8)
    bad = {"vilest": 4.0, "rotten": 2.5, "scoun": 3.0}  # a whole word, a word, the first five letters of a word

    def prefix(w, n):
        acc = n
        for j in range(n):
            acc = (acc * 0x100000001B3 + (ord(w[j]) if j < len(w) else 0)) % (1 << 64)
        return int(arrowtext.mix(np.array([acc], np.uint64))[0])

    keys = {word_hash("vilest", True): 4.0, word_hash("rotten", True): 2.5, prefix("scoun", 5): 3.0}
    order = np.argsort(np.array(list(keys), np.uint64))
    m = toxicity.ToxicModel(np.array(list(keys), np.uint64)[order], np.array(list(keys.values()))[order], 0.4137, 0.8, np.array([0.7, 0.3, -2.0]), expect=0.05)
    rows = []
    for i in range(80):
        w = text(i, 5 + i).split()
        for _ in range(i % 7):
            w.insert(rng.randrange(len(w)), rng.choice(["Vilest", "rotten,", "SCOUNDREL", "scoundrels"]))
        rows.append((i, " ".join(w)))

    def best_parts(s, lo, hi):
        top = max(((sum(s[a:b]), a, b) for a, b in itertools.combinations(range(lo, hi + 1), 2)), default=(0, 0, 0))
        return [] if top[0] <= 0 else [*best_parts(s, lo, top[1]), top, *best_parts(s, top[2], hi)]

    got = {r.doc_id: r for r in toxicity.passages(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    for i, t in rows:
        words = [(x[0].lower(), x.start(), x.end()) for x in re.finditer("[A-Za-z0-9]+", t)]
        value = lambda w: bad["vilest"] if w == "vilest" else bad["rotten"] if w == "rotten" else bad["scoun"] if w[:5] == "scoun" else -0.4137
        s = [value(w) for w, _, _ in words]
        parts = best_parts(s, 0, len(s))
        base = math.log(0.8 * max(len(s), 1))
        over = [p[0] - base for p in parts]
        x = (max(0.0, max(over)), math.log1p(sum(o for o in over if o >= -math.log(0.05)))) if over else (0.0, 0.0)
        assert abs(got[i].score - 1 / (1 + math.exp(-(0.7 * x[0] + 0.3 * x[1] - 2)))) < 1e-9, i
        want = [(words[a][1], words[b - 1][2]) for v, a, b in parts if 0.8 * len(s) * math.exp(-v) <= 0.05]
        assert [(p.start, p.end) for p in got[i].passages] == want


def test_brown_scores(spark):
    rows = [(i, text(i % 130, 40).capitalize() + f" rare{i % 60} Rare{i}") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    train = remainder("doc_id", 5) != 1
    v = brown.vocabulary(d.filter(train), head=120, entries=40)
    m, sums = brown.fit(brown.table(brown.count(d, v, train), "t"), v)
    got = {r.doc_id: r.score for r in brown.score(d, m, sums).collect()}
    learn = {r.doc_id for r in d.filter(train).collect()}
    words = lambda t: [w.decode() for w in t.translate(LOWER).encode().split()]
    own = {int(h): int(e) for h, e in zip(v.head, v.entry, strict=True) if e >= 0}

    def group(w):
        b = w.encode()
        last, second = b[-1], b[-2] if len(b) > 1 else 0
        return int(arrowtext.mix(np.array([last * 256 + second], np.uint64))[0] % np.uint64(brown.GROUPS))

    entry = lambda w: own.get(word_hash(w), v.entries + group(w))
    count, pairs, kinds = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, t in rows:
        if i in learn:
            e = [v.end, *map(entry, words(t)), v.end]
            pairs.update(itertools.pairwise(e))
            count.update(words(t))
    seen = collections.Counter()
    for (_, b), n in pairs.items():
        seen[b] += n
    for w in count:
        kinds[entry(w)].add(w)
    k = int(m.cls.max()) + 1
    by, before, mass, size = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter(m.cls.tolist())
    for (a, b), n in pairs.items():
        by[m.cls[a], m.cls[b]] += n
        before[m.cls[a]] += n
        mass[m.cls[b]] += n
    for i, t in rows:
        total, last = 0.0, v.end
        for w in [*words(t), None]:
            e = v.end if w is None else entry(w)
            a, b = m.cls[last], m.cls[e]
            total += math.log10((by[a, b] + 0.1) / (before[a] + 0.1 * k)) + math.log10((seen[e] + 0.5) / (mass[b] + 0.5 * size[b]))
            if w is not None and e >= v.entries:
                total += math.log10((count[w] + 0.5) / (seen[e] + 0.5 * (len(kinds[e]) + 1)))
            last = e
        assert abs(got[i] - total) < 1e-6 * abs(total), i


def test_search_against_all_windows(spark):
    """Items that any span of an item's length shares 65 % of in order are found; of others none is."""
    rng = random.Random(5)
    items = [(k, text(3000 + k, 24 + 3 * k).replace(".", "").split()) for k in range(8)]
    rows, i = [], 0
    for k, w in items:
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.4, 0.2):
            varied = [x if rng.random() < share else f"other{rng.randrange(10**6)}" for x in w]
            rows.append((i, f"{text(4000 + i, 70)} {' '.join(varied)} {text(5000 + i, 70)}"))
            i += 1
    rows += [(i + k, text(6000 + k, 150)) for k in range(20)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))
        return row[-1]

    plain = {}
    for i, t in rows:
        words = re.findall("[a-z0-9]+", t.lower())
        best = lambda w, words=words: max(lcs(w, words[p : p + len(w)]) for p in range(0, len(words) - len(w) + 1, 2)) / len(w)
        plain[i] = {k: best(w) for k, w in items}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    near = [(i, k) for i, x in plain.items() for k, s in x.items() if s >= 0.75]
    assert len(near) > 30
    assert sum(k in got[i] for i, k in near) >= 0.95 * len(near)
    assert not [(i, k) for i, x in got.items() for k in x if plain[i][k] < 0.45]
