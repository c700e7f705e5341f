"""Brown class language model: exchange classes, class transitions and word emissions.

Tokens are the words of a text with A-Z lower-cased, then one end. The most frequent words of the
training documents are entries of their own, ENTRIES of them or, where that is more, the square root of
the number of different words, so their bigrams are no more than those. Exchange clustering puts the entries
into CLASSES classes by the likelihood of all training bigrams, in which the other words count by their
endings (the last two bytes). Then every other word of the training documents moves from its ending to the
class in which all its own neighbours are likeliest: the words of a class are a group, which is one more entry, and
a word's probability within its group comes from its own count. The entries and groups are clustered once more, and

    P(w | v) = P(class w | class v) * P(entry w | class w) [* P(w | group)].

Words that the training documents don't have belong to the group of their ending. A vocabulary that hasn't been
through `learn` has the endings themselves as groups.

All counts are over all training documents, those by which entries are chosen too. The most frequent
words have their counts and groups sent to every task (HEAD of them, whatever the corpus); each occurrence of
another word, with its neighbours, is a row that Spark deals by the word, so their counts and groups grow with the corpus
and are never gathered in one place. Which words are sent doesn't change any result.

Null texts count as empty: one token, the end. Without training documents all counts are 0 and every
token has the same base probability. Rows with equal texts share their rows of rare words. Long texts
are read whole. Repeated ids are scored row by row; other columns aren't touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import arrowtext as at
from quillspark.llm.store import by_text, discard, hot_join, spread_join, table

#: Words whose counts every task holds: two arrays of 8 bytes each.
HEAD = 131_072
#: Different words, or bigrams, that a task gathers before it hands them on.
GATHERED = 1_000_000
#: A group is a class of the first clustering, so there are no fewer GROUPS than CLASSES; words have as many endings.
ENTRIES, GROUPS, CLASSES = 1_500, 64, 50
SWEEPS = 5
#: Kinds of rows besides those of rare words: pairs of entries, head words, pairs of rare words.
_BIGRAM, _HEAD, _PAIR = -1, -2, -3


def _words(data, offsets):
    """(row, hash, ending) of the words."""
    row, start, end, h = at.words(data, offsets, at.BLANK, lower=True)
    low = at.LOWER[data]
    last = low[end - 1].astype(np.uint64) if len(row) else np.zeros(0, np.uint64)
    second = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(row) else last
    return row, h, (at.mix(last * np.uint64(256) + second) % np.uint64(GROUPS)).astype(np.int64)


@dataclass
class Vocabulary:
    head: np.ndarray  # sorted hashes
    entry: np.ndarray  # of each head word: its entry, or -1
    sieve: np.ndarray
    entries: int
    group: np.ndarray  # of each head word
    kin: np.ndarray | None = None  # class of each entry, ending and end by the first clustering; None before it
    near: np.ndarray | None = None  # what a neighbour (its class, before; CLASSES and its class, behind) says for each group

    @property
    def end(self) -> int:
        return self.entries + GROUPS

    @property
    def size(self) -> int:
        return self.entries + GROUPS + 1

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place in head, or -1."""
        out = np.full(len(h), -1, np.int64)
        p = np.flatnonzero(self.sieve[(h & np.uint64(0x3FFFFF)).astype(np.int64)])
        if len(p) and len(self.head):
            k = np.minimum(np.searchsorted(self.head, h[p]), len(self.head) - 1)
            ok = self.head[k] == h[p]
            out[p[ok]] = k[ok]
        return out

    def of(self, k: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Entry of each word, of its place in head; a word that isn't there has `group`."""
        if not len(self.entry):
            return self.entries + group
        at_ = np.maximum(k, 0)
        own = np.where(k >= 0, self.entry[at_], -1)
        return np.where(own >= 0, own, self.entries + np.where(k >= 0, self.group[at_], group))

    def likeliest(self, ending: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Group of each word, of its ending and of (word, neighbour, times), sorted by word; a word without neighbours has its ending's."""
        if self.kin is None:
            return ending
        out = self.kin[self.entries + ending]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        if len(first):
            out[word[first]] = np.add.reduceat(self.near[code] * n[:, None], first, axis=0).argmax(axis=1)
        return out


class _Sums:
    """Counts by key, each key with a group that follows from it."""

    def __init__(self):
        self.parts, self.size, self.least = [], 0, 2 * GATHERED

    def add(self, keys: np.ndarray, groups: np.ndarray) -> bool:
        """Whether there are GATHERED different keys by now."""
        u, first, n = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((u, groups[first], n))
        self.size += len(u)
        if self.size < self.least:
            return False
        self.parts = [self._merged()]
        self.size = len(self.parts[0][0])
        return self.size >= GATHERED

    def _merged(self):
        keys, groups, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        u, first, to = np.unique(keys, return_index=True, return_inverse=True)
        return u, groups[first], np.bincount(to, counts, len(u)).astype(np.int64)

    def take(self):
        """(keys, groups, counts) in parts of 100,000; starts anew."""
        if self.parts:
            u, g, n = self._merged()
            self.parts, self.size = [], 0
            for i in range(0, len(u), 100_000):
                yield u[i : i + 100_000], g[i : i + 100_000], n[i : i + 100_000]


def vocabulary(docs: DataFrame, text_col: str = "text", head: int = HEAD, entries: int | None = None) -> Vocabulary:
    """Head and entries by the counts of all words of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out() -> Iterator[pa.RecordBatch]:
            for u, g, n in sums.take():
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g), pa.array(n)], names=["h", "g", "n"])

        for batch in batches:
            for _, _, data, offsets in at.slices(batch.column(0)):
                _, h, g = _words(data, offsets)
                if sums.add(h, g):
                    yield from out()
        yield from out()

    counts = table(by_text(docs.select(text_col)).mapInArrow(run, "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n")), "brown-words")
    if entries is None:
        entries = max(ENTRIES, math.isqrt(counts.count()))
    head = max(head, entries)
    got = counts.orderBy(F.desc("n"), "h").limit(head).toArrow().to_pandas()
    hashes = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    entries = min(entries, len(hashes))
    sieve = np.zeros(1 << 22, bool)
    sieve[(hashes & np.uint64(0x3FFFFF)).astype(np.int64)] = True
    return Vocabulary(hashes[order], np.where(order < entries, order, -1), sieve, entries, got["g"].to_numpy(np.int64)[order])


@dataclass
class _Line:
    """The tokens of a slice, with an end behind each row's words: row, entry, place in head (-1 rare), hash, ending; before: that of the token before."""

    row: np.ndarray
    entry: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    ending: np.ndarray
    first: np.ndarray  # of its row

    @property
    def before(self) -> np.ndarray:
        out = np.roll(self.entry, 1)
        out[self.first] = self.entry[-1]  # an end
        return out

    @property
    def rare(self) -> np.ndarray:
        return self.place == -1

    @property
    def after_rare(self) -> np.ndarray:
        return np.roll(self.rare, 1) & ~self.first


_END = -2


def _line(v: Vocabulary, data, offsets, rows: int) -> _Line:
    row, h, ending = _words(data, offsets)
    k = v.look_up(h)
    words = np.arange(len(row)) + row  # behind the ends of the rows before
    ends = np.cumsum(np.bincount(row, minlength=rows)) + np.arange(rows)

    def put(x, end):
        out = np.full(len(row) + rows, end, x.dtype)
        out[words] = x
        return out

    r = put(row, 0)
    r[ends] = np.arange(rows)
    first = np.zeros(len(r), bool)
    first[0] = True
    first[ends[:-1] + 1] = True
    return _Line(r, put(v.of(k, ending), v.end), put(k, _END), put(h, 0), put(ending, 0), first)


def _taken(sums: _Sums, kind: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the kind, of what was summed: its key as a, its times as t; 0 else."""
    for u, _, n in sums.take():
        have = {"g": np.full(len(u), kind), "a": u, "t": n}
        yield pa.RecordBatch.from_arrays([pa.array(have.get(c, np.zeros(len(u), np.int64))) for c in names], names=names)


def learn(docs: DataFrame, v: Vocabulary, text_col: str = "text") -> Vocabulary:
    """v, whose groups are endings, with the first clustering and the groups of the head words that are no entries, from training documents."""

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Sums()
        for batch in batches:
            for lo, hi, data, offsets in at.slices(batch.column(0)):
                x = _line(v, data, offsets, hi - lo)
                if pairs.add(x.before * v.size + x.entry, x.row):
                    yield from _taken(pairs, _BIGRAM, ["a", "t"])
        yield from _taken(pairs, _BIGRAM, ["a", "t"])

    text = by_text(docs.select(text_col))
    got = text.mapInArrow(bigrams, "a long, t long").groupBy("a").agg(F.sum("t").alias("t")).toArrow().to_pandas()
    before, after = np.divmod(got["a"].to_numpy(np.int64), v.size)
    times = got["t"].to_numpy(np.int64)
    kin = _exchanged(v.size, before, after, times)
    m = np.bincount(kin[before] * CLASSES + kin[after], times, CLASSES**2).reshape(CLASSES, CLASSES)
    # what one more pair adds to the likelihood of all classes: log m less the logs of both totals, one half of them a neighbour
    total = np.log(m.sum(axis=1) + 0.1 * CLASSES) + np.log(m.sum(axis=0) + 0.1 * CLASSES)
    total[m.sum(axis=0) == 0] = np.inf
    total[0] = np.inf  # the end's class
    near = np.log(m + 0.1)
    near = np.concatenate([near, near.T]) - total / 2
    free = np.flatnonzero(v.entry < 0)
    width = 2 * CLASSES

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.zeros(len(v.head) + 1, np.int64)
        slot[free] = np.arange(len(free))
        met = np.zeros(len(free) * width, np.int32)
        for batch in batches:
            for lo, hi, data, offsets in at.slices(batch.column(0)):
                x = _line(v, data, offsets, hi - lo)
                own = np.flatnonzero((x.place >= 0) & (x.entry >= v.entries))
                cell = slot[x.place[own]] * width
                np.add.at(met, cell + kin[x.before[own]], 1)
                np.add.at(met, cell + CLASSES + kin[x.entry[own + 1]], 1)
        cells = np.flatnonzero(met)
        for i in range(0, len(cells), 100_000):
            part = cells[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // width).astype(np.int32)), pa.array((part % width).astype(np.int32)), pa.array(met[part])], names=["p", "c", "n"])

    ending = v.group
    learned = replace(v, group=kin[v.entries + ending], kin=kin, near=near)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, cells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = cells.flatten()
            word = np.repeat(np.arange(len(p)), np.diff(cells.offsets.to_numpy()))
            code, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(learned.likeliest(ending[free[p]], word, code, n).astype(np.int32))], names=["p", "k"])

    if len(free) and len(got):
        cells = text.mapInArrow(neighbours, "p int, c int, n int").repartition("p").groupBy("p", "c").agg(F.sum("n").alias("n"))
        words = cells.groupBy("p").agg(F.collect_list(F.struct("c", "n")).alias("met"))
        chosen = words.mapInArrow(choose, "p int, k int").toArrow().to_pandas()
        learned.group[free[chosen["p"].to_numpy(np.int64)]] = chosen["k"].to_numpy(np.int64)
    return learned


_ROW = ["g", "a", "b", "z", "t"]
#: Where z of a rare word has the entries before and behind (plus 1: 0 is a rare word) and, in the lowest bits, their classes.
_Q, _S = 36, 12


def count(docs: DataFrame, v: Vocabulary, train: Column, text_col: str = "text") -> DataFrame:
    """Rows of four kinds: pairs of entries (a: the pair; t: times in training),
    head words (a: place), and of rare words, t being 1 in training, b the text: words (g: ending, a: hash, z: neighbours, see _Q)
    and pairs that stand side by side (a and z: hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Sums()
        head = np.zeros(len(v.head) + 1, np.int64)

        def rows(**have) -> pa.RecordBatch:
            none = np.zeros(len(have["a"]), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(have.get(c, none)) for c in _ROW], names=_ROW)

        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            learn = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for lo, hi, data, offsets in at.slices(batch.column(0)):
                x = _line(v, data, offsets, hi - lo)
                use = learn[lo:hi]
                seen, rare, side = use[x.row], x.rare, x.after_rare
                head[:-1] += np.bincount(x.place[(x.place >= 0) & seen], minlength=len(v.head))
                head[-1] += int(use.sum())
                known = seen & ~rare & ~side
                if pairs.add((x.before * v.size + x.entry)[known], x.row[known]):
                    yield from _taken(pairs, _BIGRAM, _ROW)
                i = np.flatnonzero(rare)
                if len(i):
                    # as in learn, neighbours that are no entries count by their endings
                    kind = np.zeros(len(x.entry), np.int64) if v.kin is None else v.kin[np.where((x.place >= 0) & (x.entry >= v.entries), v.entries + x.ending, x.entry)]
                    back = np.where(x.first[i], 0, kind[i - 1])
                    q, s = np.where(side[i], 0, x.before[i] + 1), np.where(rare[i + 1], 0, x.entry[i + 1] + 1)
                    z = (q << _Q) + (s << _S) + back * CLASSES + kind[i + 1]
                    yield rows(g=x.ending[i], a=x.hash[i].view(np.int64), b=key[lo + x.row[i]], z=z, t=seen[i].astype(np.int64))
                    i = np.flatnonzero(rare & side)
                    yield rows(g=np.full(len(i), _PAIR), a=x.hash[i - 1].view(np.int64), b=key[lo + x.row[i]], z=x.hash[i].view(np.int64), t=seen[i].astype(np.int64))
        yield from _taken(pairs, _BIGRAM, _ROW)
        at_ = np.flatnonzero(head)
        for i in range(0, len(at_), 100_000):
            part = at_[i : i + 100_000]
            yield rows(g=np.full(len(part), _HEAD), a=part, t=head[part])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.coalesce(train, F.lit(False)).alias("_train"))
    return by_text(rows).mapInArrow(run, ", ".join(f"{c} long" for c in _ROW))


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each entry, the last (the end) alone in class 0; moves one entry at a time to its best class."""
    rows, cols = np.nonzero(pairs)
    return _exchanged(len(pairs), rows, cols, pairs[rows, cols], classes, sweeps)


def _exchanged(n: int, rows: np.ndarray, cols: np.ndarray, times: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """exchange() of the pairs (rows, cols), which are met `times`."""
    times = times.astype(float)
    freq = np.bincount(cols, times, n)
    order = np.argsort(-freq[:-1], kind="stable")
    k = max(2, min(classes, n))
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(n - 1) % (k - 1)
    to = np.bincount(rows * k + cls[cols], times, n * k).reshape(n, k)
    frm = np.bincount(cols * k + cls[rows], times, n * k).reshape(n, k)
    m = np.bincount(cls[rows] * k + cls[cols], times, k * k).reshape(k, k)
    own = np.zeros(n)
    own[rows[rows == cols]] = times[rows == cols]
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    row_at, col_at = np.searchsorted(rows[by_row], np.arange(n + 1)), np.searchsorted(cols[by_col], np.arange(n + 1))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, s = cls[w], own[w]
            r, l = to[w].copy(), frm[w].copy()
            r[a] -= s
            l[a] -= s
            if not r.any() and not l.any() and not s:
                continue
            m[a, :] -= r
            m[:, a] -= l
            m[a, a] -= s
            f = _f(m)
            d = np.diag(m)
            gain = (_f(m + r[None, :]) - f).sum(axis=1) + (_f(m + l[:, None]) - f).sum(axis=0)
            gain -= _f(d + r) - _f(d) + _f(d + l) - _f(d)
            gain += _f(d + r + l + s) - _f(d)
            # wherever the word goes, the classes before and after it keep their totals
            out, into = m.sum(axis=1) + l, m.sum(axis=0) + r
            gain -= _f(out + r.sum() + s) - _f(out) + _f(into + l.sum() + s) - _f(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b, :] += r
            m[:, b] += l
            m[b, b] += s
            if b != a:
                moved += 1
                cls[w] = b
                x, y = by_col[col_at[w] : col_at[w + 1]], by_row[row_at[w] : row_at[w + 1]]
                to[rows[x], a] -= times[x]
                to[rows[x], b] += times[x]
                frm[cols[y], a] -= times[y]
                frm[cols[y], b] += times[y]
        if not moved:
            break
    return cls


@dataclass
class BrownModel:
    v: Vocabulary
    head: np.ndarray  # counts; the last: ends
    cls: np.ndarray
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10 of an entry in its class
    group: np.ndarray  # log10 of a group's denominator
    tokens: int
    distinct: int


def _grouped(rare: DataFrame, v: Vocabulary) -> DataFrame:
    """(a, k, c, rows): of each rare word its group, its count in training and its rows."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ending, met = batch.column(1).to_numpy(zero_copy_only=False), batch.column(4)
            x = met.flatten().to_numpy(zero_copy_only=False)
            word = np.repeat(np.arange(len(ending)), 2 * np.diff(met.offsets.to_numpy()))
            code = np.stack([x // CLASSES, CLASSES + x % CLASSES], axis=1).ravel()
            k = v.likeliest(ending, word, code, np.ones(len(code)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.astype(np.int32)), batch.column(2), batch.column(3)], names=["a", "k", "c", "rows"])

    # no training word is rare and has more neighbours than a head word
    words = rare.groupBy("a").agg(F.first("g").alias("g"), F.sum("t").alias("c"), F.count("*").alias("rows"), F.collect_list(F.when(F.col("t") > 0, F.col("z").bitwiseAND((1 << _S) - 1).cast("int"))).alias("met"))
    return table(by_text(words).mapInArrow(choose, "a long, k int, c long, rows long"), "rare-words")


def fit(counted: DataFrame, v: Vocabulary) -> tuple[BrownModel, DataFrame]:
    """The model, and (b, log_counts, n, known, part): for each text with rare words, sums over them.

    The driver gets the bigrams of entries, and HEAD and GROUPS rows at most.
    """
    got = counted.filter(F.col("g") == _HEAD).groupBy("a").agg(F.sum("t").alias("t")).toArrow().to_pandas()
    head = np.zeros(len(v.head) + 1, np.int64)
    head[got["a"].to_numpy(np.int64)] = got["t"].to_numpy(np.int64)

    # rare words only: none that is frequent in training, as that would be a head word
    rare = counted.filter("g >= 0").select("a", "b", "z", *[F.col(c).cast("int").alias(c) for c in ("g", "t")])
    words = _grouped(rare, v)
    g = words.groupBy("k").agg(F.sum("c").alias("t"), F.sum((F.col("c") > 0).cast("long")).alias("v")).toArrow().to_pandas()
    # a word that is rare in training may be frequent elsewhere: the rows of such aren't shuffled
    met = table(hot_join(rare.select("a", "b", "z", "t"), words, "a", "rows").drop("a"), "rare-met")
    pairs = counted.filter(F.col("g") == _PAIR).select("a", "b", "z", F.col("t").cast("int").alias("t"))
    of = words.select("a", "k", "rows")
    pairs = hot_join(pairs, table(of.select("a", F.col("k").alias("k1"), "rows"), "rare-first"), "a", "rows").drop("a")
    pairs = table(hot_join(pairs, table(of.select(F.col("a").alias("z"), "k", "rows"), "rare-second"), "z", "rows").drop("z"), "rare-pairs")

    entry_of = F.col("k") + v.entries
    q, s = F.shiftright("z", _Q), F.shiftright("z", _S).bitwiseAND((1 << (_Q - _S)) - 1)
    size, t = F.lit(v.size).cast("long"), F.sum("t").alias("t")
    parts = [
        counted.filter(F.col("g") == _BIGRAM).groupBy("a").agg(t),
        met.filter((F.col("t") > 0) & (q > 0)).groupBy(((q - 1) * size + entry_of).alias("a")).agg(t),
        met.filter((F.col("t") > 0) & (s > 0)).groupBy((entry_of * size + s - 1).alias("a")).agg(t),
        pairs.filter("t > 0").groupBy(((F.col("k1") + v.entries) * size + entry_of).alias("a")).agg(t),
    ]
    got = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("a").agg(t).toArrow().to_pandas()
    before, after = np.divmod(got["a"].to_numpy(np.int64), v.size)
    times = got["t"].to_numpy(np.int64)
    seen, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    seen[g["k"].to_numpy(int)], kinds[g["k"].to_numpy(int)] = g["t"].to_numpy(float), g["v"].to_numpy(float)

    tokens = int(head.sum() + seen.sum())
    distinct = int((head > 0).sum() + kinds.sum())
    # a group's total is what its entry was met with
    entry = np.bincount(after, times, v.size)
    total = entry[v.entries : v.entries + GROUPS].astype(float)
    own = (v.entry < 0) & (head[:-1] > 0)
    grouped = kinds + np.bincount(v.group[own], minlength=GROUPS)
    m = BrownModel(v, head, _exchanged(v.size, before, after, times), np.zeros(0), np.zeros(0), np.zeros(0), tokens, distinct)
    m.group = np.log10(total + 0.5 * (grouped + 1))
    k = int(m.cls.max()) + 1
    onehot = np.zeros((v.size, k))
    onehot[np.arange(v.size), m.cls] = 1
    by = np.bincount(m.cls[before] * k + m.cls[after], times, k * k).reshape(k, k)
    m.transition = np.log10((by + 0.1) / (by.sum(axis=1, keepdims=True) + 0.1 * k))
    size, mass = onehot.sum(axis=0), onehot.T @ entry
    m.emission = np.log10((entry + 0.5) / (mass[m.cls] + 0.5 * size[m.cls]))
    return m, _sums(met, pairs, m)


def _sums(met: DataFrame, pairs: DataFrame, m: BrownModel) -> DataFrame:
    """(b, log_counts, n, known, part): sums over the rare words of a text; part is what they and the steps from and to them add to the model's logarithm."""
    first, cls, transition = m.v.entries, m.cls, m.transition
    word = m.emission[first : first + GROUPS] - m.group
    names = ["b", "log_counts", "n", "known", "part"]

    def step(p, q):
        return np.where((p >= 0) & (q >= 0), transition[cls[p], cls[q]], 0.0)

    def summed(b, log_counts, n, known, part) -> pa.RecordBatch:
        u, to = np.unique(b, return_inverse=True)
        sums = [np.bincount(to, x, len(u)) for x in (log_counts, n, known, part)]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[3])], names=names)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, z, c, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            q, s = (z >> _Q) - 1, (z >> _S & (1 << (_Q - _S)) - 1) - 1
            log_c = np.log10(c + 0.5)
            yield summed(b, log_c, np.ones(len(b)), c > 0, log_c + word[k] + step(q, k + first) + step(k + first, s))

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, k1, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            none = np.zeros(len(b))
            yield summed(b, none, none, none, step(k1 + first, k + first))

    schema = "b long, log_counts double, n long, known long, part double"
    both = met.select("b", "z", "c", "k").mapInArrow(of_words, schema).unionAll(pairs.select("b", "k1", "k").mapInArrow(of_pairs, schema))
    return both.groupBy("b").agg(*[F.sum(c).alias(c) for c in names[1:]])


def score(docs: DataFrame, m: BrownModel, sums: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score)."""
    v = m.v
    base_of = np.log10(m.head + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.slices(batch.column(1)):
                n = hi - lo
                x = _line(v, data, offsets, n)
                held = np.flatnonzero(x.place >= 0)
                row, place = x.row[held], x.place[held]
                counts = np.bincount(row, base_of[place], n) + base_of[-1]
                # steps from and to rare words are in their sums
                i = np.flatnonzero(~x.rare)
                s = np.bincount(x.row[i], m.emission[x.entry[i]], n)
                i = np.flatnonzero(~x.rare & ~x.after_rare)
                s += np.bincount(x.row[i], m.transition[m.cls[x.before[i]], m.cls[x.entry[i]]], n)
                i = np.flatnonzero((x.place >= 0) & (x.entry >= v.entries))
                s += np.bincount(x.row[i], base_of[x.place[i]] - m.group[x.entry[i] - v.entries], n)
                known = np.bincount(row, m.head[place] > 0, n).astype(np.int64) + int(m.head[-1] > 0)
                tail = np.bincount(x.row[x.rare], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(np.bincount(x.row, minlength=n).astype(np.int64)), pa.array(known), pa.array(tail), pa.array(counts), pa.array(s)], names=["_id", "_key", "n_tokens", "_known", "_tail", "_base", "_s"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("_key", "n_tokens", "_known", "_tail")), T.StructField("_base", T.DoubleType()), T.StructField("_s", T.DoubleType())])
    part = table(by_text(docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))).mapInArrow(run, schema), "brown-parts")
    got = spread_join(part, table(sums, "brown-sums").withColumnRenamed("b", "_key"), ["_key"], F.xxhash64("_id"), "left")
    # equal texts gave one set of rows each: what they sum to is shared out
    share = F.when(F.col("_tail") > 0, F.col("_tail") / F.col("n")).otherwise(0.0)
    rare, model = (F.coalesce(F.col(c) * share, F.lit(0.0)) for c in ("log_counts", "part"))
    known = F.coalesce(F.round(F.col("known") * share).cast("long"), F.lit(0))
    per = float(np.log10(m.tokens + 0.5 * (m.distinct + 1)))
    return got.select(F.col("_id").alias(id_col), "n_tokens", (F.col("_known") + known).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("_base") + rare - F.col("n_tokens") * per).alias("base_score"), (F.col("_s") + model).alias("score"))


def score_all(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows of docs where train holds, and score all rows."""
    known = docs.filter(F.coalesce(train, F.lit(False)))
    v = learn(known, vocabulary(known, text_col), text_col)
    counted = table(count(docs, v, train, text_col), "brown-counts")
    m, sums = fit(counted, v)
    discard(counted)
    return score(docs, m, sums, id_col, text_col)
