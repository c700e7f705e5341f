"""Benchmark passages in documents, found by latent semantic retrieval.

The features are the benchmark's own terms (words, lower-cased, without punctuation), as no other term
can add to a cosine with a benchmark item. Three passes read every document whole:

1. collection counts of the terms give their IDF; terms of more than `common` of all words are left out;
2. a randomised SVD: with M the TF-IDF rows of all 64-word passages and of the items (both halves
   weighing the same), M'(M W) is summed over the cluster for a random W, and the leading right singular
   vectors are worked out from that one sum (Nystrom's way for a product M'M);
3. windows of four 16-word blocks, one at each block, meet the items in the latent space, an item longer
   than a window as a whole and by its window-sized pieces; a cosine of `cosine` or more makes a candidate,
   which is checked at once: the longest common subsequence of the item's words and those of the span
   where the whole item would lie, with half a window or half the item to each side, must hold `overlap`
   of the item's words, and the item's answer, where the benchmark has an answer column, must stand there
   or next to it. An item whose first `least` words stand in a document is a candidate in any case.

IDF and basis are fitted once over all items and are sent to every task, with the items themselves in blocks
of at most ITEMS_A_BLOCK, each a pass over the rows: what is found doesn't depend on how many items there
are, nor on the size of a block. Null and empty
documents have no item, null and empty items are in no document. Items of fewer than `least` words are
matched as they are, but only in full. Repeated rows are treated alike; other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm import arrowtext as at
from quillspark.llm.store import by_text

RANK = 64
BLOCK = 16
WINDOW = 4
COSINE = 0.5
OVERLAP = 0.65
COMMON = 0.003
LEAST = 8
#: Items sent to the tasks at once: 50,000 items of 50 words are some 35 MB with their latent vectors. A longer
#: item counts as one for each ITEM_CHARACTERS. Beside them go 270 bytes for each different word of all items.
ITEMS_A_BLOCK = 50_000
ITEM_CHARACTERS = 512
#: Cosines worked out at once.
COSINES = 1 << 23


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  # hashes of each item's words
    answers: list[np.ndarray]
    terms: np.ndarray  # sorted hashes of all
    sieve: np.ndarray  # which low 20 bits any term has


def _term_words(data, offsets):
    return at.words(data, offsets, at.NOT_TERM, lower=True)


def _hashed(texts: list) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in at.slices(pa.array(texts, pa.string())):
        row, _, _, h = _term_words(data, offsets)
        out += np.split(h, np.searchsorted(row, np.arange(1, hi - lo)))
    return out


def prepare(rows: list) -> Items:
    """rows: (id, text, answer or None)."""
    words, answers = _hashed([r[1] for r in rows]), _hashed([r[2] for r in rows])
    terms = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    sieve = np.zeros(1 << 20, bool)
    sieve[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return Items([r[0] for r in rows], words, answers, terms, sieve)


def _find(items: Items, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h, term numbers) of the words that are terms."""
    p = np.flatnonzero(items.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    if not len(p) or not len(items.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = np.minimum(np.searchsorted(items.terms, h[p]), len(items.terms) - 1)
    ok = items.terms[t] == h[p]
    return p[ok], t[ok]


def idf(docs: DataFrame, items: Items, text_col: str = "text", common: float = COMMON) -> np.ndarray:
    """Weight of each term from the counts over all documents; 0 for common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(items.terms), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in at.slices(batch.column(0)):
                _, _, _, h = _term_words(data, offsets)
                n += len(h)
                count += np.bincount(_find(items, h)[1], minlength=len(count))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(count[seen], n))], names=["term", "n"])

    got = by_text(docs.select(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r[0]: r[1] for r in got}  # as many rows as the benchmark has terms
    n = max(by.pop(-1, 0), 1)
    c = np.zeros(len(items.terms))
    c[list(by)] = list(by.values())
    per = n / (BLOCK * WINDOW)
    return np.where(c > common * n, 0.0, np.log1p(per / np.maximum(np.minimum(c, per), 1.0))).astype(np.float32)


def _pieces(items: Items) -> list[tuple[int, int, int]]:
    """(item, start, end) of what meets the windows: each item, and the pieces of one longer than a window."""
    size, out = BLOCK * WINDOW, []
    for i, w in enumerate(items.words):
        out.append((i, 0, len(w)))
        if len(w) > size:
            out += [(i, min(k, len(w) - size), min(k, len(w) - size) + size) for k in range(0, len(w), size)]
    return out


def _piece_rows(items: Items, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, TF-IDF of length 1) of each piece."""
    for i, a, e in _pieces(items):
        t, n = np.unique(_find(items, items.words[i][a:e])[1], return_counts=True)
        x = n * weight[t]
        yield t, (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)


def basis(docs: DataFrame, items: Items, weight: np.ndarray, text_col: str = "text", rank: int = RANK, seed: int = 5) -> np.ndarray:
    """terms x rank at most: the leading right singular vectors, near enough."""
    v = len(weight)
    rank = min(rank, max(v, 1))
    omega = np.random.default_rng(seed).standard_normal((v, rank)).astype(np.float32)
    passage = BLOCK * WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((v, rank)), 0
        for batch in batches:
            for _, _, data, offsets in at.slices(batch.column(0)):
                row, _, _, h = _term_words(data, offsets)
                p, t = _find(items, h)
                keep = weight[t] > 0
                p, t = p[keep], t[keep]
                if not len(p):
                    continue
                first = np.searchsorted(row, row[p])
                key = row[p] * (1 << 32) + (p - first) // passage
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                which = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
                x = weight[t]
                norm = np.sqrt(np.add.reduceat(x * x, start))
                x = x / norm[which]
                y = np.add.reduceat(x[:, None] * omega[t], start, axis=0)
                order = np.argsort(t, kind="stable")
                ts = t[order]
                s = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
                total[ts[s]] += np.add.reduceat(x[order, None] * y[which[order]], s, axis=0)
                rows += len(start)
        seen = np.flatnonzero(np.abs(total).sum(axis=1))
        values = np.vstack([total[seen], np.full((1, rank), float(rows))])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), *(pa.array(values[:, j]) for j in range(rank))], names=["term", *(f"c{j}" for j in range(rank))])

    schema = "term long, " + ", ".join(f"c{j} double" for j in range(rank))
    got = by_text(docs.select(text_col)).mapInArrow(run, schema).groupBy("term").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(rank))).collect()
    g, rows = np.zeros((v, rank)), 0.0
    for r in got:  # terms x rank numbers
        if r[0] == -1:
            rows = r[1]
        else:
            g[r[0]] = r[1:]
    share = max(rows, 1.0) / max(len(_pieces(items)), 1)
    for t, x in _piece_rows(items, weight):
        g[t] += share * np.outer(x, x @ omega[t])
    return singular_vectors(g, omega)[0].astype(np.float32)


def singular_vectors(g: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of M and its singular values, from g = M'(M omega) of one pass.

    M'M is near g (omega'g)^-1 g'; a shift that is taken off again keeps the middle factor definite.
    """
    if not g.any():
        return np.zeros((len(g), 1)), np.zeros(1)
    shift = 1e-7 * np.linalg.norm(g)
    g = g + shift * omega
    middle = omega.T.astype(float) @ g
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    keep = values > 1e-12 * values.max()
    u, s, _ = np.linalg.svd(g @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    s = np.sqrt(np.maximum(s * s - shift, 0.0))
    keep = s > 1e-6 * s[0]
    return u[:, keep], s[keep]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a word of bits for each of b's words."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        y = masks.get(x)
        if y:
            u = row & y
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _mixed(t: np.ndarray) -> np.ndarray:
    """A hash of each row of term numbers."""
    acc = np.zeros(len(t), np.uint64)
    for j in range(t.shape[1]):
        acc = at.mix(acc * np.uint64(0xD6E8FEB86659FD93) + t[:, j].astype(np.uint64))
    return acc


def _within(small: np.ndarray, large: np.ndarray) -> bool:
    n = len(small)
    return n == 0 or any((large[i : i + n] == small).all() for i in np.flatnonzero(large[: max(0, len(large) - n + 1)] == small[0]))


def _searcher(items: Items, weight: np.ndarray, q: np.ndarray, cosine: float, overlap: float, least: int):
    """A function of an Arrow column: for each row, {item: overlap}."""
    pieces = _pieces(items)
    latent = np.zeros((len(pieces), q.shape[1]), np.float32)
    for j, (t, x) in enumerate(_piece_rows(items, weight)):
        latent[j] = x @ q[t]
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.where(norm > 1e-6, latent / np.maximum(norm, 1e-9), 0).astype(np.float32)
    whole = {i: j for j, (i, _, _) in reversed(list(enumerate(pieces)))}
    project = (weight[:, None] * q).astype(np.float32)
    #: items without a latent vector, or too short for one, are looked up by their first word
    plain = [i for i, w in enumerate(items.words) if len(w) and (len(w) < least or norm[whole[i], 0] <= 1e-6)]
    plain_first = {int(items.words[i][0]): [j for j in plain if items.words[j][0] == items.words[i][0]] for i in plain}
    plain_key = np.array(sorted(plain_first), np.uint64)
    side = BLOCK * WINDOW // 2
    #: all others by their first words, as numbers of terms
    begin = [(i, _find(items, w[:least])[1]) for i, w in enumerate(items.words) if len(w) >= max(least, 1)]
    is_first = np.zeros(len(items.terms), bool)
    by_begin: dict[int, list[int]] = {}
    for i, t in begin:
        is_first[t[0]] = True
        by_begin.setdefault(int(_mixed(t[None, :])[0]), []).append(i)
    begin_key = np.array(sorted(by_begin), np.uint64)
    chunk = min(4096, max(1, COSINES // max(len(pieces), 1)))

    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def check(found: list[dict], h: np.ndarray, first: np.ndarray, r: int, i: int, a: int, e: int) -> None:
        """Hold item i against the words a to e of row r, unless they lie in words it was held against."""
        a, e = max(int(first[r]), int(a)), min(int(first[r + 1]), int(e))
        spans = seen.setdefault((int(r), i), [])
        if any(x <= a and e <= y for x, y in spans):
            return
        spans.append((a, e))
        w, answer = items.words[i], items.answers[i]
        share = common_subsequence(w, h[a:e]) / len(w)
        if share >= overlap and share > found[r].get(i, 0.0):
            if _within(answer, h[max(first[r], a - len(answer)) : min(first[r + 1], e + len(answer))]):
                found[r][i] = share

    def search(column: pa.Array) -> list[dict]:
        out: list[dict] = []
        for lo, hi, data, offsets in at.slices(column):
            n = hi - lo
            row, _, _, h = _term_words(data, offsets)
            count = np.bincount(row, minlength=n)
            first = np.concatenate([[0], np.cumsum(count)])
            blocks = -(-count // BLOCK) + WINDOW - 1
            base = np.concatenate([[0], np.cumsum(blocks)])
            found: list[dict] = [{} for _ in range(n)]
            seen.clear()
            p, t = _find(items, h)
            if len(begin_key) and len(p) >= least:
                x = np.flatnonzero(is_first[t[: len(t) - least + 1]])
                x = x[(p[x + least - 1] == p[x] + least - 1) & (row[p[x + least - 1]] == row[p[x]])]
                key = _mixed(t[x[:, None] + np.arange(least)])
                for k in np.flatnonzero(np.isin(key, begin_key)):
                    at_word = int(p[x[k]])
                    r = row[at_word]
                    for i in by_begin[int(key[k])]:
                        w, slack = items.words[i], max(side, len(items.words[i]) // 2)
                        if found[r].get(i, 0.0) < 0.999:
                            check(found, h, first, r, i, at_word - slack, at_word + max(len(w), BLOCK * WINDOW) + slack)
            keep = weight[t] > 0
            p, t = p[keep], t[keep]
            if len(p):
                b = base[row[p]] + WINDOW - 1 + (p - first[row[p]]) // BLOCK
                start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                z = np.zeros((base[-1] + WINDOW, q.shape[1]), np.float32)
                z[b[start]] = np.add.reduceat(project[t], start, axis=0)
                z = sum(z[k : k + base[-1]] for k in range(WINDOW))
                size = np.linalg.norm(z, axis=1)
                live = np.flatnonzero(size > 1e-6)
                for c in range(0, len(live), chunk):
                    own = live[c : c + chunk]
                    near = (z[own] @ latent.T) >= cosine * size[own, None]
                    for k, j in zip(*np.nonzero(near), strict=True):
                        r = int(np.searchsorted(base, own[k], "right")) - 1
                        i, o, end = pieces[j]
                        length = len(items.words[i])
                        if found[r].get(i, 0.0) >= 0.999 or length < least:
                            continue
                        at_word = first[r] + (own[k] - base[r] - WINDOW + 1) * BLOCK
                        slack = max(side, length // 2)
                        # a window may be any part of a long item that is like it as a whole
                        before = length if end - o > BLOCK * WINDOW else o
                        after = length if end - o > BLOCK * WINDOW else max(length - o - BLOCK * WINDOW, 0)
                        check(found, h, first, r, i, at_word - before - slack, at_word + BLOCK * WINDOW + after + slack)
            if len(plain_key):
                for x in np.flatnonzero(np.isin(h, plain_key)):
                    for i in plain_first[int(h[x])]:
                        w = items.words[i]
                        if x + len(w) <= first[row[x] + 1] and (h[x : x + len(w)] == w).all():
                            found[row[x]][i] = 1.0
            out += found
        return out

    return search


def _search(rows: DataFrame, search, ids: list, item_type: T.DataType, keep_text: bool) -> DataFrame:
    """rows (id, text, found) with the items that `search` finds added to found; row by row, whatever the ids."""
    kind = to_arrow_type(_found(item_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(2).to_pylist()
            new = [[{"item": ids[i], "overlap": float(s)} for i, s in sorted(f.items())] for f in search(batch.column(1))]
            found = pa.array([b + f for b, f in zip(before, new, strict=True)], kind)
            text = batch.column(1) if keep_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, found], names=["id", "text", "found"])

    return by_text(rows).mapInArrow(run, rows.schema)


def _found(item_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item", item_type), T.StructField("overlap", T.DoubleType())]))


def _items(benchmark: DataFrame, item_id: str, item_text: str, answer_col: str | None) -> tuple[Items, list[Items]]:
    """All items, which the driver holds, and the same in blocks; the blocks have the terms of all."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    bench = benchmark.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), answer.alias("a"))
    rows = sorted((tuple(r) for r in bench.collect()), key=lambda r: (r[0], r[1]))
    every = prepare(rows)
    sizes = np.array([max(1, -(-len(r[1]) // ITEM_CHARACTERS)) for r in rows], np.int64)
    block = (np.cumsum(sizes) - sizes) // ITEMS_A_BLOCK
    parts = []
    for k in np.unique(block):
        which = np.flatnonzero(block == k).tolist()
        parts.append(Items([every.ids[i] for i in which], [every.words[i] for i in which], [every.answers[i] for i in which], every.terms, every.sieve))
    return every, parts


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None, cosine: float = COSINE, overlap: float = OVERLAP, least: int = LEAST) -> DataFrame:
    """docs without the rows that hold an item; no shuffle, all columns as they were."""
    items, parts = _items(benchmark, item_id, item_text, answer_col)
    weight = idf(docs, items, text_col)
    q = basis(docs, items, weight, text_col)
    place = docs.columns.index(text_col)
    out = docs
    for part in parts:
        search = _searcher(part, weight, q, cosine, overlap, least)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not f for f in search(batch.column(place))], pa.bool_()))

        out = by_text(out).mapInArrow(run, docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None, cosine: float = COSINE, overlap: float = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, contaminated, n_items, item_ids, best_overlap), a row for each row of docs, repeated and null ids included."""
    items, parts = _items(benchmark, item_id, item_text, answer_col)
    kind = benchmark.schema[item_id].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(_found(kind)).alias("found"))
    weight = idf(rows, items)
    q = basis(rows, items, weight)
    for part in parts:  # the last doesn't hand the texts back
        rows = _search(rows, _searcher(part, weight, q, cosine, overlap, least), part.ids, kind, part is not parts[-1])
    ids = F.transform("found", lambda x: x["item"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["overlap"])), F.lit(0.0))
    return rows.select(F.col("id").alias(id_col), (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.sort_array(ids).alias("item_ids"), best.alias("best_overlap"))
