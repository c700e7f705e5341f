"""Near-duplicates by DartMinHash signatures over five-word shingles.

Every shingle x of weight w owns the region [0, w) x [0, inf) for each of K coordinates. Hashed darts
fall on it as a Poisson process, the same for every document: a dart is a place in the weight, a rank
and a coordinate. The signature holds, for each coordinate, the dart of least rank among those under
the document's weights, so two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. Ranks are thrown in levels of doubling width until every coordinate has a dart;
a long text is done after one level, so the work follows the number of shingles. A shingle weighs by
its letters, LIGHT at least and 1 from FULL letters on: runs of short words, which texts share by
chance, catch fewer darts.

Documents that agree in all five coordinates of a band share a bucket. They become links in two steps:

1. in every bucket all others are held against its leader by their exact set similarity. Three orders
   of leaders over the 25 bands keep a pair from depending on one leader. What is linked by then is
   one class (connected components).
2. texts of buckets that hold more than one class meet by an exact condition for a similarity of t:
   sorted from the rarest shingle on, two similar sets share a shingle among the first 1 - t of the
   larger and the first 1 - 2t/(1+t) of the smaller, and neither its place nor the sizes may leave too
   little for the overlap. Texts that share a passage but aren't similar have rare shingles of their
   own and drop out there without being paired. Those that are left are held against the most central
   text of their group first, then against all texts that aren't in their class by now, so a group of
   near copies costs its rows, and the pairs of the few that no central text links.

Both steps are the same at every size, and the second one loses no link that a bucket holds. What is
probabilistic is sharing a bucket: a pair at a similarity of exactly 0.8 shares one with a probability
of 0.99995, or 0.992 if all its common shingles weigh LIGHT and all others 1.

Null and empty texts are copies of each other. A text of one to four words is one shingle. Rows that
share an id are one document. A row of null id belongs to the class of the rows with its text; if no
row with an id has that text, its class is null. Other columns aren't touched, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import arrowtext as at
from quillspark.llm.components import components
from quillspark.llm.store import by_text, fresh, spread_join, table

SHINGLE = 5
BANDS, ROWS = 25, 5
K = BANDS * ROWS
SIMILARITY = 0.8
#: Width of the first level of ranks; level j > 0 covers [FIRST * 2**(j-1), FIRST * 2**j).
FIRST = 1 / 128
LEVELS = 24
ORDERS = 3
#: Weight of a shingle of few letters, and the letters from which on it weighs 1.
LIGHT, FULL = 0.6, 30
#: Texts of one class of sizes differ by less than this factor.
SIZES = 1.05
#: Documents in shared buckets up to which their ids are broadcast to the scan that fetches their texts.
BROADCAST_NODES = 500_000
#: Rows of a group of the second step that one task holds against others, about.
PER_TASK = 2_000
#: What rounding may take from a bound.
_E = 1e-6
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-12 and k < mean * 4 + 60:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


_TABLES = {min(w, 64.0): _poisson(K * min(w, 64.0)) for w in [FIRST] + [FIRST * 2 ** (j - 1) for j in range(1, 10)]}


def _throw(x: np.ndarray, level: int, cell: np.ndarray):
    """(element, coordinate, rank within the level as 40 bits, place in the weight cell) of the darts in one unit of weight."""
    width = FIRST * 2.0 ** max(0, level - 1)
    cdf = _TABLES.get(width)
    if cdf is None:
        cdf = _TABLES[width] = _poisson(K * width)
    seed = at.mix(x + np.uint64(0x9E3779B97F4A7C15) * (np.uint64(level + 1) + cell.astype(np.uint64) * np.uint64(64)))
    count = np.searchsorted(cdf, (seed >> np.uint64(11)) * (1.0 / (1 << 53)), "right")
    hit = np.flatnonzero(count)
    count = count[hit]
    which = np.repeat(hit, count)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    d = at.mix(seed[which] + np.uint64(0xD1B54A32D192ED03) * (turn + 1).astype(np.uint64))
    place = (at.mix(d ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) * (1.0 / (1 << 53))
    return which, ((d & np.uint64(0xFFFFF)) % np.uint64(K)).astype(np.int64), d >> np.uint64(20), place


def signatures(row: np.ndarray, h: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    """rows x K: the least dart of each coordinate; all ones where a row has no shingle.

    weight: of each element, 1 if absent; an element of a row must then be listed once.
    """
    sig = np.full(rows * K, _EMPTY, np.uint64)
    open_rows = np.zeros(rows, bool)
    open_rows[row] = True
    r, x, w = row, h, weight
    for level in range(LEVELS):
        if not len(r):
            break
        cells = [(np.arange(len(x)), np.zeros(len(x), np.int64))] if w is None else [(np.flatnonzero(w > c), c) for c in range(int(np.ceil(w.max())))]
        for own, c in cells:
            cell = c if isinstance(c, np.ndarray) else np.full(len(own), c)
            which, coordinate, rank, place = _throw(x[own], level, cell)
            which = own[which]
            if w is not None:
                under = (c if not isinstance(c, np.ndarray) else 0) + place < w[which]
                which, coordinate, rank = which[under], coordinate[under], rank[under]
            np.minimum.at(sig, r[which] * K + coordinate, (np.uint64(level) << np.uint64(44)) | rank)
        full = (sig.reshape(rows, K) != _EMPTY).all(axis=1)
        left = ~full[r]
        r, x = r[left], x[left]
        w = None if w is None else w[left]
    return sig.reshape(rows, K)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    part = sig.reshape(len(sig), BANDS, ROWS)
    for j in range(ROWS):
        acc = at.mix(acc * np.uint64(0xD6E8FEB86659FD93) + part[:, :, j])
    return acc


def weights(letters: np.ndarray) -> np.ndarray:
    """Weight of each shingle by its letters (bytes of its words)."""
    return np.clip(letters / FULL, LIGHT, 1.0)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _t1, _t2, _bands): two hashes of the text, and the hashes of its bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.slices(batch.column(3)):
                n = hi - lo
                row, start, end, h = at.words(data, offsets)
                srow, sh, letters = at.shingles(row, h, n, SHINGLE, end - start)
                bands = band_hashes(signatures(srow, sh, n, weights(letters))).view(np.int64)
                has = np.bincount(srow, minlength=n) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, n) for i in range(3)), lists], names=["_id", "_t1", "_t2", "_bands"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), text.alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_t1", T.LongType()), T.StructField("_t2", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    return by_text(rows).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, _key, _set): the different shingles of (node, _text), once for each different text of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.slices(batch.column(1)):
                row, _, _, h = at.words(data, offsets)
                srow, sh = at.shingles(row, h, hi - lo, SHINGLE)
                order = np.lexsort((sh, srow))
                srow, sh = srow[order], sh[order]
                keep = np.ones(len(sh), bool)
                keep[1:] = (sh[1:] != sh[:-1]) | (srow[1:] != srow[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(srow[keep], minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sh[keep].view(np.int64)))], names=["node", "_key", "_set"])

    schema = T.StructType([T.StructField("node", texts.schema["node"].dataType), T.StructField("_key", T.LongType()), T.StructField("_set", T.ArrayType(T.LongType()))])
    return by_text(texts.select("node", "_text", F.xxhash64("_text").alias("_key"))).mapInArrow(run, schema).dropDuplicates(["node", "_key"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that reach it; a hot side of many pairs is dealt over tasks."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("_set").alias(f"_set_{c}"))
    d = spread_join(pairs, side("a"), ["a"], F.xxhash64("b"))
    d = spread_join(d, side("b"), ["b"], F.xxhash64("a"))
    small, large = F.least(F.size("_set_a"), F.size("_set_b")), F.greatest(F.size("_set_a"), F.size("_set_b"))
    d = d.filter(small >= similarity * large)
    both = F.size(F.array_intersect("_set_a", "_set_b"))
    d = d.select("a", "b", (both / (small + large - both)).alias("similarity"))
    return d.filter(F.col("similarity") >= similarity)


def _with_class(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """nodes with _class: the root of the class, or the node itself where it has no link."""
    own = classes.select("node", F.col("root").alias("_class"))
    return nodes.join(own.hint("merge"), "node", "left").withColumn("_class", F.coalesce("_class", "node"))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, _n, _own, _list) of the sets that may reach the similarity with another one of them.

    Shingles are sorted from the rarest on, by the number of the sets that hold them. _own of the _n are
    in no other set and come first; _list goes on from there to the last place where a partner of the
    least size, `similarity` of this one's, can still be met.
    """
    tokens = table(sets.select("node", "_key", F.size("_set").alias("_n"), F.explode("_set").alias("_x")), "dart-shingles")
    held = tokens.groupBy("_x").agg(F.count("*").alias("_df")).filter("_df > 1")
    d = spread_join(tokens, held, ["_x"], F.xxhash64("node")).groupBy("node", "_key").agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_df", "_x"))).alias("_list"))
    d = d.select("node", "_n", (F.col("_n") - F.size("_list")).alias("_own"), "_list")
    most = F.floor((1 - similarity) * F.col("_n") + _E).cast("int") + 1 - F.col("_own")
    return table(d.filter(most > 0).withColumn("_list", F.transform(F.slice("_list", 1, F.greatest(most, F.lit(1))), lambda e: e["_x"])), "dart-prefixes")


def _meetings(prefix: DataFrame, classes: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(visitors, homes): rows (_x, _c, node, _class, _n, _own, _rest) by shingle and class of sizes.

    Of a pair, the smaller text is at home in the class of its size, and the larger one visits the
    classes that a partner may be in. _rest: shingles from this one on, which bound the overlap; it must
    be t/(1+t) of both sizes at least.
    """
    rows = _with_class(prefix, classes).select("node", "_class", "_n", "_own", F.posexplode("_list").alias("_i", "_x"))
    rows = rows.withColumn("_rest", F.col("_n") - F.col("_own") - F.col("_i")).drop("_i")
    size_class = lambda n: F.floor(F.log(n) / math.log(SIZES)).cast("int")
    top = F.least(F.col("_n"), F.floor(F.col("_rest") * ((1 + t) / t) - F.col("_n") + _E))
    low = F.ceil(t * F.col("_n") - _E)
    visitors = rows.filter(top >= low).withColumn("_c", F.explode(F.sequence(size_class(low), size_class(top))))
    homes = rows.filter(F.col("_rest") >= 2 * t / (1 + t) * F.col("_n") - _E).withColumn("_c", size_class(F.col("_n")))
    return visitors, homes


def central_pairs(visitors: DataFrame, homes: DataFrame) -> DataFrame:
    """(a, b): every row with the row at home in its group that has the fewest shingles of its own, if of another class."""
    best = homes.groupBy("_x", "_c").agg(F.min_by(F.struct("node", "_class"), F.struct(F.col("_own") / F.col("_n"), "node")).alias("_best"), F.min("_class").alias("_l"), F.max("_class").alias("_g"))
    d = table(visitors.unionByName(homes).select("_x", "_c", "node", "_class"), "dart-meeting")
    d = spread_join(d, best, ["_x", "_c"], F.xxhash64("node")).filter("_class <> _best._class")
    return table(d.select(F.greatest("node", "_best.node").alias("a"), F.least("node", "_best.node").alias("b")).distinct(), "dart-pairs")


def rest_pairs(visitors: DataFrame, homes: DataFrame, t: float) -> DataFrame:
    """(a, b): all pairs of different classes that may reach the similarity t.

    The rows of the most frequent class of a group aren't held against each other.
    """
    key = ["_x", "_c"]
    every = visitors.select(*key, "_class", F.lit(0).alias("_home")).unionAll(homes.select(*key, "_class", F.lit(1).alias("_home")))
    per = every.groupBy(*key, "_class").agg(F.count("*").alias("_m"), F.max("_home").alias("_home"))
    per = per.groupBy(*key).agg(F.max_by("_class", F.struct("_m", "_class")).alias("_major"), F.count("*").alias("_k"), F.sum("_m").alias("_m"), F.max("_home").alias("_home"))
    per = table(per.filter("_k > 1 and _home = 1").select(*key, "_major", "_m"), "dart-mixed")
    visitors, homes = (table(spread_join(x, per, key, F.xxhash64("node")), "dart-meeting") for x in (visitors, homes))
    own = ("node", "_class", "_n", "_rest")

    def meet(few: DataFrame, many: DataFrame, few_visits: bool) -> DataFrame:
        """Rows of a group, beyond PER_TASK of them, are dealt over tasks, and the few sent to each."""
        parts = F.floor(F.col("_m") / PER_TASK) + 1
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(*key, "_salt", *(F.col(c).alias(f"{c}_f") for c in own))
        many = many.withColumn("_salt", F.pmod(F.xxhash64("node"), parts)).select(*key, "_salt", *(F.col(c).alias(f"{c}_m") for c in own))
        v, h = ("f", "m") if few_visits else ("m", "f")
        on = many.join(few.hint("merge"), [*key, "_salt"])
        fits = (F.col(f"_n_{h}") <= F.col(f"_n_{v}")) & (F.col(f"_n_{h}") >= t * F.col(f"_n_{v}") - _E)
        left = F.least("_rest_f", "_rest_m") >= t / (1 + t) * (F.col("_n_f") + F.col("_n_m")) - _E
        return on.filter((F.col("_class_f") != F.col("_class_m")) & fits & left).select(F.greatest("node_f", "node_m").alias("a"), F.least("node_f", "node_m").alias("b"))

    major = F.col("_class") == F.col("_major")
    pairs = meet(visitors.filter(~major), homes, True).unionAll(meet(homes.filter(~major), visitors.filter(major), False))
    return table(pairs.distinct(), "dart-pairs")


def links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity), (node, root)): links that join all texts that a bucket shows to be similar, and their classes.

    nodes: (node, _bands), texts: (node, _text), one row a node at least. Of a class as many links are
    tested as join it, not all.
    """
    rows = nodes.select("node", F.posexplode("_bands").alias("_band", "_hash"))
    # the bucket's leader is the least by one of ORDERS hashes of the node
    rows = rows.select("node", "_hash", F.xxhash64("node", F.pmod("_band", F.lit(ORDERS))).alias("_order"))
    lead = rows.groupBy("_hash").agg(F.min_by("node", F.struct("_order", "node")).alias("leader"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    shared = table(spread_join(rows, lead, ["_hash"], F.xxhash64("node")).select("node", "_hash", "leader"), "dart-buckets")
    wanted = table(shared.select("node").distinct(), "dart-wanted")
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    body = texts.join(F.broadcast(wanted) if few else wanted.hint("merge"), "node", "left_semi")
    sets = table(shingle_sets(body), "dart-sets")
    pairs = table(shared.filter("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct(), "dart-pairs")
    first = table(similar(pairs, sets, similarity), "dart-links")
    classes = table(components(first.select("a", "b")), "dart-classes")
    own = _with_class(shared.select("node", "_hash"), classes)
    mixed = own.groupBy("_hash").agg(F.min("_class").alias("_l"), F.max("_class").alias("_g")).filter("_l <> _g").select("_hash")
    open_nodes = table(spread_join(shared.select("node", "_hash"), mixed, ["_hash"], F.xxhash64("node")).select("node").distinct(), "dart-open")
    prefix = prefixes(sets.join(open_nodes.hint("merge"), "node", "left_semi"), similarity)
    found = [first]
    for pairs_of in (central_pairs, lambda v, h: rest_pairs(v, h, similarity)):
        more = table(similar(pairs_of(*_meetings(prefix, classes, similarity)), sets, similarity), "dart-links")
        # the classes so far are stars about their roots
        stars = classes.select(F.col("node").alias("a"), F.col("root").alias("b"))
        classes = table(components(stars.unionAll(more.select("a", "b"))), "dart-classes")
        found.append(more)
    return functools.reduce(DataFrame.unionAll, found), classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, copy_of), a row for each row of docs.

    class_id: least id of the class; copy_of: least id of the rows with the same text.
    """
    rows = table(signed(docs, id_col, text_col), "dart-signatures")
    # of a hot group of copies the map side keeps one row each
    nodes = rows.groupBy("_t1", "_t2").agg(F.min("_id").alias("node"), F.first("_bands").alias("_bands"))
    nodes = table(nodes.filter("node is not null"), "dart-nodes")
    member = table(spread_join(rows.select("_id", "_t1", "_t2"), nodes.select("_t1", "_t2", "node"), ["_t1", "_t2"], F.xxhash64("_id"), "left").select("_id", F.coalesce("node", "_id").alias("node")), "dart-members")
    # an id with several texts joins their nodes
    several = member.filter("_id is not null").distinct()
    least = several.groupBy("_id").agg(F.min("node").alias("_first"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    same = table(several.join(least.hint("merge"), "_id").select(F.col("node").alias("a"), F.col("_first").alias("b")).distinct(), "dart-same-id")
    texts = docs.select(F.col(id_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    _, classes = links(nodes.select("node", "_bands"), texts, similarity)
    if not same.isEmpty():
        classes = table(components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(same)), "dart-classes")
    out = spread_join(member, classes, ["node"], F.xxhash64("_id"), "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("root", "node").alias("class_id"), F.col("node").alias("copy_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that aren't the least id of their class; all columns stay, whatever their names.

    Of rows that share a kept id one stays, the least by a hash of the text. Of rows of null id one of
    each text stays, if no row with an id has that text.
    """
    keep, h1, h2, row, least = fresh(docs.columns, "_keep", "_h1", "_h2", "_row", "_least")
    classes = near_duplicates(docs.select(id_col, text_col), id_col, text_col, similarity)
    ids = table(classes.filter(F.col(id_col) == F.col("class_id")).groupBy(F.col(id_col).alias(keep)).agg(F.count("*").alias(least)), "dart-keep")
    kept = docs.join(ids.select(keep).hint("merge"), F.col(id_col) == F.col(keep), "left_semi")
    repeated = ids.filter(F.col(least) > 1).select(keep)
    if not repeated.isEmpty():
        own = kept.join(repeated.hint("merge"), F.col(id_col) == F.col(keep), "left_semi").select(F.struct(*docs.columns).alias(row), F.col(id_col).alias(keep), F.xxhash64(text_col).alias(least))
        own = own.groupBy(keep).agg(F.min_by(row, least).alias(row)).select(f"{row}.*")
        kept = kept.join(repeated.hint("merge"), F.col(id_col) == F.col(keep), "left_anti").unionAll(own)
    nameless = docs.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return kept
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = (F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), text).alias(h2))
    known = docs.filter(F.col(id_col).isNotNull()).select(*hashes).distinct()
    lone = nameless.select("*", *hashes).dropDuplicates([h1, h2]).join(known.hint("merge"), [h1, h2], "left_anti")
    return kept.unionByName(lone.select(*docs.columns))
