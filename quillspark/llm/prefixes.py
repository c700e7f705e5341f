"""The prefix trie of rebuilt conversations, with a count-min screen of prefix digests.

A conversation c is rebuilt of the first h turns of conversation c - c % 100 and its own turns from h + 1
on; h is the CRC-32 of c as text, modulo 6. Each different sequence of the first d turns is a node.

1. Of a turn only its order, a 128-bit digest of role and text and its length go on. Turns are ranged by
   conversation and order, so a conversation that holds most rows is numbered by many tasks; only what
   the ends of ranges need is broadcast, two conversations a range at most.
2. Turns are gathered in chunks of CHUNK, a row each. Every turn's digest is hashed with its depth, and the
   digest of a prefix is the exclusive or of those of its turns: chunks are worked out apart and put
   together by their totals.
3. Digests are counted in a sketch of two rows of cells. Its width follows the number of prefixes up to
   MOST_CELLS a row, which bounds what is broadcast (a bit a cell: counted twice or not). An estimate of one
   proves that a prefix, and every longer one of that conversation, is that conversation's alone: its
   nodes are emitted where they lie. Where the sketch is full it proves less, and more is shuffled; the
   result is the same.
4. Only the other prefixes are shuffled and grouped exactly, by 128-bit digest and depth. A node belongs to
   its smallest member. Sums over subtrees are sums over members: a node's members hold, for each node below
   it, that node's owner. So each conversation carries the sums of what it owns from each depth on.

Nodes that many conversations pass are met by salted joins and pre-aggregated groupings. The ids of those
that end at a node are joined in blocks of their value, and hashed as a stream.

Turns are ordered by turn (null first), then by the digest of role and text; equal rows are interchangeable.
Null roles and texts count as empty. Rows of a null conversation are left out. A conversation whose turns
all fall away ends at the root. Other columns aren't touched. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrowtext import mix
from quillspark.llm.store import by_text, spread_join, table

#: Conversations that share the head of one, and the most turns of a head.
FAMILY, HEADS = 100, 6
#: Turns of a chunk.
CHUNK = 1024
#: Cells of a row of the sketch: at least two for each prefix, from LEAST_CELLS up to MOST_CELLS; 16 MB a row are broadcast then.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27
#: Cells whose counts are put together in one row, and prefixes that a task counts before it hands them on.
BLOCK, HELD = 1 << 16, 1 << 22
#: Values of ids that are joined into one text before a node's ends meet.
IDS = 4096
KEY = ["depth", "x1", "x2"]


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, m, n): the digest and the length of each turn, ranged by conversation and order; seg is the range."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    m = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), m.alias("m"), F.length(text).alias("n"))
    rows = table(rows, "trie-turns")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(rows.repartitionByRange(ranges, "conv", F.col("turn").asc_nulls_first(), "m").withColumn("seg", F.spark_partition_id()), "trie-ranges")


def placed(ranged: DataFrame, of: Column | None = None) -> DataFrame:
    """(conv, pos, m, n): each turn's place in its conversation, from 1; those of some conversations only where `of` is given."""
    ends = ranged.groupBy("seg").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi"))
    split = ends.select(F.explode(F.array("lo", "hi")).alias("conv")).groupBy("conv").agg(F.count("*").alias("_ends"))
    # at most two conversations of a range go on beyond it
    counts = ranged.join(F.broadcast(split), "conv", "left_semi").groupBy("conv", "seg").agg(F.count("*").alias("turns"))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv", "seg", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("offset")).filter("offset > 0")
    own = Window.partitionBy("seg", "conv").orderBy(F.col("turn").asc_nulls_first(), "m")
    rows = (ranged if of is None else ranged.filter(of)).withColumn("rn", F.row_number().over(own))
    return rows.join(F.broadcast(offsets), ["conv", "seg"], "left").select("conv", (F.col("rn") + F.coalesce("offset", F.lit(0))).alias("pos"), "m", "n")


def chunks(ranged: DataFrame) -> DataFrame:
    """(conv, chunk, own, head): the turns of each chunk and the head of the family, as lists of (pos, m, n)."""
    turn = F.struct("pos", "m", "n")
    rows = placed(ranged).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("long"))
    own = table(rows.groupBy("conv", "chunk").agg(F.collect_list(turn).alias("own")), "trie-chunks")
    first = placed(ranged, F.col("conv") % FAMILY == 0).filter(F.col("pos") < HEADS)
    heads = first.groupBy(F.col("conv").alias("family")).agg(F.collect_list(turn).alias("head"))
    own = own.withColumn("family", F.col("conv") - F.col("conv") % FAMILY)
    begin = own.filter("chunk = 0").join(heads.hint("merge"), "family", "left")
    rest = spread_join(own.filter("chunk > 0"), heads, ["family"], F.xxhash64("conv", "chunk"), "left")
    return begin.unionByName(rest).drop("family")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, digests as two unsigned longs, n) of a column of lists of turns."""
    counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    m = flat.field(1)
    digests = np.frombuffer(b"".join(m.to_pylist()), "<u8").reshape(-1, 2)
    return np.repeat(np.arange(len(column)), counts), np.asarray(flat.field(0), np.int64), digests, np.asarray(flat.field(2), np.int64)


def head_length(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % HEADS


def _prefixes(batch: pa.RecordBatch, size: int) -> tuple:
    """(depth of each row's first turn, offsets of the rows, digests of prefixes within the row, n)."""
    conv = batch.column(0).to_pylist()
    chunk = np.asarray(batch.column(1), np.int64)
    h = np.array([head_length(c) for c in conv], np.int64)
    row, pos, digest, n = _lists(batch.column(2))
    hrow, hpos, hdigest, hn = _lists(batch.column(3))
    used = hpos <= h[hrow]
    heads = np.bincount(hrow[used], minlength=len(conv))
    used &= chunk[hrow] == 0
    kept = pos > h[row]
    row, place = np.concatenate([hrow[used], row[kept]]), np.concatenate([hpos[used] - HEADS, pos[kept]])
    digest, n = np.concatenate([hdigest[used], digest[kept]]), np.concatenate([hn[used], n[kept]])
    order = np.lexsort((place, row))
    row, digest, n = row[order], digest[order], n[order]
    first = np.where(chunk == 0, 1, heads + chunk * size + 1 - h)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(conv)))])
    depth = (first[row] + np.arange(len(row)) - offsets[row]).astype(np.uint64)
    sums = []
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        x = mix(mix(digest[:, k] ^ (depth * np.uint64(salt))) + digest[:, 1 - k])
        upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)]) if len(x) else np.zeros(1, np.uint64)
        sums.append((upto[1:] ^ upto[offsets[:-1]][row], upto[offsets[1:]] ^ upto[offsets[:-1]]))
    return first, offsets, sums, n


_LONGS = T.ArrayType(T.LongType())


def digests(chunked: DataFrame) -> DataFrame:
    """(conv, chunk, first, x1, x2, n, o1, o2, ended, spread): prefixes of each chunk.

    o1 and o2 are the digest of all that comes before the chunk, still to be put into x1 and x2; `ended`:
    whether the conversation ends in the chunk; `spread`: whether it has several.
    """
    names = {"conv": T.LongType(), "chunk": T.LongType(), "first": T.LongType(), "x1": _LONGS, "x2": _LONGS, "n": _LONGS, "t1": T.LongType(), "t2": T.LongType(), "full": T.BooleanType()}
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, offsets, ((x1, t1), (x2, t2)), n = _prefixes(batch, size)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in (x1.view(np.int64), x2.view(np.int64), n)]
            full = np.asarray(batch.column(2).value_lengths()) == size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), *lists, pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(full)], names=list(names))

    schema = T.StructType([T.StructField(k, v) for k, v in names.items()])
    rows = table(by_text(chunked.select("conv", "chunk", "own", "head")).mapInArrow(run, schema), "trie-digests")
    several = (F.col("chunk") > 0) | F.col("full")
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.filter(several).select("conv", "chunk", *(F.coalesce(F.bit_xor(f"t{k}").over(before), F.lit(0).cast("long")).alias(f"o{k}") for k in (1, 2)), (F.col("chunk") == F.max("chunk").over(Window.partitionBy("conv"))).alias("ended"))
    own = ["conv", "chunk", "first", "x1", "x2", "n"]
    long = rows.filter(several).select(own).join(totals.hint("merge"), ["conv", "chunk"]).withColumn("spread", F.lit(True))
    zero = F.lit(0).cast("long")
    short = rows.filter(~several).select(*own, zero.alias("o1"), zero.alias("o2"), F.lit(True).alias("ended"), F.lit(False).alias("spread"))
    return short.unionByName(long)


# --- the sketch


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x1, x2, counts of rows) of columns x1, x2, o1, o2, what comes before put in."""
    counts = np.asarray(batch.column(0).value_lengths(), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    x = [np.asarray(batch.column(k).flatten(), np.int64) ^ np.asarray(batch.column(k + 2), np.int64)[row] for k in (0, 1)]
    return row, x[0], x[1], counts


def sketch(prefixes: DataFrame, cells: int) -> list[np.ndarray]:
    """For each row of the sketch, a bit for each cell: whether it was counted twice or more."""
    per = cells // BLOCK
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def handed() -> pa.RecordBatch:
            blocks, parts = [], []
            for k in (0, 1):
                x, times = np.unique(np.concatenate([h[k] for h in held]) & (cells - 1), return_counts=True)
                x = np.repeat(x, np.minimum(times, 2))  # more than two count as two
                block = x // BLOCK
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                blocks += (block[edges] + k * per).tolist()
                parts += [p.astype("<u2").tobytes() for p in np.split(x % BLOCK, edges[1:])] if len(x) else []
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], names=["block", "cells"])

        for batch in batches:
            _, x1, x2, _ = _whole(batch)
            held.append((x1, x2))
            n += len(x1)
            if n >= HELD:
                yield handed()
                held, n = [], 0
        if held:
            yield handed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.bincount(np.frombuffer(part, "<u2"), minlength=BLOCK)
                counts[block] = np.minimum(counts.get(block, 0) + new, 2).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(c == 2, bitorder="little").tobytes() for c in counts.values()], pa.binary())], names=["block", "cells"])

    parts = by_text(prefixes.select("x1", "x2", "o1", "o2")).mapInArrow(count, schema)
    bits = np.zeros((2 * per, BLOCK // 8), np.uint8)
    for r in parts.repartition("block").mapInArrow(add, schema).toLocalIterator():
        bits[r.block] = np.frombuffer(r.cells, np.uint8)
    return list(bits.reshape(2, -1))


def screened(prefixes: DataFrame, bits: list[np.ndarray], cells: int) -> DataFrame:
    """(conv, chunk, first, x1, x2, n, o1, o2, spread, alone, size).

    x1, x2 and n reach up to the first prefix that is proved to be its conversation's alone, whose depth is
    `alone` (one more than the conversation's depth if there is none); size is the conversation's depth.
    """
    names = {"conv": T.LongType(), "chunk": T.LongType(), "first": T.LongType(), "x1": _LONGS, "x2": _LONGS, "n": _LONGS, "o1": T.LongType(), "o2": T.LongType(), "spread": T.BooleanType(), "alone": T.LongType(), "size": T.LongType()}
    sent = prefixes.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x1, x2, counts = _whole(batch)
            first, ended = np.asarray(batch.column(7), np.int64), np.asarray(batch.column(9))
            shared = np.ones(len(row), bool)
            for x, plane in zip((x1, x2), sent.value, strict=True):
                at = x & (cells - 1)
                shared &= (plane[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            begin = np.cumsum(counts) - counts
            place = np.arange(len(row)) - begin[row]
            kept = counts.copy()
            np.minimum.at(kept, row[~shared], place[~shared])
            use = place < kept[row]
            offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[use])) for v in (x1, x2, np.asarray(batch.column(4).flatten(), np.int64))]
            last = first + counts - 1
            alone = pa.array(first + kept, pa.int64(), mask=(kept == counts))
            yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(6), batch.column(7), *lists, batch.column(2), batch.column(3), batch.column(8), alone, pa.array(last, pa.int64(), mask=~ended)], names=list(names))

    schema = T.StructType([T.StructField(k, v) for k, v in names.items()])
    rows = table(by_text(prefixes.select("x1", "x2", "o1", "o2", "n", "conv", "chunk", "first", "spread", "ended")).mapInArrow(run, schema), "trie-screened")
    every = Window.partitionBy("conv")
    over = {c: F.when(F.col("spread"), f(c).over(every)).otherwise(F.col(c)) for c, f in (("alone", F.min), ("size", F.max))}
    one = rows.filter(~F.col("spread")).unionByName(rows.filter("spread").withColumns(over))
    return one.withColumn("alone", F.coalesce("alone", F.col("size") + 1))


# --- exact grouping of what may be shared


def _ends(ids: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) from (depth, x1, x2, conv): ids rising, comma-joined, hashed as a stream."""
    blocks = ids.groupBy(*KEY, F.floor(F.col("conv") / IDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("part"))
    schema = T.StructType([T.StructField("depth", T.LongType()), T.StructField("x1", T.LongType()), T.StructField("x2", T.LongType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        done: list[tuple] = []

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            for *new, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if new != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = new, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            if len(done) > 10_000:
                yield handed()
        if key is not None:
            done.append((*key, sha.hexdigest()))
        yield handed()

    return table(blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "part").mapInArrow(run, schema), "trie-ends")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_cells: int = MOST_CELLS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    ranged = turns(conversations, conv_col, turn_col, role_col, text_col)
    prefixes = digests(chunks(ranged))
    root = prefixes.agg(F.min("conv").alias("conv"), F.sum((F.col("chunk") == 0).cast("long")).alias("n"), F.coalesce(F.sum(F.size("n").cast("long")), F.lit(0)).alias("prefixes")).collect()[0]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    long = lambda x: F.lit(x).cast("long")
    top = F.lit(root.conv).cast("long")
    cells = LEAST_CELLS
    while cells < min(2 * root.prefixes, most_cells):
        cells *= 2
    rows = screened(prefixes, sketch(prefixes, cells), cells)

    # tails: nodes that are one conversation's alone; the topmost is emitted below, where its parent is known
    flat = table(rows.select("conv", "chunk", "alone", "size").filter("chunk = 0 and (alone <= size or size = 0)"), "trie-tails")
    empty = F.sha2(F.lit(""), 256)
    sha = lambda ends: F.when(ends, F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty)
    # long tails a piece of CHUNK depths at a time, so that no row makes an endless list
    tails = flat.filter("size > 0").select("conv", "alone", "size", F.explode(F.sequence("alone", "size", long(CHUNK))).alias("low"))
    tails = tails.select("conv", "alone", "size", F.explode(F.sequence("low", F.least("size", F.col("low") + CHUNK - 1))).alias("depth")).filter("depth > alone or depth = 1")
    more = F.col("depth") < F.col("size")
    tails = tails.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, top).otherwise(F.col("conv")).alias("parent_conv_id"), long(1).alias("n_convs"), more.cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), sha(~more).alias("ends_sha256"))

    # members of the nodes that may be shared, and for each later chunk the node above its first
    kept = F.least(F.size("x1").cast("long"), F.greatest(F.col("alone") - F.col("first"), long(0)))
    shared = rows.withColumn("kept", kept.cast("int")).filter("kept > 0")
    own = ["conv", "chunk", "spread", "alone", "size"]
    members = shared.select(*own, "first", F.posexplode(F.slice(F.arrays_zip("x1", "x2", "n"), F.lit(1), F.col("kept"))).alias("k", "p"))
    members = members.select(*own, (F.col("first") + F.col("k")).alias("depth"), "p.x1", "p.x2", "p.n", F.lit(False).alias("above"))
    above = shared.filter("chunk > 0").select(*own, (F.col("first") - 1).alias("depth"), F.col("o1").alias("x1"), F.col("o2").alias("x2"), long(0).alias("n"), F.lit(True).alias("above"))
    members = table(members.unionByName(above), "trie-members")
    ends = ~F.col("above") & (F.col("depth") == F.col("size"))
    nodes = members.filter("not above").groupBy(KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.sum(ends.cast("long")).alias("n_ends"))
    nodes = table(nodes, "trie-nodes")
    met = spread_join(members, nodes, KEY, F.xxhash64("conv", "chunk"))

    path = Window.partitionBy("conv", "chunk").orderBy("depth")
    every, earlier = Window.partitionBy("conv", "chunk"), path.rowsBetween(Window.unboundedPreceding, -1)
    owned = F.col("owner") == F.col("conv")
    met = met.withColumn("saves", F.when(owned & ~F.col("above"), (F.col("n_convs") - 1) * F.col("n")).otherwise(long(0)))
    leaf = (F.col("alone") <= F.col("size")) | (ends & owned & (F.col("n_ends") == F.col("n_convs")))
    tailed = ~F.col("above") & (F.col("depth") + 1 == F.col("alone")) & (F.col("alone") <= F.col("size"))
    met = met.select(
        *own, *KEY, "above", "owner",
        F.coalesce(F.sum("saves").over(earlier), long(0)).alias("upto"),
        F.sum("saves").over(every).alias("all"),
        F.max(leaf.cast("long")).over(every).alias("leaf"),
        F.when(F.col("depth") == 1, top).otherwise(F.lag("owner").over(path)).alias("parent"),
        F.when(tailed, long(1)).otherwise(F.coalesce(F.lead(owned.cast("long")).over(path), long(0))).alias("child"),
        tailed.alias("tailed"),
    )
    met = table(met, "trie-met")
    # of conversations of several chunks: what their other chunks hold
    parts = met.filter("spread").groupBy("conv", "chunk").agg(F.max("all").alias("part"), F.max("leaf").alias("part_leaf"))
    by = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = table(parts.select("conv", "chunk", F.coalesce(F.sum("part").over(by), long(0)).alias("before"), F.sum("part").over(Window.partitionBy("conv")).alias("whole"), F.max("part_leaf").over(Window.partitionBy("conv")).alias("any_leaf")), "trie-parts")
    spread = met.filter("spread").join(parts.hint("merge"), ["conv", "chunk"])
    spread = spread.withColumn("below", F.col("whole") - F.col("before") - F.col("upto")).withColumn("leaf", F.col("any_leaf"))
    single = met.filter("not spread").withColumn("below", F.col("all") - F.col("upto"))
    columns = [*own, *KEY, "above", "owner", "parent", "child", "leaf", "below"]
    met_all = single.select(columns).unionByName(spread.select(columns))

    real = ~F.col("above")
    groups = met_all.groupBy(KEY).agg(
        F.min(F.when(real, F.col("conv"))).alias("conv_id"),
        F.min(F.when(real, F.col("parent"))).alias("parent_conv_id"),
        F.sum(real.cast("long")).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum(F.when(real, F.col("leaf")).otherwise(long(0))).alias("n_leaves"),
        F.sum(F.when(real, F.col("below")).otherwise(long(0))).alias("saved_tokens"),
    )
    # the root: what its children hold, and those that are alone from the first turn on
    first = met_all.filter(real & (F.col("depth") == 1)).select(owned.cast("long").alias("child"), "leaf", "below")
    first = first.unionAll(flat.filter("alone = 1 and size > 0").select(long(1), long(1), long(0)))
    n = {c: F.coalesce(F.sum(c), long(0)) for c in ("child", "leaf", "below")}
    above_all = first.agg(n["child"].alias("n_children"), F.greatest(n["leaf"], long(1)).alias("n_leaves"), n["below"].alias("saved_tokens"))
    above_all = above_all.select(long(0).alias("depth"), long(0).alias("x1"), long(0).alias("x2"), top.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), long(root.n or 0).alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    groups = groups.unionByName(above_all.filter(F.lit(bool(root.n))))

    last = members.filter(ends).select(*KEY, "conv").unionAll(flat.filter("size = 0").select(long(0), long(0), long(0), "conv"))
    groups = groups.join(_ends(last).hint("merge"), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    # the topmost node of a tail, below its shared parent
    heads = met.filter("tailed").withColumn("depth", F.col("depth") + 1)
    heads = heads.select(F.col("conv").alias("conv_id"), "depth", F.col("owner").alias("parent_conv_id"), long(1).alias("n_convs"), more.cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), sha(~more).alias("ends_sha256"))
    return groups.select(names).unionByName(heads.select(names)).unionByName(tails.select(names))


#: The rows of the op11 query, for DuckDB. A node's key is the digests of its turns, so its ancestors' are prefixes of it.
ORACLE_SQL = """
WITH t AS MATERIALIZED (SELECT conv_id AS c, md5(length(r)::VARCHAR || ':' || r || x) AS m, length(x) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x)) AS p
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) a),
h AS MATERIALIZED (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM t) d),
head AS (SELECT h.c, b.p AS d, b.m, b.n FROM h JOIN t b ON b.c = h.c - h.c % 100 AND b.p <= h.h),
e AS (SELECT * FROM head UNION ALL SELECT t.c, coalesce(k.k, 0) + t.p - h.h, t.m, t.n FROM t JOIN h ON h.c = t.c LEFT JOIN (SELECT c, count(*) AS k FROM head GROUP BY c) k ON k.c = t.c WHERE t.p > h.h),
k AS MATERIALIZED (SELECT c, d, n, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS key FROM e UNION ALL SELECT c, 0, 0, '' FROM h),
s AS MATERIALIZED (SELECT c, max(d) AS size FROM k GROUP BY c),
v AS MATERIALIZED (SELECT d, key, min(k.c) AS owner, count(*) AS n_convs, max(n) AS n, string_agg(k.c::VARCHAR, ',' ORDER BY k.c) FILTER (size = d) AS ends FROM k JOIN s ON s.c = k.c GROUP BY d, key),
ch AS (SELECT d - 1 AS d, left(key, (32 * (d - 1))::BIGINT) AS key, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch ON ch.d = v.d AND ch.key = v.key),
a AS (SELECT g.up AS d, left(u.key, (32 * g.up)::BIGINT) AS key, sum((u.n_convs - 1) * u.n) AS saved, count(*) FILTER (u.n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM u) g JOIN u ON u.d = g.d AND u.key = g.key GROUP BY 1, 2)
SELECT u.owner AS conv_id, u.d::BIGINT AS depth, p.owner AS parent_conv_id, u.n_convs, u.n_children, a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
  FROM u JOIN a ON a.d = u.d AND a.key = u.key LEFT JOIN v p ON p.d = u.d - 1 AND p.key = left(u.key, greatest(32 * (u.d - 1), 0)::BIGINT)
"""
