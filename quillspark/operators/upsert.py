"""The exact three-key upsert: a document is stored unless its address, canonical address or content is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rows import fresh, written

KEYS = ("url", "canonical_url", "content_hash")
#: Keys that may be broadcast as hot ones, at most.
HOT_KEYS = 100_000


@dataclass
class Upserted:
    """inserted and skipped have the columns of the input; rounds: how many it took to decide all rows."""

    inserted: DataFrame
    skipped: DataFrame
    rounds: int

    def __iter__(self):
        return iter((self.inserted, self.skipped))


def _heads(held: DataFrame) -> DataFrame:
    """Of every key (kind, value) the first undecided row: tasks send one row a key, however hot."""
    first = F.min(F.struct("at", "row", "keys"))
    return held.groupBy("kind", "value").agg(first.alias("h"), F.max("hot").alias("hot")).select("kind", "value", "hot", "h.row", "h.keys")


def _holding(held: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows that hold a taken key (kind, value, hot). Hot keys are broadcast, so their rows stay where they lie."""
    key = ["kind", "value"]
    hot = held.filter("hot").join(F.broadcast(taken.filter("hot").select(key)), key, "left_semi")
    rest = held.filter("not hot").join(taken.filter("not hot").select(key).hint("merge"), key, "left_semi")
    return hot.select("row").unionAll(rest.select("row")).distinct()


def upsert_documents(new: DataFrame, stored: DataFrame | None, ordinal: str = "ordinal", keys: tuple[str, ...] = KEYS) -> Upserted:
    """(inserted, skipped): what inserting one row after the other, in the order of `ordinal`, would give.

    Rows of the same ordinal come in the order of their keys, and rows alike in these in an order that is
    fixed once: one of them is stored. A null ordinal comes first; a null key is no key, and a row without
    any is stored. `new` is written once, with a number for each row; `stored` may be null.

    Rows are decided in rounds over (key, row) pairs. Of every key only the first undecided row, its head, is
    a candidate; it wins if it is the head of all its keys. Rows that hold a key of a winner are out, and
    those block none. So a key that many rows share costs a row a task and round, and all its rows go at
    once when it is taken; the pairs of hot keys (over 1/HOT_KEYS of all pairs, so fewer than HOT_KEYS
    keys) aren't shuffled at all. Two rounds are enough where rows share keys with winners only; a chain in
    which every row shares a key with the next takes one round for each two of its rows.
    """
    (row,) = fresh(new.columns, "_row")
    every = written(new.withColumn(row, F.monotonically_increasing_id()), "upsert-rows")
    order = F.struct(F.col(ordinal), *[F.col(k).cast("string") for k in keys])
    pairs = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)]), lambda p: p["value"].isNotNull())
    held = every.select(F.col(row).alias("row"), order.alias("at"), F.size(pairs).alias("keys"), F.explode(pairs).alias("p")).select("row", "at", "keys", "p.kind", "p.value")
    held = written(held, "upsert-pairs")
    most = max(1000, held.count() // HOT_KEYS)
    hot = written(held.groupBy("kind", "value").count().filter(F.col("count") > most).select("kind", "value", F.lit(True).alias("hot")), "upsert-hot")
    held = held.join(F.broadcast(hot), ["kind", "value"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    held = written(held, "upsert-held")

    if stored is not None:
        heads = written(_heads(held), "upsert-heads")
        known = [stored.select(F.lit(i).alias("kind"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)]
        taken = [heads.filter(F.col("kind") == i).join(d.filter("value is not null").hint("merge"), ["kind", "value"], "left_semi") for i, d in enumerate(known)]
        out = taken[0]
        for d in taken[1:]:
            out = out.unionAll(d)
        held = written(held.join(_holding(held, written(out, "upsert-known")).hint("merge"), "row", "left_anti"), "upsert-held")

    # rows without a key are stored
    won = [every.filter(F.size(pairs) == 0).select(F.col(row).alias("row"))]
    rounds = 0
    while not held.isEmpty():
        rounds += 1
        heads = written(_heads(held), "upsert-heads")
        winners = written(heads.groupBy("row").agg(F.count("*").alias("n"), F.max("keys").alias("keys")).filter("n = keys").select("row"), "upsert-won")
        won.append(winners)
        taken = heads.join(winners.hint("merge"), "row", "left_semi")
        held = written(held.join(_holding(held, taken).hint("merge"), "row", "left_anti"), "upsert-held")
    rows = won[0]
    for d in won[1:]:
        rows = rows.unionAll(d)
    rows = written(rows.select(F.col("row").alias(row)), "upsert-inserted").hint("merge")
    return Upserted(every.join(rows, row, "left_semi").select(new.columns), every.join(rows, row, "left_anti").select(new.columns), rounds)


def guard_sources(new: DataFrame, sources: DataFrame, source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(known, rejected): rows of a source that isn't registered are rejected."""
    names = sources.select(F.col("name").alias(source_col)).distinct()
    rejected = new.join(names, source_col, "left_anti").withColumn("reject_reason", F.lit("unknown source"))
    return new.join(names, source_col, "left_semi"), rejected


def quarantine(docs: DataFrame, already: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): documents without a source go aside, once."""
    out = docs.filter(F.col("source_id").isNull())
    if already is not None:
        out = out.join(already.select("id"), "id", "left_anti")
    return docs.filter(F.col("source_id").isNotNull()), out.withColumn("reason", F.lit("no source"))
