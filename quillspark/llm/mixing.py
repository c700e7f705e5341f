"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

A source's target is its share of the whole in words, by weight, but not above `most` times its
size; what that leaves is shared again among the others. With f = target / size, every document gets
floor(f) whole copies. Of the fraction p = f - floor(f), a sample without replacement takes documents
in the order of q = odds(u) / odds(p), u being a uniform number hashed from the id, until the words
taken come nearest to the target: Pareto sampling, with inclusion probabilities that differ between
sources (and, with a weight column, between the documents of one).

The order is found in two steps, so that no source is sorted in one task: words are summed in `bins`
ranges of q, and only the range in which the target is reached is sorted row by row.

Null texts have size 0; a null source is a source, after all others. Sources of size 0 have target 0.
Rows with the same id have the same u; ties are broken by size, and equal rows are interchangeable.
An empty table gives an empty result. Result: the id, the source, size, source_size, target, copies,
taken; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.store import table

#: Ranges of the sampling order for each source.
BINS = 4096
#: Sources up to which the table of targets is broadcast; beyond, rows meet it by a salted join.
BROADCAST_SOURCES = 100_000
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long"), F.lit(0).cast("long"))


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) hashed from an id; the same on every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight under a cap of most x size."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("weight", weight).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    every = Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(by_room), F.lit(0)))
    t = t.withColumn("over", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
    # sources in the order of size over weight: the capped ones come first
    t = t.withColumn("level", F.when(F.col("ratio") > F.col("left") / F.col("over"), F.col("left") / F.col("over")))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("ratio"))).over(every)
    return t.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.coalesce(level * F.col("weight"), (most * F.col("source_size")).cast("double"))).alias("target"))


def _meet(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source; a hot source's rows are spread over 64 salts if there are too many sources to broadcast."""
    names = [c for c in per_source.columns if c != "source"]
    if few:
        right = F.broadcast(per_source.withColumnRenamed("source", "_s"))
        return rows.join(right, F.col("source").eqNullSafe(F.col("_s")), "left").select(rows.columns + names)
    right = per_source.withColumnRenamed("source", "_s").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).hint("merge")
    left = rows.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    return left.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_salt")), "left").select(rows.columns + names)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix-1:", bins: int = BINS) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(1e-9)) if weight_col else F.lit(1.0)).alias("w"))
    rows = table(sized.withColumn("u", uniform(F.col("id"), seed)), "mix-sizes")
    plan = targets(rows, most, weights)
    if weight_col:
        mean = rows.groupBy(F.col("source").alias("_m")).agg((F.sum(F.col("w") * F.col("size")) / F.sum("size")).alias("mean"))
        plan = plan.join(mean.hint("merge"), F.col("source").eqNullSafe(F.col("_m"))).drop("_m")
    else:
        plan = plan.withColumn("mean", F.lit(1.0))
    plan = table(plan, "mix-targets")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    f = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size") * F.col("w") / F.col("mean"), F.lit(float(most)))).otherwise(0.0)
    # fractions within a millionth of a whole number are whole
    whole = F.floor(f + 1e-6)
    p = F.when(f - whole < 1e-6, 0.0).otherwise(f - whole)
    r = _meet(rows, plan, few).withColumn("whole", whole.cast("long")).withColumn("p", p)
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    r = r.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q)).withColumn("bin", F.coalesce(F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"), F.lit(-1)))
    binned = r.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    open_words = F.when(F.col("bin") >= 0, F.col("words")).otherwise(0)
    binned = binned.withColumn("before", F.coalesce(F.sum(open_words).over(by_bin), F.lit(0))).withColumn("certain", F.sum("certain").over(Window.partitionBy("source")))
    need = F.col("target") - F.col("certain")
    edge = _meet(binned, plan, few).withColumn("need", need).filter((F.col("bin") >= 0) & (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
    edge = table(edge.groupBy("source").agg(F.min("bin").alias("edge"), F.min("before").alias("edge_before"), F.min("need").alias("need")), "mix-edge")
    # where the target lies beyond all words that the sample can give, it takes them all
    short = table(_meet(binned, plan, few).groupBy("source").agg((F.max("target") > F.max("certain")).alias("wants")), "mix-wants")
    r = _meet(_meet(r, edge, few), short, few)
    need = F.col("need")
    at_edge = Window.partitionBy("source", "bin").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sorted_out = r.filter("bin = edge").withColumn("upto", F.col("edge_before") + F.sum("size").over(at_edge))
    # the document that passes the target stays if that comes nearer to it
    sorted_out = sorted_out.withColumn("extra", (F.col("upto") - need <= need - (F.col("upto") - F.col("size"))).cast("long")).drop("upto")
    rest = r.filter("bin < 0 or edge is null or bin <> edge").withColumn("extra", F.when(F.col("bin") < 0, 0).when(F.col("edge").isNull(), F.col("wants").cast("int")).when(F.col("bin") < F.col("edge"), 1).otherwise(0).cast("long"))
    out = sorted_out.unionByName(rest)
    copies = F.col("whole") + F.col("extra")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: The rows of the op3 query, for DuckDB.
ORACLE_SQL = """
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM t),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
        FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(rest / share, ratio) AS level FROM l WHERE ratio > rest / share),
g AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(level * weight, (3 * source_size)::DOUBLE)) AS target FROM l, v),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS f FROM g),
h AS (SELECT *, floor(f + 1e-6)::BIGINT AS whole, CASE WHEN f - floor(f + 1e-6) < 1e-6 THEN 0.0 ELSE f - floor(f + 1e-6) END AS p FROM f),
d AS (SELECT s.*, source_size, target, whole, p, target - whole * source_size AS need,
             CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
        FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN q IS NOT NULL AND upto - need <= need - (upto - size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
  FROM c
"""
