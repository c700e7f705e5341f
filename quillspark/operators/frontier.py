"""The discovery frontier: which addresses of each source to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.sources.feeds import archive_fresh

DEPTH = 2
MAX_URLS = 50


def path_excluded(path: Column, excludes: Column) -> Column:
    """A part of the path, or all of it where an exclude is written ^...$."""
    whole = lambda e: e.startswith("^") & e.endswith("$") & (F.length(e) > 2)
    return F.exists(F.coalesce(excludes, F.array().cast("array<string>")), lambda e: F.when(whole(e), path == F.regexp_replace(e, r"^\^|\$$", "")).otherwise((e != "") & F.contains(path, e)))


def url_kept(loc: Column, include: Column, excludes: Column) -> Column:
    path = fn.path_of(loc)
    return F.contains(path, F.coalesce(include, F.lit(""))) & ~path_excluded(path, excludes)


def child_rank(loc: Column, pattern: Column) -> Column:
    """Place of the pattern in the path; those without it come last."""
    at = F.instr(fn.path_of(loc), F.coalesce(pattern, F.lit("")))
    return F.when(F.coalesce(pattern, F.lit("")) == "", 0).otherwise(F.when(at > 0, at).otherwise(1 << 30))


def within_budget(visits: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """Visits (source, visit, n) begun before `most` addresses were collected."""
    w = Window.partitionBy("source").orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)
    return visits.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("_before") < most).drop("_before")


def newest_urls(df: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """The newest addresses of each source, undated last; the first of each canonical address."""
    d = df.withColumn("canonical_url", fn.canonicalize_url(F.col("loc")))
    first = Window.partitionBy("source", "canonical_url").orderBy(F.desc_nulls_last("lastmod"), "pos")
    d = d.withColumn("_t", F.row_number().over(first)).filter("_t = 1").drop("_t")
    turn = Window.partitionBy("source").orderBy(F.desc_nulls_last("lastmod"), "pos", "canonical_url")
    return d.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= most)


def walk(sitemaps: DataFrame, config: DataFrame, depth: int = DEPTH, now: Column | None = None) -> DataFrame:
    """(source, sitemap, visit): sitemaps reachable from each source's roots, in the order of a depth-first walk.

    sitemaps: rows of parse_sitemaps; config: (source, roots array, sitemap_pattern[, excludes]). Excluded
    children are left out, but an archive of the last 60 days before `now` is walked all the same. A node's place is
    the array of ranks from its root; children are taken by where the pattern stands, then those that stand
    last in their file first, so the walk depends on the files alone.
    Levels are expanded one by one, the first path to a sitemap winning; trees are small.
    """
    excludes = F.col("excludes") if "excludes" in config.columns else F.array().cast("array<string>")
    kids = sitemaps.filter("kind = 'sitemap'").join(config.select("source", "sitemap_pattern", excludes.alias("_ex")).hint("merge"), "source")
    fresh = archive_fresh(F.col("loc"), F.current_date() if now is None else now)
    kids = kids.filter(~path_excluded(fn.path_of(F.col("loc")), F.col("_ex")) | fresh).drop("_ex")
    turn = Window.partitionBy("source", "sitemap").orderBy(child_rank(F.col("loc"), F.col("sitemap_pattern")), F.desc("pos"), "loc")
    kids = kids.withColumn("_rank", F.row_number().over(turn).cast("int")).select("source", F.col("sitemap").alias("_parent"), "loc", "_rank")
    level = config.select("source", F.posexplode("roots").alias("_r", "sitemap")).withColumn("path", F.array("_r")).drop("_r")
    every = level
    for _ in range(depth):
        nxt = level.join(kids.hint("merge"), (level["sitemap"] == kids["_parent"]) & (level["source"] == kids["source"])).select(level["source"], F.col("loc").alias("sitemap"), F.concat("path", F.array("_rank")).alias("path"))
        level = nxt.groupBy("source", "sitemap").agg(F.min("path").alias("path"))
        every = every.unionAll(level)
    every = every.groupBy("source", "sitemap").agg(F.min("path").alias("path"))
    return every.withColumn("visit", F.row_number().over(Window.partitionBy("source").orderBy("path"))).drop("path")


def frontier(sitemaps: DataFrame, hubs: DataFrame, config: DataFrame, most: int = MAX_URLS, now: Column | None = None) -> DataFrame:
    """(source, loc, lastmod, rank): sitemap addresses within the budget, then hub links that aren't among them.

    config: (source, roots, sitemap_pattern, link_pattern, excludes); hubs: (source, link, pos).
    """
    urls = sitemaps.filter("kind = 'url'").join(config.select("source", "link_pattern", "excludes").hint("merge"), "source")
    urls = urls.filter(url_kept(F.col("loc"), F.col("link_pattern"), F.col("excludes"))).select("source", "sitemap", "pos", "loc", "lastmod")
    visits = walk(sitemaps, config, now=now).join(urls.groupBy("source", "sitemap").agg(F.count("*").alias("n")).hint("merge"), ["source", "sitemap"], "left").fillna(0, ["n"])
    taken = urls.join(within_budget(visits, most).select("source", "sitemap", "visit").hint("merge"), ["source", "sitemap"])
    # in the order of the walk, then of the file
    from_map = taken.select("source", "loc", "lastmod", (F.col("visit").cast("long") * (1 << 32) + F.col("pos")).alias("pos"))
    canon = fn.canonicalize_url(F.col("loc"))
    hub = hubs.select("source", F.col("link").alias("loc"), F.lit(None).cast("timestamp").alias("lastmod"), (F.lit(1 << 61) + F.col("pos")).alias("pos")).withColumn("_c", canon)
    known = from_map.select("source", canon.alias("_c")).distinct()
    return newest_urls(from_map.unionByName(hub.join(known.hint("merge"), ["source", "_c"], "left_anti").drop("_c")), most).drop("pos")
