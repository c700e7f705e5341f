"""The source registry: catalog, retrieval settings and enrichment policy; causes of payloads that aren't what they should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markers
from quillspark.functions import text as fn

#: Fixed values.
TYPES = ("rss", "sitemap", "hub", "sitemap+hub", "url-set", "url-set+hub", "instagram")
EXTRACTORS = ("generic", "json-ld-first")
MODES = ("auto", "force_on", "force_off")
_ARRAYS = ("sitemaps", "hub_pages")
_TEXTS = ("type", "policy", "extractor", "hub", "link_pattern", "sitemap_pattern", "username", "content_mode", "image_text")


def source_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, language, cadence, enrichment, retrieval) of a registry file, in its order.

    The file is one JSON array. Entries that aren't objects or have no name are left out; nested
    settings stay JSON strings, so that a wrong type in one entry spoils no other.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    rows = raw.select(F.posexplode("a").alias("ordinal", "e"))
    g = lambda k: F.get_json_object("e", f"$.{k}")
    rows = rows.select("ordinal", F.trim(g("name")).alias("name"), fn.normalize_language(g("language")).alias("language"), F.nullif(F.trim(g("cadence")), F.lit("")).alias("cadence"), g("enrichment").alias("enrichment"), g("retrieval").alias("retrieval"))
    return rows.filter(F.coalesce("name", F.lit("")) != "")


def _positive(value: Column, default: int) -> Column:
    n = F.when(value.rlike(r"^\d{1,9}$"), value.cast("int"))
    return F.when(n > 0, n).otherwise(default)


def enrichment_policy(catalog: DataFrame) -> DataFrame:
    """(name, threshold, mode): a positive threshold, else 500; a known mode, else auto."""
    g = lambda k: F.get_json_object("enrichment", f"$.{k}")
    return catalog.select("name", _positive(g("threshold"), fn.THIN).alias("threshold"), F.when(g("mode").isin(*MODES), g("mode")).otherwise("auto").alias("mode"))


def retrieval_config(catalog: DataFrame, max_urls: int = 50) -> DataFrame:
    """The settings that the jobs use, defaults filled in and invalid values dropped."""
    g = lambda k: F.get_json_object("retrieval", f"$.{k}")
    text = lambda k: F.nullif(F.trim(g(k)), F.lit(""))
    listed = lambda c: F.filter(F.transform(F.from_json(c, "array<string>"), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    kind = F.when(g("type").isin(*TYPES), g("type")).otherwise("rss")
    excludes = F.when(F.ltrim(g("sitemap_exclude")).startswith("["), g("sitemap_exclude")).otherwise(F.to_json(F.array(g("sitemap_exclude"))))
    none = F.array().cast("array<string>")
    return catalog.select(
        "name",
        kind.alias("type"),
        F.when(g("extractor").isin(*EXTRACTORS), g("extractor")).otherwise("generic").alias("extractor"),
        *[F.coalesce(listed(g(k)), none).alias(k) for k in _ARRAYS],
        *[text(k).alias(k) for k in ("hub", "link_pattern", "sitemap_pattern", "username")],
        F.when(g("sitemap_exclude").isNull(), none).otherwise(F.coalesce(listed(excludes), none)).alias("sitemap_exclude"),
        (F.coalesce(g("id_guard"), F.lit("")) == "true").alias("id_guard"),
        _positive(g("max_urls"), max_urls).alias("max_urls"),
        F.when((kind == "instagram") & (g("image_text") == "extract"), "extract").otherwise("ignore").alias("image_text"),
    )


def sitemap_challenges(landing: DataFrame) -> DataFrame:
    """(source, url, cause) of landed sitemaps that are block pages or no markup at all."""
    head = F.regexp_replace("body", r"^[\x{FEFF}\s\x00]+", "")
    root = F.lower(F.substring(head, 1, 1024)).rlike("<(urlset|sitemapindex)")
    marker = markers.which(F.col("body"), markers.CHALLENGE, 65536)
    cause = F.when(root, F.lit(None)).when(marker.isNotNull(), F.concat(F.lit("challenge: block page (marker "), marker, F.lit(")"))).when(~head.startswith("<"), "challenge: not XML")
    return landing.select("source", "url", cause.alias("cause")).filter("cause is not null")


def diagnose_hubs(landing: DataFrame, links: DataFrame) -> DataFrame:
    """(source, url, cause) of landed hub pages that gave no link; links: rows of hub_links."""
    none = landing.join(links.select("url").distinct().hint("merge"), "url", "left_anti")
    anchors, md = F.regexp_count("html", F.lit(r"(?i)<a[^>]+href=")), F.regexp_count("html", F.lit(r"\[[^\]]*\]\("))
    marker = markers.which(F.col("html"), markers.CHALLENGE, 4096)
    plain = F.format_string("no links matched (anchors %d, markdown links %d)", anchors, md)
    wall = (anchors == 0) & (md == 0) & ~F.col("html").rlike("<[A-Za-z!/]")
    return none.select("source", "url", F.when(marker.isNotNull(), F.concat(F.lit("challenge: block page (marker "), marker, F.lit(")"))).when(wall, "challenge: not HTML").otherwise(plain).alias("cause"))
