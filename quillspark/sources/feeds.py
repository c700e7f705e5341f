"""Feeds, sitemaps and posts: landed payloads to rows, with rejects beside them."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.functions.markers import FEED_CHALLENGE, which
from quillspark.functions.rows import fixed
from quillspark.functions.text import parse_time

_TEXTS = ("title", "pubDate", "dc_date", "published", "updated", "description", "summary")
_ITEM = ", ".join([f"{c}: string" for c in _TEXTS] + ["link: array<struct<_href: string, _rel: string, _VALUE: string>>", "guid: struct<_isPermaLink: string, _VALUE: string>", "author: array<struct<name: string, _VALUE: string>>", "dc_creator: array<string>", "content: array<string>", "content_encoded: array<string>"])
#: RSS has its items in a channel or, in version 1, beside it; Atom has entries.
_FEED = f"channel struct<item: array<struct<{_ITEM}>>>, item array<struct<{_ITEM}>>, entry array<struct<{_ITEM}>>, _bad string"
_SITEMAP = "url array<struct<loc: string, lastmod: string, news: struct<publication_date: string>>>, sitemap array<struct<loc: string, lastmod: string>>, _bad string"
_POST = "shortCode string, url string, caption string, ownerUsername string, timestamp string, displayUrl string, childPosts array<struct<displayUrl: string>>"
_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*')"""
#: A name space that a start tag declares, behind the tag's name and other attributes, or behind the one before; in texts the same words stay.
_NAMESPACE = rf"""(<[A-Za-z][^\s<>/]*|\G(?!^))((?:\s+(?!xmlns[:=\s])[^\s=<>"'/]+{_VALUE})*)\s+xmlns(?::[\w.-]+)?{_VALUE}"""
#: Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def without_prefixes(xml: Column) -> Column:
    """Markup without name-space prefixes, so that one schema reads all."""
    return F.regexp_replace(F.regexp_replace(xml, r"(</?)[A-Za-z][\w.-]*:", "$1"), r'\sxmlns(:\w+)?="[^"]*"', "")


def _read(df: DataFrame, schema: str, xml: Column | None = None) -> DataFrame:
    return df.withColumn("_x", F.from_xml(without_prefixes(F.col("body")) if xml is None else xml, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def unprefixed_feed(xml: Column) -> Column:
    """Feed markup that one schema reads: prefixes are part of the names (media:title is media_title), so that
    foreign elements don't pass for the feed's own; a feed whose root has Atom's prefix loses that prefix.
    A & that begins no XML entity is text."""
    root = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*|<!.*?>\s*)*<([A-Za-z][\w.-]*):feed\b", 1)
    own = F.when(root != "", F.regexp_replace(xml, F.concat(F.lit("(</?)"), root, F.lit(":")), F.lit("$1"))).otherwise(xml)
    own = F.regexp_replace(F.regexp_replace(own, _NAMESPACE, "$1$2"), r"(</?[A-Za-z][\w.-]*):", "$1_")
    return F.regexp_replace(own, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def _feeds(landing: DataFrame) -> DataFrame:
    """landing with _x and _items, whatever the kind of feed."""
    none = F.array().cast(f"array<struct<{_ITEM}>>")
    d = _read(landing, _FEED, unprefixed_feed(F.col("body")))
    return fixed(d, "_items", F.concat(*[F.coalesce(c, none) for c in ("_x.channel.item", "_x.item", "_x.entry")]))


def _diagnosis(d: DataFrame) -> Column:
    blocked = which(F.col("body"), FEED_CHALLENGE, 65536).isNotNull()
    return F.when(F.size("_items") > 0, "ok").when(F.col("_x").isNull() | F.col("_x._bad").isNotNull(), F.when(blocked, "blocked").otherwise("unparseable")).when(blocked, "blocked").otherwise("dead")


def _own_link(i: Column) -> Column:
    """The item's address: RSS text, Atom's alternate, else any other; a permanent guid where there is none."""
    of = lambda test: F.get(F.filter(F.transform(F.filter(i["link"], test), lambda x: F.trim(F.coalesce(x["_href"], x["_VALUE"]))), lambda v: v != ""), F.lit(0))
    rel = lambda x: F.coalesce(x["_rel"], F.lit("alternate"))
    guid = F.when((F.coalesce(i["guid"]["_isPermaLink"], F.lit("true")) != "false") & i["guid"]["_VALUE"].rlike(r"^\s*https?://"), F.trim(i["guid"]["_VALUE"]))
    return F.coalesce(of(lambda x: rel(x) == "alternate"), of(lambda x: rel(x) != "self"), guid)


def parsed_feeds(landing: DataFrame) -> DataFrame:
    """All items of (source, url, body, retrieved_at), RSS or Atom, each feed read once: `cause` says why one is rejected.

    A feed without items is a row, too, with what is wrong with it.
    """
    d = _feeds(landing)
    none = F.when(F.size("_items") == 0, F.when(_diagnosis(d) == "unparseable", "unparseable").otherwise(F.concat(F.lit("empty feed: "), _diagnosis(d))))
    items = fixed(d, "_none", none).select("source", "url", "retrieved_at", "_none", F.posexplode_outer("_items").alias("item", "i"))
    i = F.col("i")
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    blocks = F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("i.content_encoded", "i.content")]), lambda x: F.coalesce(x, F.lit("")) != "")
    body = F.coalesce(F.nullif(F.array_join(blocks, "\n"), F.lit("")), full(F.col("i.summary")), full(F.col("i.description")), F.lit(""))
    author = F.coalesce(full(F.get("i.dc_creator", F.lit(0))), full(F.get("i.author", F.lit(0))["name"]), full(F.get("i.author", F.lit(0))["_VALUE"]))
    when = F.coalesce(parse_time(F.coalesce(full(F.col("i.pubDate")), full(F.col("i.published")), full(F.col("i.updated")), full(F.col("i.dc_date")))), "retrieved_at")
    items = items.select("source", F.col("url").alias("feed"), "retrieved_at", "item", "_none", fn.strip_html(F.col("i.title")).alias("title"), _own_link(i).alias("url"), author.alias("author"), when.alias("published_at"), fn.strip_html(body).alias("content"))
    items = items.withColumn("canonical_url", fn.canonicalize_url(F.col("url")))
    cause = F.when(F.col("_none").isNotNull(), F.col("_none")).when(F.coalesce("title", F.lit("")) == "", "missing title").when(F.coalesce("url", F.lit("")) == "", "missing link")
    return items.withColumn("cause", cause).drop("_none")


def parts(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of parsed feeds: items without title or link with their link as hint, and feeds without items."""
    good = parsed.filter("cause is null").drop("cause").withColumn("content_hash", fn.content_hash(F.col("title"), F.col("content")))
    return good, parsed.filter("cause is not null").select("source", F.col("feed").alias("url"), "item", F.col("url").alias("hint"), "cause")


def parse_feeds(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of (source, url, body, retrieved_at); rejects are (source, url, item, hint, cause). Whoever reads both writes parsed_feeds first."""
    return parts(parsed_feeds(landing))


def diagnose_feeds(landing: DataFrame) -> DataFrame:
    """(source, url, diagnosis, entries): ok, blocked, dead or unparseable."""
    d = _feeds(landing)
    return d.select("source", "url", _diagnosis(d).alias("diagnosis"), F.size("_items").alias("entries"))


def choose_feed(candidates: DataFrame) -> DataFrame:
    """Per source the first candidate with entries; else the last candidate's error."""
    ok = F.col("entries") > 0
    return candidates.groupBy("source").agg(F.min_by("url", F.when(ok, F.col("ordinal"))).alias("url"), F.when(F.max(ok), F.lit(None)).otherwise(F.max_by("error", "ordinal")).alias("error"))


def unpacked(landing: DataFrame) -> DataFrame:
    """landing with a binary body as text: unzipped where it begins as gzip does; null where that fails."""

    @F.pandas_udf("string")
    def text(bodies: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else (zlib.decompress(b, 31) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace")
            except zlib.error:
                return None

        return bodies.map(one)

    return landing.withColumn("body", text("body")) if dict(landing.dtypes)["body"] == "binary" else landing


def parse_sitemaps(landing: DataFrame) -> DataFrame:
    """(source, sitemap, kind, pos, loc, lastmod, cause): kind is url or sitemap, pos the place in the file; a cause instead for what is neither."""
    d = _read(unpacked(landing), _SITEMAP)
    own = ("source", F.col("url").alias("sitemap"))
    urls = d.select(*own, F.lit("url").alias("kind"), F.posexplode("_x.url").alias("pos", "u")).select("source", "sitemap", "kind", "pos", F.trim("u.loc").alias("loc"), parse_time(F.coalesce("u.lastmod", "u.news.publication_date")).alias("lastmod"))
    kids = d.select(*own, F.lit("sitemap").alias("kind"), F.posexplode("_x.sitemap").alias("pos", "u")).select("source", "sitemap", "kind", "pos", F.trim("u.loc").alias("loc"), parse_time(F.col("u.lastmod")).alias("lastmod"))
    none = d.filter(F.col("_x").isNull() | (F.col("_x.url").isNull() & F.col("_x.sitemap").isNull()))
    causes = none.select(*own, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("loc"), F.lit(None).cast("timestamp").alias("lastmod"), F.when(F.col("_x._bad").isNotNull(), "unparseable").otherwise("unknown root").alias("cause"))
    rows = urls.unionAll(kids).filter(F.coalesce("loc", F.lit("")) != "").withColumn("cause", F.lit(None).cast("string"))
    return rows.unionAll(causes)


def map_posts(posts: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Documents of (source, payload, retrieved_at), the payload being a post's JSON; with the payload itself if it is to be kept."""
    d = posts.withColumn("p", F.from_json("payload", _POST))
    url = fn.canonical_post_url(F.col("p.url"))
    more = ["payload"] if keep_payload else []
    d = d.filter(F.coalesce("p.url", F.lit("")) != "").select("source", url.alias("url"), url.alias("canonical_url"), fn.post_title(F.col("p.caption"), F.col("p.ownerUsername"), F.col("p.shortCode")).alias("title"), F.col("p.ownerUsername").alias("author"), F.coalesce(F.try_to_timestamp("p.timestamp"), "retrieved_at").alias("published_at"), F.coalesce("p.caption", F.lit("")).alias("content"), "retrieved_at", *more)
    return d.withColumn("content_hash", fn.content_hash(F.col("title"), F.col("content")))


def post_frames(payloads: DataFrame) -> DataFrame:
    """(document_id, frame_index, url): the cover, then the children; blank addresses are left out."""
    p = F.from_json("payload", _POST)
    urls = F.concat(F.array(p["displayUrl"]), F.coalesce(F.transform(p["childPosts"], lambda c: c["displayUrl"]), F.array().cast("array<string>")))
    d = payloads.select("document_id", F.posexplode(F.filter(urls, lambda u: F.trim(F.coalesce(u, F.lit(""))) != "")).alias("frame_index", "url"))
    return d


def plan_frames(frames: DataFrame, most: int = 20, digest: str = "digest") -> DataFrame:
    """frames with first_seen, over_cap and first_index: one billed row for each digest of a post, at most `most`."""
    same = Window.partitionBy("document_id", digest).orderBy("frame_index")
    before = Window.partitionBy("document_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    d = frames.withColumn("first_seen", F.row_number().over(same) == 1).withColumn("first_index", F.first("frame_index").over(same))
    return d.withColumn("over_cap", F.col("first_seen") & (F.coalesce(F.sum(F.col("first_seen").cast("int")).over(before), F.lit(0)) >= most))


def frame_work(frames: DataFrame, results: DataFrame | None = None, most: int = 20, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """(work, planned) of the frames (document_id, frame_index, digest) of posts.

    work: (digest), each different frame once over all posts, without those over the cap of all their posts
    and those that `results` (digest, image_text, error), the store of earlier runs, has already.
    """
    planned = plan_frames(frames, most, digest)
    wanted = planned.filter(~F.col("over_cap") & F.col("first_seen")).select(digest).distinct()
    if results is not None:
        wanted = wanted.join(results.select(digest).distinct().hint("merge"), digest, "left_anti")
    return wanted, planned


def frame_results(planned: DataFrame, results: DataFrame, digest: str = "digest", most: int = 20) -> DataFrame:
    """planned with image_text and cause: the first text or failure of a digest goes to all its duplicates, in any post.

    results: (digest, image_text, error), of one row a digest at least; of several, one with a text counts,
    then the least. A frame that is over the cap gets that cause; a duplicate in a post follows its first one.
    """
    order = F.struct(F.col("image_text").isNull(), F.coalesce("image_text", "error"))
    one = results.groupBy(digest).agg(F.min_by(F.struct("image_text", "error"), order).alias("_r"))
    capped = planned.filter("over_cap").select("document_id", digest, F.lit(True).alias("_capped"))
    d = planned.join(one.hint("merge"), digest, "left").join(capped.hint("merge"), ["document_id", digest], "left")
    over = F.coalesce("_capped", F.lit(False))
    cause = F.when(over, F.format_string("over the cap of %d frames", F.lit(most))).when(F.col("_r").isNull(), "not transcribed").when(F.col("_r.image_text").isNull(), F.coalesce("_r.error", F.lit("no result")))
    return d.withColumn("image_text", F.when(~over, F.col("_r.image_text"))).withColumn("cause", cause).drop("_r", "_capped")


def archive_fresh(loc: Column, now: Column, days: int = 60) -> Column:
    """The path names a year and month (/2026/08 or /2026/august) that began at most `days` before now; false where it names none."""
    shape = r"/(\d{4})/([A-Za-z]{3,9}|\d{1,2})(?=[./]|$)"
    year, token = (F.regexp_extract(fn.path_of(loc), shape, k) for k in (1, 2))
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(token, 1, 3)))
    month = F.when(token.rlike(r"^\d"), token.try_cast("int")).otherwise(name.cast("int"))
    start = F.make_date(F.nullif(year, F.lit("")).cast("int"), F.when(month.between(1, 12), month), F.lit(1))
    return F.coalesce(F.datediff(now, start).between(0, days), F.lit(False))
