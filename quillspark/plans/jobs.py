"""The batch jobs, composed of the operators: ingest, annotation, the image-text backfill plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.functions.rows import written
from quillspark.operators import writes
from quillspark.operators.effective import capped, resolve
from quillspark.operators.judgments import REPORTER, annotation_totals, read_off
from quillspark.operators.upsert import guard_sources, upsert_documents
from quillspark.plans import queries as q
from quillspark.sources.feeds import choose_feed, map_posts, parsed_feeds, parts, post_frames
from quillspark.sources.pages import articles
from quillspark.sources.tables import Tables


def merge_causes(*arrays: Column) -> Column:
    """One array of all causes, in the order given; null where there is none."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(a, none) for a in arrays])
    return F.when(F.size(every) > 0, every)


def record_runs(sources: DataFrame, inserted: DataFrame, skipped: DataFrame, parse_rejects: DataFrame, causes: DataFrame, started_at: Column, finished_at: Column, errors: DataFrame | None = None, discovery: DataFrame | None = None) -> DataFrame:
    """Rows of the run log, one for each name of `sources` (source_name): counters and skip reasons.

    inserted, skipped and parse_rejects have a source each; parse_rejects, discovery and causes (source,
    cause) tell why, in this order; errors: (source, error) of sources that gave nothing, whose other
    columns stay empty.
    """
    by = F.col("source").alias("source_name")
    count = lambda d, name: d.groupBy(by).agg(F.count("*").cast("int").alias(name))
    why = lambda d, name: d.groupBy(by).agg(F.sort_array(F.collect_list("cause")).alias(name))
    d = sources.select("source_name")
    none = parse_rejects.sparkSession.createDataFrame([], "source string, cause string, error string")
    parts = (count(inserted, "inserted"), count(skipped, "skipped"), count(parse_rejects, "parse_skipped"), why(parse_rejects, "_parse"), why(none if discovery is None else discovery, "_discovery"), why(causes, "_enrich"), (none if errors is None else errors).filter("error is not null").groupBy(by).agg(F.min("error").alias("error")))
    for part in parts:
        d = d.join(part.hint("merge"), "source_name", "left")
    reasons = merge_causes(F.col("_parse"), F.col("_discovery"), F.col("_enrich"))
    counts = [F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("inserted", "skipped", "parse_skipped")]
    return d.select("source_name", started_at.alias("started_at"), finished_at.alias("finished_at"), *counts, "error", F.when(F.col("error").isNull(), reasons).alias("skipped_reasons"))


def keep_or_flag(docs: DataFrame, legs: DataFrame, threshold: int | Column = fn.THIN) -> tuple[DataFrame, DataFrame]:
    """(docs, flags): each document with the body of the leg that serves, or its own and the cause; a flag where that one is thin."""
    enriched = writes.choose_leg(docs, legs, threshold)
    return enriched, writes.flag_unrecoverable(enriched, threshold)


@dataclass
class Ingested:
    inserted: DataFrame
    skipped: DataFrame
    rejects: DataFrame
    unknown_sources: DataFrame
    flags: DataFrame
    runs: DataFrame
    payloads: DataFrame


_DOC = ("source", "lane", "place", "feed", "retrieved_at", "item", "url", "canonical_url", "title", "author", "published_at", "content", "content_hash")


def _lane(docs: DataFrame, lane: str) -> DataFrame:
    """docs of one lane in the columns that all lanes share; place, feed and item are their order."""
    blank = {"place": F.lit(0), "feed": F.col("url"), "item": F.lit(0), "author": F.lit(None).cast("string")}
    d = docs.withColumns({c: v for c, v in blank.items() if c not in docs.columns} | {"lane": F.lit(lane)})
    return d.select("source", "lane", F.col("place").cast("long").alias("place"), "feed", F.col("retrieved_at").cast("timestamp").alias("retrieved_at"), F.col("item").cast("long").alias("item"), *_DOC[6:10], F.col("published_at").cast("timestamp").alias("published_at"), *_DOC[11:])


def chosen_feeds(landing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, rejects, failed) of each source's first feed that has entries; rejects also has what was wrong with other feeds (item null).

    landing: (source, url, body, retrieved_at[, ordinal]). The feeds of a source are its candidates, in
    the order of ordinal, else of their addresses; a later one counts only if all before it have no
    entry or can't be parsed. failed: (source, error) of sources without any such feed, the last
    candidate's. A feed that was landed several times is one candidate.
    """
    items, rejects = parts(written(parsed_feeds(landing), "ingest-parsed"))
    place = F.col("ordinal").cast("long") if "ordinal" in landing.columns else F.lit(0).cast("long")
    listed = landing.groupBy("source", "url").agg(F.min(place).alias("place"))
    full = items.select("source", F.col("feed").alias("url")).unionAll(rejects.filter("item is not null").select("source", "url")).distinct().withColumn("entries", F.lit(1))
    wrong = rejects.filter("item is null").groupBy("source", "url").agg(F.max("cause").alias("error"))
    d = listed.join(full.hint("merge"), ["source", "url"], "left").join(wrong.hint("merge"), ["source", "url"], "left")
    d = written(d.withColumn("entries", F.coalesce("entries", F.lit(0))), "ingest-candidates")
    picked = written(choose_feed(d.withColumn("ordinal", F.struct("place", "url"))), "ingest-feeds")
    own = picked.filter("url is not null").join(d.select("source", "url", "place").hint("merge"), ["source", "url"])
    items = items.join(own.withColumnRenamed("url", "feed").hint("merge"), ["source", "feed"])
    skipped = rejects.filter("item is not null").join(own.select("source", "url").hint("merge"), ["source", "url"], "left_semi")
    rejects = skipped.select(rejects.columns).unionAll(rejects.filter("item is null"))
    return items, rejects, picked.filter("url is null").select("source", "error")


def ingest(
    landing: DataFrame,
    legs: DataFrame,
    sources: DataFrame,
    stored: DataFrame | None,
    policy: DataFrame | None = None,
    started_at: Column | None = None,
    finished_at: Column | None = None,
    posts: DataFrame | None = None,
    pages: DataFrame | None = None,
    discovery: DataFrame | None = None,
) -> Ingested:
    """What was landed to stored documents: parse, enrich, guard, upsert, payloads, flags, run log.

    landing: feeds as chosen_feeds takes them; posts: (source, payload, retrieved_at); pages: as
    extract_articles takes them, with source; discovery: (source, cause) of what planning them skipped.
    legs: as choose_leg takes them, with scrape_payload, if any; sources: (name, ...); stored: documents so
    far; policy: rows of enrichment_policy, (name, mode, threshold), auto and 500 where absent.

    Feeds and pages are enriched; the caption of a post is final. Documents keep the order of source,
    lane, candidate, time of landing and place, so the first of equal ones wins. payloads: (url, payload,
    retrieved_at), the newest of each stored address: posts, and what the scrape leg gave where it served.
    """
    items, rejects, failed = chosen_feeds(landing)
    docs, unread = _lane(items, "feed"), rejects.select("source", "url", "cause").limit(0)
    if pages is not None:
        read = written(articles(pages), "ingest-pages")
        good, bad = read.filter("cause is null").drop("cause"), read.filter("cause is not null")
        docs, unread = docs.unionByName(_lane(good, "page")), bad.select("source", "url", "cause")
    modes = policy.select(F.col("name").alias("source"), "mode", "threshold" if "threshold" in policy.columns else F.lit(fn.THIN).alias("threshold")) if policy is not None else sources.select(F.col("name").alias("source"), F.lit("auto").alias("mode"), F.lit(fn.THIN).alias("threshold"))
    docs = docs.join(modes.hint("merge"), "source", "left").withColumn("mode", F.coalesce("mode", F.lit("auto"))).withColumn("threshold", F.coalesce("threshold", F.lit(fn.THIN)))
    enriched = writes.choose_leg(docs, legs, F.col("threshold"))
    # parsed and enriched once, whatever is made of it
    enriched = written(enriched.withColumn("content_hash", fn.content_hash(F.col("title"), F.col("content"))), "ingest-enriched")
    flags = writes.flag_unrecoverable(enriched, F.col("threshold"))
    every, payloads = enriched.select(*_DOC), enriched.select("url", F.lit(None).cast("string").alias("payload"), "retrieved_at").limit(0)
    if "scrape_payload" in legs.columns:
        got = legs.filter("scrape_payload is not null").select("url", F.col("scrape_payload").alias("payload"))
        payloads = enriched.filter("leg = 'scrape'").select("url", "retrieved_at").join(got.hint("merge"), "url").select("url", "payload", "retrieved_at")
    if posts is not None:
        every = every.unionByName(_lane(map_posts(posts), "post"))
        payloads = payloads.unionByName(map_posts(posts, keep_payload=True).select("url", "payload", F.col("retrieved_at").cast("timestamp").alias("retrieved_at")))
    # the cap of a paywalled body is stored, so that no read of scores scans bodies for it
    known, unknown = guard_sources(capped(every), sources)
    known = known.withColumn("ordinal", F.struct("source", "lane", "place", "feed", "retrieved_at", "item"))
    inserted, skipped = upsert_documents(known, stored)
    there = inserted.select("url") if stored is None else inserted.select("url").unionAll(stored.select("url"))
    flags = flags.join(there.distinct().withColumnRenamed("url", "key").hint("merge"), "key", "left_semi")
    payloads = payloads.join(there.distinct().hint("merge"), "url", "left_semi").groupBy("url").agg(F.max_by(F.struct("payload", "retrieved_at"), "retrieved_at").alias("p")).select("url", "p.*")
    causes = enriched.filter("cause is not null").select("source", F.concat_ws(": ", "url", "cause").alias("cause"))
    found = unread.select("source", F.concat_ws(": ", "url", "cause").alias("cause"))
    found = found if discovery is None else found.unionAll(discovery.select("source", "cause"))
    now = F.current_timestamp()
    names = landing.select("source")
    for d in (posts, pages, discovery):
        names = names if d is None else names.unionAll(d.select("source"))
    names = written(names.select(F.col("source").alias("source_name")).distinct(), "ingest-sources")
    strange = names.join(sources.select(F.col("name").alias("source_name")).hint("merge"), "source_name", "left_anti")
    errors = strange.select(F.col("source_name").alias("source"), F.concat(F.lit("unknown source: "), "source_name").alias("error")).unionAll(failed.join(strange.select(F.col("source_name").alias("source")).hint("merge"), "source", "left_anti"))
    runs = record_runs(names, inserted, skipped, rejects.filter("item is not null"), causes, now if started_at is None else started_at, now if finished_at is None else finished_at, errors, found)
    return Ingested(inserted, skipped, rejects.unionByName(unread.withColumn("item", F.lit(None).cast("int")).withColumn("hint", F.lit(None).cast("string")).select(rejects.columns)), unknown, flags, runs, payloads)


def select_targets(t: Tables, ids: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """(key, place): addresses asked for (key, ordinal), then pending documents of the source; without both, all pending.

    Blank keys are left out, and of equal ones the first place stands.
    """
    parts = []
    none = F.lit(None)
    if ids is not None:
        parts.append(ids.select(F.trim("key").alias("key"), F.struct(F.lit(0).alias("part"), F.col("ordinal").cast("long").alias("n"), none.cast("timestamp_ntz").alias("at"))))
    if ids is None or source is not None:
        parts.append(q.pending(t, source).select(F.col("url").alias("key"), F.struct(F.lit(1).alias("part"), F.col("id").cast("long").alias("n"), F.col("published_at").cast("timestamp_ntz").alias("at"))))
    rows = parts[0].toDF("key", "place")
    for p in parts[1:]:
        rows = rows.unionAll(p.toDF("key", "place"))
    # pending documents come oldest first
    order = F.struct("place.part", F.when(F.col("place.part") == 1, F.col("place.at")).alias("at"), "place.n")
    return rows.filter(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(F.min(order).alias("place"))


@dataclass
class Annotated:
    topics: DataFrame
    importance: DataFrame
    causes: DataFrame
    totals: DataFrame


def annotate(t: Tables, judgments: DataFrame, at: Column, ids: DataFrame | None = None, source: str | None = None, tokens: DataFrame | None = None) -> Annotated:
    """Judged documents to rows of the topic and importance logs; persons' annotations are never overwritten.

    judgments: as read_off takes them; tokens: (document_id, tokens) of the calls. causes: (key,
    document_id, cause) of targets that gave no row, and of judgments with a cause. totals: annotated,
    skipped, tokens, cost.
    """
    targets = resolve(select_targets(t, ids, source).select("key"), t.documents)
    people = q.human_annotated(t).select(F.col("id").alias("document_id"))
    unknown = targets.filter("document_id is null").withColumn("cause", F.lit("unknown article"))
    known = targets.filter("document_id is not null").groupBy("document_id").agg(F.min("key").alias("key"))
    by_hand = known.join(people.hint("merge"), "document_id", "left_semi").withColumn("cause", F.lit("human-annotated; skipped"))
    work = known.join(people.hint("merge"), "document_id", "left_anti")
    read = read_off(judgments.join(work.select("document_id").hint("merge"), "document_id", "left_semi")).join(work.hint("merge"), "document_id")
    order = {"request_ts": at, "seq": F.lit(1)}
    topics, _ = writes.apply_topics(read.filter(F.size("topics") > 0).select("key", F.col("topics").alias("tags"), F.lit(REPORTER).alias("reporter"), *[c.alias(n) for n, c in order.items()]), t.documents, t.topics)
    scores, _ = writes.apply_importance(read.filter("score is not null").select("key", "score", "rationale", F.lit(REPORTER).alias("reporter"), *[c.alias(n) for n, c in order.items()]), t.documents)
    written = (F.size("topics") > 0) | F.col("score").isNotNull()
    names = ("key", "document_id", "cause")
    causes = unknown.select(*names).unionByName(by_hand.select(*names)).unionByName(read.filter("cause is not null").select(*names))
    counted = read.select("document_id", F.when(~written, F.coalesce("cause", F.lit("nothing to write"))).alias("cause"))
    counted = counted.unionByName(unknown.unionByName(by_hand).select("document_id", "cause"))
    spent = tokens if tokens is not None else read.select("document_id", F.lit(0).cast("long").alias("tokens"))
    totals = annotation_totals(counted.join(spent.hint("merge"), "document_id", "left"))
    return Annotated(topics, scores, causes, totals)


def backfill_plan(t: Tables, payloads: DataFrame, source: str | None = None, cover_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, counts): the frames (document_id, frame_index, url) to transcribe of documents without frame text; how many have no payload, no frames.

    payloads: (document_id, payload). A payload is needed again where there is none; nothing is billed for either.
    """
    docs = q.backfill_candidates(t, source).select(F.col("id").alias("document_id"))
    d = docs.join(payloads.hint("merge"), "document_id", "left")
    frames = post_frames(d.filter("payload is not null"))
    frames = frames.filter("frame_index = 0") if cover_only else frames
    have = frames.select("document_id").distinct().withColumn("_has", F.lit(True))
    counts = d.join(have.hint("merge"), "document_id", "left").agg(F.count_if(F.col("payload").isNull()).alias("no_payload"), F.count_if(F.col("payload").isNotNull() & F.col("_has").isNull()).alias("no_frames"))
    return frames, counts
