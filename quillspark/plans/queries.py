"""The user-level queries as lazy DataFrames over the tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.functions.vocabulary import PRIORITY_TOPICS, vocabulary
from quillspark.operators import effective as eff
from quillspark.sources.tables import Tables, small

PERIOD_FLOOR = 0.5
SHORTLIST_FLOOR = 0.6
DEFAULT = object()
_PANAMA = timezone(timedelta(hours=-5))


def period_bounds(start: date | datetime, end: date | datetime) -> tuple[datetime, datetime]:
    """Bounds in UTC without zone: days and naive times are Panama's, an end day is whole."""

    def utc(x, shift: int) -> datetime:
        if not isinstance(x, datetime):
            x = datetime(x.year, x.month, x.day) + timedelta(days=shift)
        x = x.replace(tzinfo=_PANAMA) if x.tzinfo is None else x
        return x.astimezone(timezone.utc).replace(tzinfo=None)

    lo, hi = utc(start, 0), utc(end, 1)
    if lo > hi:
        raise ValueError("the period ends before it starts")
    return lo, hi


def limited(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return limit


def with_source(df: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
    """df with the name of its source; the sources are broadcast where they are few."""
    s = small(sources.select(F.col("id").alias("_s"), F.col("name").alias("source")), of=sources)
    return df.join(s, F.col("source_id") == F.col("_s"), how).drop("_s")


def keyword(kw: str) -> Column:
    """Title or content holds the keyword in any case; % and _ in it match as in LIKE."""
    return F.col("title").ilike(f"%{kw}%") | F.col("content").ilike(f"%{kw}%")


def annotation_filters(df: DataFrame, exclude_read: bool, floor: float | None, topics) -> DataFrame:
    if exclude_read:
        df = df.filter(F.col("read_at").isNull())
    if floor is not None:
        df = df.filter(F.col("importance_score") >= floor)
    if topics:
        df = df.filter(F.arrays_overlap("topics", F.array(*[F.lit(x) for x in topics])))
    return df


def order(floor: float | None) -> list[Column]:
    by_time = [F.desc("published_at"), F.col("id")]
    return by_time if floor is None else [F.desc_nulls_last("importance_score"), *by_time]


def search(t: Tables, kw: str, limit: int = 20, exclude_read: bool = False, min_importance: float | None = None, topics=None) -> DataFrame:
    docs = t.documents.filter(keyword(kw)) if t.keywords is None else t.keywords.search(kw)
    if min_importance is None and not topics and not exclude_read:  # the order needs documents only
        top = docs.orderBy(*order(None)).limit(limited(limit))
        d = with_source(eff.with_state(top, t, few=True), t.sources).orderBy(*order(None))
    else:
        d = with_source(eff.with_state(docs, t), t.sources)
        d = annotation_filters(d, exclude_read, min_importance, topics)
        d = d.orderBy(*order(min_importance)).limit(limited(limit))
    return d.withColumn("snippet", fn.snippet(F.col("content"), F.col("title"), kw)).withColumn("read", F.col("read_at").isNotNull())


def period_bundle(t: Tables, start, end, sources: list[str] | None = None, limit: int = 50, exclude_read: bool = False, min_importance=DEFAULT, topics=DEFAULT) -> DataFrame:
    """Headlines of a period, at most `limit` for each source, with their source_rank.

    Without a topic list or a floor given, the priority topics and PERIOD_FLOOR hold; [] and None clear
    them. Filters come before the ranking, so the window's limit works on both sides of its shuffle.
    """
    floor = PERIOD_FLOOR if min_importance is DEFAULT else min_importance
    wanted = PRIORITY_TOPICS if topics is DEFAULT else topics
    lo, hi = period_bounds(start, end)
    docs = t.documents.filter((F.col("published_at") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("published_at") < F.lit(hi).cast("timestamp_ntz")))
    d = with_source(docs, t.sources, "inner")
    if (sources := known_sources(t, sources)) is not None:
        d = d.filter(F.col("source").isin(sources))
    d = annotation_filters(eff.with_state(d, t), exclude_read, floor, wanted)
    turn = Window.partitionBy("source").orderBy(*order(floor))
    d = d.withColumn("source_rank", F.row_number().over(turn)).filter(F.col("source_rank") <= limited(limit))
    return d.withColumn("read", F.col("read_at").isNotNull()).withColumn("is_read", F.col("read"))


def group_by_source(flat: DataFrame) -> DataFrame:
    """(source, position, n, headlines): a row for each source, its headlines in the order of their ranks; sources in the order of their first headlines."""
    d = source_position(flat)
    return d.groupBy("source").agg(F.min("position").alias("position"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("source_rank", "id"))), lambda x: x["id"]).alias("headlines")).orderBy("position")


def digest_shortlist(t: Tables, start, end, floor: float = SHORTLIST_FLOOR, topics=DEFAULT) -> DataFrame:
    return period_bundle(t, start, end, limit=2, min_importance=floor, topics=topics)


def identifiers(keys: list[str], most: int = 100) -> list[str]:
    """Addresses asked for, trimmed; raises for none, too many, blanks and over-long ones."""
    if not isinstance(keys, (list, tuple)) or not 1 <= len(keys) <= most:
        raise ValueError(f"1 to {most} identifiers are wanted")
    out = []
    for k in keys:
        if not isinstance(k, str) or not k.strip() or len(k) > 2048:
            raise ValueError(f"no identifier: {k!r}")
        out.append(k.strip())
    return out


def identified(t: Tables, keys: list[str]) -> DataFrame:
    """(key, document_id) of a few addresses, by the identity map where there is one, else by the documents."""
    keys = identifiers(keys)
    if t.states is not None and t.states.version()[0]:
        return t.states.identify(keys)
    return eff.resolve(t.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string"), t.documents)


def lookup(t: Tables, requests: DataFrame | list[str], key: str = "key") -> DataFrame:
    """For each request the document with its state and its frames; nulls where there is none.

    requests: a table of addresses, or a few as a list: then only the parts of the tables that hold them are read.
    """
    if isinstance(requests, DataFrame):
        r, ids = eff.resolve(requests, t.documents, key), None
        docs = t.documents.join(r.select(F.col("document_id").alias("id")).distinct().hint("merge"), "id", "left_semi")
    else:
        r = identified(t, requests)
        ids = [x[0] for x in r.filter("document_id is not null").select("document_id").distinct().collect()]  # at most as many as asked for
        docs = t.documents.filter(F.col("id").isin(ids))
    frames = t.frames if ids is None else t.frames.filter(F.col("document_id").isin(ids))
    d = with_source(eff.with_state(docs, t, ids=ids), t.sources).withColumn("read", F.col("read_at").isNotNull())
    d = d.join(eff.frames_per_doc(frames).withColumnRenamed("document_id", "_d"), F.col("id") == F.col("_d"), "left").drop("_d")
    return r.join(d, F.col("document_id") == F.col("id"), "left")


def source_inventory(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source_id").agg(F.count("*").alias("_n"))
    last = t.runs.filter(F.col("error").isNull()).groupBy("source_name").agg(F.max("finished_at").alias("last_ingest_at"))
    d = t.sources.join(n, F.col("id") == F.col("source_id"), "left").join(last, F.col("name") == F.col("source_name"), "left")
    return d.select("name", F.coalesce("_n", F.lit(0)).cast("long").alias("article_count"), "last_ingest_at", "cadence")


def latest_run(runs: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("started_at", "finished_at", "inserted", "skipped", "parse_skipped", "error"), F.struct("finished_at", "id")).alias("r")
    return runs.groupBy("source_name").agg(newest).select("source_name", "r.*")


def known_sources(t: Tables, names: list[str] | None) -> list[str] | None:
    """The names, trimmed; None for all. A name that isn't a source's raises."""
    if names is None:
        return None
    names = [n.strip() if isinstance(n, str) else n for n in names]
    have = {x[0] for x in t.sources.filter(F.col("name").isin(names)).select("name").collect()}  # at most as many as asked for
    for n in names:
        if n not in have:
            raise ValueError(f"unknown source: {n!r}")
    return names


def source_position(flat: DataFrame, position: str = "position") -> DataFrame:
    """flat (source, source_rank, ...) with the place of each source: in the order in which its first row comes by time."""
    first = Window.partitionBy("source")
    return flat.withColumn(position, F.min(F.struct(-F.unix_micros(F.col("published_at").cast("timestamp")), F.col("id"))).over(first))


def source_health(t: Tables) -> DataFrame:
    d = t.sources.join(latest_run(t.runs), F.col("name") == F.col("source_name"), "left")
    status = F.when(F.col("finished_at").isNull(), "unknown").when(F.coalesce("error", F.lit("")) != "", "error").otherwise("ok")
    return d.select(F.col("name").alias("source"), status.alias("status"), "started_at", "finished_at", "inserted", "skipped", "parse_skipped", "error")


def importance(t: Tables, history: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Scores with the cap of their document; all rows of the log, or the newest of each document; with keys, of these addresses only, newest first."""
    log, docs = t.importance, t.documents
    asked = None
    if keys is not None:
        asked = identified(t, keys)
        ids = [x[0] for x in asked.filter("document_id is not null").select("document_id").distinct().collect()]
        docs, log = docs.filter(F.col("id").isin(ids)), log.filter(F.col("document_id").isin(ids))
        if t.states is not None and not history:
            log = t.states.rows("importance", t.importance, ids)
    elif t.states is not None and not history:
        log = t.states.rows("importance", log)
    d = eff.capped(docs).select(F.col("id").alias("document_id"), "flag_reason", "is_capped")
    j = (log if history else eff.latest_importance(log)).join(d, "document_id")
    j = j.withColumn("effective", fn.effective_score(F.col("score"), F.col("flag_reason"), F.col("is_capped")))
    return j if asked is None else asked.join(j, "document_id", "left").orderBy("key", F.desc("created_at"), F.desc("id"))


def is_human(reporter: str = "reporter") -> Column:
    return ~F.col(reporter).eqNullSafe("jev")


def pending(t: Tables, source: str | None = None) -> DataFrame:
    """Documents without importance and without a person's topics, oldest first."""
    d = with_source(t.documents, t.sources, "inner")
    if source is not None:
        d = d.filter(F.col("source") == source)
    d = d.join(t.importance.select(F.col("document_id").alias("id")), "id", "left_anti")
    return d.join(t.topics.filter(is_human()).select(F.col("document_id").alias("id")), "id", "left_anti").orderBy("published_at", "id")


def human_annotated(t: Tables, ids: list | None = None) -> DataFrame:
    """Documents that a person has scored or tagged; of those ids only."""
    cut = (lambda log: log) if ids is None else (lambda log: log.filter(F.col("document_id").isin(ids)))
    marks = cut(t.importance).filter(is_human()).select("document_id").unionAll(cut(t.topics).filter(is_human()).select("document_id"))
    docs = t.documents if ids is None else t.documents.filter(F.col("id").isin(ids))
    return docs.join(marks.withColumnRenamed("document_id", "id"), "id", "left_semi")


def backfill_candidates(t: Tables, source: str | None = None) -> DataFrame:
    """Documents without frame text, newest first."""
    d = with_source(t.documents, t.sources, "inner")
    if source is not None:
        d = d.filter(F.col("source") == source)
    return d.join(t.frames.select(F.col("document_id").alias("id")), "id", "left_anti").orderBy(F.desc("published_at"), "id")


def digest_picks(t: Tables, dates: list[date] | None = None) -> DataFrame:
    p = t.picks if dates is None else t.picks.filter(F.col("digest_date").isin(dates))
    p = p.select("digest_date", "document_id", "reporter", F.col("created_at").alias("picked_at"))
    d = with_source(p.join(t.documents, F.col("document_id") == F.col("id")), t.sources)
    return d.orderBy("digest_date", F.desc_nulls_last("published_at"), "url")


def diff_picks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, change): added or removed."""
    gone = old.join(new, "document_id", "left_anti").select("document_id", F.lit("removed").alias("change"))
    return new.join(old, "document_id", "left_anti").select("document_id", F.lit("added").alias("change")).unionAll(gone)


def rescoring_signal(t: Tables, old: DataFrame, new: DataFrame) -> DataFrame:
    """Added picks were weighted too low, removed ones too high: each with its score now."""
    d = diff_picks(old, new)
    scores = importance(t).select("document_id", "effective")
    signal = F.when(F.col("change") == "added", "under-weighted").otherwise("over-weighted")
    return d.join(scores, "document_id", "left").withColumn("signal", signal)


def canonical_duplicates(docs: DataFrame) -> DataFrame:
    return docs.groupBy("canonical_url").agg(F.count("*").alias("n")).filter("n > 1")


def ingest_pointer(t: Tables, overlap_s: int = 60, bootstrap: int = 10, steady: int = 15) -> DataFrame:
    """For each source the time from which to fetch, and how many posts at most."""
    newest = t.documents.groupBy("source_id").agg(F.max("published_at").alias("newest"))
    d = t.sources.join(newest, F.col("id") == F.col("source_id"), "left")
    return d.select("name", (F.col("newest") - F.expr(f"INTERVAL '{overlap_s}' SECOND")).alias("fetch_from"), F.when(F.col("newest").isNull(), bootstrap).otherwise(steady).alias("post_cap"))


def run_counters(t: Tables) -> DataFrame:
    failed = F.col("error").isNotNull()
    return t.runs.groupBy("source_name").agg(F.count("*").alias("runs"), F.sum(failed.cast("long")).alias("failed"), F.sum("inserted").alias("inserted"), F.sum("skipped").alias("skipped"))


def vocabulary_table(t: Tables) -> DataFrame:
    return vocabulary(t.spark)
