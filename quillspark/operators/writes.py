"""Write requests to the append-only logs: each returns (applied, rejected).

Requests carry request_ts and seq, their order; `key` is an address of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import markers
from quillspark.functions import text as fn
from quillspark.functions.rows import dealt, fixed, written
from quillspark.functions.vocabulary import canonicalize_topics
from quillspark.operators.effective import assigned_topics, capped, resolve

_ORDER = ("request_ts", "seq")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("reject_reason is null").drop("reject_reason"), df.filter("reject_reason is not null")


def _reject(*tests: tuple[Column, str]) -> Column:
    out = None
    for test, reason in tests:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def apply_importance(reqs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score 0 to 1, rationale up to 2,000 and reporter up to 100 characters; the cap holds at the write."""
    r = resolve(reqs, docs)
    r = r.join(capped(docs).select(F.col("id").alias("document_id"), "flag_reason", "is_capped"), "document_id", "left")
    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    r = r.withColumn("reject_reason", _reject((F.col("document_id").isNull(), "unknown document"), (F.col("score").isNull() | ~F.col("score").between(0, 1), "score out of range"), (n("rationale") > 2000, "rationale too long"), (n("reporter") > 100, "reporter too long")))
    ok, bad = _split(r)
    return ok.select("document_id", fn.effective_score(F.col("score"), F.col("flag_reason"), F.col("is_capped")).alias("score"), F.trim("rationale").alias("rationale"), F.trim("reporter").alias("reporter"), F.col("request_ts").alias("created_at"), "seq"), bad


def apply_topics(reqs: DataFrame, docs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted sets (tags array) to assignments and tombstones against the set before; [] clears."""
    r = resolve(reqs, docs)
    tags = canonicalize_topics(r.select("document_id", *_ORDER, F.explode("tags").alias("tag")), "tag")
    per = tags.groupBy("document_id", *_ORDER).agg(F.sort_array(F.collect_set("slug")).alias("wanted"), F.max(F.col("slug").isNull()).alias("_unknown"))
    r = r.join(per.hint("merge"), ["document_id", *_ORDER], "left").withColumn("wanted", F.coalesce("wanted", F.array().cast("array<string>")))
    blank = F.exists("tags", lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    long = F.length(F.trim(F.coalesce("reporter", F.lit("")))) > 100
    r = r.withColumn("reject_reason", _reject((F.col("document_id").isNull(), "unknown document"), (F.col("tags").isNull() | blank, "blank topic"), (F.coalesce("_unknown", F.lit(False)), "unknown topic"), (long, "reporter too long")))
    ok, bad = _split(r)
    now = assigned_topics(log).groupBy("document_id").agg(F.collect_list("topic_slug").alias("_now"))
    ok = ok.join(now.hint("merge"), "document_id", "left")
    turn = Window.partitionBy("document_id").orderBy(*_ORDER)
    none = F.array().cast("array<string>")
    ok = ok.withColumn("before", F.coalesce(F.lag("wanted").over(turn), F.col("_now"), none))
    change = lambda a, b, on: F.transform(F.sort_array(F.array_except(a, b)), lambda s: F.struct(s.alias("topic_slug"), F.lit(on).alias("assigned")))
    rows = ok.select("document_id", *_ORDER, "reporter", F.explode(F.concat(change("wanted", "before", True), change("before", "wanted", False))).alias("c"))
    return rows.select("document_id", "c.topic_slug", "c.assigned", "reporter", F.col("request_ts").alias("created_at"), "seq"), bad


def read_state(log: DataFrame) -> DataFrame:
    """(document_id, reader, read_at) that hold after a log of ops: mark, clear (of a reader) and clear_all."""
    last_all = log.filter("op = 'clear_all'").groupBy("document_id").agg(F.max(F.struct(*_ORDER)).alias("_all"))
    own = log.filter("op in ('mark', 'clear')").groupBy("document_id", "reader").agg(F.max_by(F.struct("op", *_ORDER), F.struct(*_ORDER)).alias("o"))
    d = own.join(last_all, "document_id", "left").filter((F.col("o.op") == "mark") & (F.col("_all").isNull() | (F.struct("o.request_ts", "o.seq") > F.col("_all"))))
    return d.select("document_id", "reader", F.col("o.request_ts").alias("read_at"))


def apply_reads(reqs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = resolve(reqs, docs)
    n = F.length(F.trim(F.coalesce("reader", F.lit(""))))
    r = r.withColumn("reject_reason", _reject((F.col("document_id").isNull(), "unknown document"), (F.col("op").isin("mark", "clear") & ~n.between(1, 100), "reader missing or too long"), (~F.col("op").isin("mark", "clear", "clear_all"), "unknown operation")))
    ok, bad = _split(r)
    return ok.select("document_id", "op", "reader", *_ORDER), bad


def apply_flags(reqs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags of the seven reasons (`other` needs a detail); a null reason clears. Every row of the address is meant."""
    # the requests, with their canonical addresses, are made once
    keyed = written(fixed(dealt(reqs), "_canon", fn.canonicalize_url(F.col("key"))), "flag-requests")
    reqs = keyed.drop("_canon")
    by_url = reqs.join(docs.select(F.col("id").alias("document_id"), F.col("url").alias("_u")), F.col("key") == F.col("_u")).drop("_u")
    by_canon = keyed.join(docs.select(F.col("id").alias("document_id"), F.col("canonical_url").alias("_u")), F.col("_canon") == F.col("_u")).drop("_u", "_canon")
    hit = by_url.unionByName(by_canon).distinct()
    missing = reqs.join(hit.select(*_ORDER).distinct(), list(_ORDER), "left_anti").withColumn("document_id", F.lit(None).cast(hit.schema["document_id"].dataType))
    detail = F.trim(F.coalesce("detail", F.lit("")))
    r = hit.unionByName(missing).withColumn("reject_reason", _reject((F.col("document_id").isNull(), "unknown document"), (F.col("reason").isNotNull() & ~F.col("reason").isin(*fn.FLAG_REASONS), "unknown reason"), ((F.col("reason") == "other") & (detail == ""), "detail missing"), (F.length(detail) > 2000, "detail too long")))
    ok, bad = _split(r)
    return ok.select("document_id", "reason", detail.alias("detail"), "reporter", *_ORDER), bad


def current_flags(log: DataFrame) -> DataFrame:
    newest = log.groupBy("document_id").agg(F.max_by(F.struct("reason", "detail", "reporter", "request_ts"), F.struct(*_ORDER)).alias("f"))
    return newest.filter("f.reason is not null").select("document_id", F.col("f.reason").alias("flag_reason"), F.col("f.detail").alias("flag_detail"), F.col("f.request_ts").alias("flagged_at"), F.col("f.reporter").alias("flagged_by"))


def record_picks(reqs: DataFrame, picks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request a date, (digest_date, keys array, reporter, request_ts): the date's set becomes the request's.

    Returns (digest_date, document_id, reporter, created_at, change) with change added, removed or
    kept, and the rejected requests: an unknown address rejects the whole of it.
    """
    r = resolve(reqs.select("digest_date", "reporter", "request_ts", F.explode("keys").alias("key")), docs)
    bad = r.filter("document_id is null").select("digest_date").distinct()
    want = r.join(bad.hint("merge"), "digest_date", "left_anti").groupBy("digest_date", "document_id").agg(F.max("reporter").alias("_reporter"), F.max("request_ts").alias("_ts"))
    dates = reqs.select("digest_date").join(bad.hint("merge"), "digest_date", "left_anti").distinct()
    have = picks.join(dates.hint("merge"), "digest_date", "left_semi").withColumn("_has", F.lit(True))
    d = want.withColumn("_wants", F.lit(True)).join(have.hint("merge"), ["digest_date", "document_id"], "full_outer")
    change = F.when(F.col("_has").isNull(), "added").when(F.col("_wants").isNull(), "removed").otherwise("kept")
    return d.select("digest_date", "document_id", F.coalesce("_reporter", "reporter").alias("reporter"), F.coalesce("created_at", "_ts").alias("created_at"), change.alias("change")), reqs.join(bad.hint("merge"), "digest_date", "left_semi")


def clear_picks(dates: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining picks, (digest_date, removed))."""
    gone = dates.join(picks.groupBy("digest_date").agg(F.count("*").alias("n")), "digest_date", "left").select("digest_date", F.coalesce("n", F.lit(0)).alias("removed"))
    return picks.join(dates, "digest_date", "left_anti"), gone


def upsert_newest(rows: DataFrame, docs: DataFrame, keys: tuple[str, ...], newest: str) -> tuple[DataFrame, DataFrame]:
    """Payloads by (document_id), frame texts by (document_id, frame_index): the newest row of a key; unknown documents are rejected."""
    r = resolve(rows, docs)
    values = [c for c in rows.columns if c not in keys]
    ok = r.filter("document_id is not null").groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(newest)).alias("v")).select(*keys, "v.*")
    return ok, r.filter("document_id is null").withColumn("reject_reason", F.lit("unknown document"))


def upsert_frame_texts(rows: DataFrame, docs: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Frame texts (key, frame_index, image_text, created_at) by document and frame, newest first, stamped with the model."""
    stamped = rows.withColumn("image_text", fn.transcription(F.col("image_text"))).withColumn("model", F.lit(model))
    return upsert_newest(stamped, docs, ("document_id", "frame_index"), "created_at")


def backfill_reads(docs: DataFrame, reads: DataFrame) -> DataFrame:
    """Rows of marks that only the old columns of documents hold."""
    d = docs.filter(F.trim(F.coalesce("read_by", F.lit(""))) != "").select(F.col("id").alias("document_id"), F.trim("read_by").alias("reader"), "read_at")
    return d.join(reads, ["document_id", "reader"], "left_anti")


def seed_sources(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """Missing sources with their fixed ids."""
    return catalog.join(sources, "name", "left_anti").withColumn("id", fn.source_uuid(F.col("name")))


def flag_unrecoverable(enriched: DataFrame, threshold: int | Column = fn.THIN) -> DataFrame:
    """Flags for documents whose enrichment failed and whose kept body is thin."""
    return enriched.filter(F.col("cause").isNotNull() & fn.is_thin(F.col("content"), threshold)).select(F.col("url").alias("key"), F.lit("unrecoverable").alias("reason"), fn.cause_text(F.col("cause"), 2000).alias("detail"))


def choose_leg(docs: DataFrame, legs: DataFrame, threshold: int | Column = fn.THIN, family: tuple[str, ...] = markers.FAMILY_HOSTS) -> DataFrame:
    """docs (url, content, mode) with the body of the first leg that serves (url, primary, reader, scrape), its name as `leg`, and the cause where none does.

    A body that isn't thin stays unless forced. The primary leg's text is taken even if thin, but not an
    application shell; a later leg's only if it isn't thin. legs may have the failures as primary_error,
    reader_error and scrape_error: after a failure of the primary that another way of fetching can't
    mend, the later legs don't count. A document that no leg serves keeps its body. threshold: of all
    documents, or a column of docs. The primary text of the family's hosts is cleaned of its chrome.
    """
    d = docs.join(legs.hint("merge"), "url", "left")
    d = d.withColumn("primary", F.when(markers.of_family(F.col("url"), family), markers.clean_family_markdown(F.col("primary"))).otherwise(F.col("primary")))
    skip = (F.col("mode") != "force_on") & (~fn.is_thin(F.col("content"), threshold) | (F.col("mode") == "force_off"))
    names = ("primary", "reader", "scrape")
    error = {c: F.nullif(F.trim(F.coalesce(F.col(f"{c}_error"), F.lit(""))), F.lit("")) if f"{c}_error" in legs.columns else F.lit(None).cast("string") for c in names}
    empty = {c: fn.normalize_text(F.coalesce(c, F.lit(""))) == "" for c in names}
    shell = F.coalesce(markers.is_js_shell(F.col("primary"), threshold), F.lit(False))
    final = empty["primary"] & error["primary"].isNotNull() & ~markers.is_primary_miss(error["primary"])
    serves = {"primary": ~empty["primary"] & ~shell} | {c: ~final & ~fn.is_thin(F.col(c), threshold) for c in names[1:]}
    leg = F.when(~skip, F.coalesce(*[F.when(serves[c], F.lit(c)) for c in names]))
    body = F.coalesce(*[F.when(leg == c, F.col(c)) for c in names])
    own = {c: F.when(empty[c], F.coalesce(error[c], F.lit("empty"))).otherwise(F.lit("thin")) for c in names[1:]}
    first = F.when(empty["primary"], F.coalesce(error["primary"], F.lit("empty"))).otherwise(F.lit("JS shell"))
    causes = [F.concat(F.lit("primary: "), first), *(F.concat(F.lit(f"{c}: "), F.when(final, F.lit("not tried")).otherwise(own[c])) for c in names[1:])]
    cause = F.when(~skip & body.isNull(), F.substring(F.concat_ws("; ", *causes), 1, 1024))
    return d.select(*[c for c in docs.columns if c != "content"], F.coalesce(body, "content").alias("content"), leg.alias("leg"), cause.alias("cause"))
