"""Latest-wins states of the append-only logs, and their joins to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as fn


def latest_importance(log: DataFrame) -> DataFrame:
    """(document_id, score, reporter, created_at, ...): newest row of each document by (created_at, id).

    A hash aggregate of one struct, so the map side keeps a row for each document.
    """
    values = [c for c in log.columns if c != "document_id"]
    newest = F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("v")
    return log.groupBy("document_id").agg(newest).select("document_id", *[f"v.{c}" for c in values])


def importance_history(log: DataFrame) -> DataFrame:
    return log.orderBy("document_id", F.desc("created_at"), F.desc("id"))


def assigned_topics(log: DataFrame) -> DataFrame:
    """(document_id, topic_slug): assignments that no later tombstone retires."""
    newest = log.groupBy("document_id", "topic_slug").agg(F.max_by("assigned", F.struct("created_at", "id")).alias("assigned"))
    return newest.filter("assigned").drop("assigned")


def effective_topics(log: DataFrame) -> DataFrame:
    """(document_id, topics): sorted slugs; a document has at most as many as the vocabulary."""
    return assigned_topics(log).groupBy("document_id").agg(F.sort_array(F.collect_list("topic_slug")).alias("topics"))


def readers(reads: DataFrame) -> DataFrame:
    """(document_id, readers): array of (reader, read_at) by reader."""
    return reads.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reader", "read_at"))).alias("readers"))


def read_cache(reads: DataFrame) -> DataFrame:
    """(document_id, read_at, read_by): newest mark; of equal times the least reader."""
    newest = F.min_by(F.struct("read_at", "reader"), F.struct(-F.unix_micros(F.col("read_at").cast("timestamp")), F.col("reader")))
    return reads.groupBy("document_id").agg(newest.alias("r")).select("document_id", "r.read_at", F.col("r.reader").alias("read_by"))


def image_flags(frames: DataFrame) -> DataFrame:
    """(document_id) of documents with a frame that has text."""
    return frames.filter(fn.has_text(F.col("image_text"))).select("document_id").distinct()


def frames_per_doc(frames: DataFrame) -> DataFrame:
    return frames.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", "image_text", "model"))).alias("image_texts"))


def with_importance(docs: DataFrame, log: DataFrame) -> DataFrame:
    """docs with the capped score of the newest importance row, and who gave it."""
    new = latest_importance(log)
    rationale = F.col("rationale") if "rationale" in log.columns else F.lit(None).cast("string")
    new = new.select(F.col("document_id").alias("_d"), F.col("score").alias("_score"), rationale.alias("importance_rationale"), F.col("reporter").alias("importance_reporter"), F.col("created_at").alias("importance_updated_at"))
    out = docs.join(new, docs["id"] == F.col("_d"), "left")
    return out.withColumn("importance_score", fn.effective_score(F.col("_score"), F.col("flag_reason"), F.col("is_capped"))).drop("_d", "_score")


def capped(docs: DataFrame) -> DataFrame:
    """docs with is_capped; to be stored when documents are written, so that reads don't scan bodies."""
    return docs if "is_capped" in docs.columns else docs.withColumn("is_capped", fn.is_paywalled(F.col("content")))


def reads_per_doc(reads: DataFrame) -> DataFrame:
    """(document_id, readers, read_at, read_by): the array and the cache of one grouping."""
    newest = F.min_by(F.struct("read_at", "reader"), F.struct(-F.unix_micros(F.col("read_at").cast("timestamp")), F.col("reader")))
    d = reads.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reader", "read_at"))).alias("readers"), newest.alias("_r"))
    return d.select("document_id", "readers", F.col("_r.read_at").alias("read_at"), F.col("_r.reader").alias("read_by"))


def with_state(docs: DataFrame, t, few: bool = False, ids: list | None = None) -> DataFrame:
    """docs with importance, topics, readers, the read cache and the image flag, each by one left join.

    few: docs are a bounded number of rows, as after a limit; the logs are cut to their ids before they are
    grouped. ids: those of docs, where they are known. Where the tables have snapshots of the logs, these
    and the rows since are read in place of the logs.
    """
    own = F.broadcast(docs.select(F.col("id").alias("document_id"))) if few else None

    def cut(name: str) -> DataFrame:
        log = getattr(t, name)
        if getattr(t, "states", None) is not None and name != "frames":
            log = t.states.rows(name, log, ids)
        elif ids is not None:
            log = log.filter(F.col("document_id").isin(ids))
        return log.join(own, "document_id", "left_semi") if few else log

    d = with_importance(capped(docs), cut("importance"))
    for part in (effective_topics(cut("topics")), reads_per_doc(cut("reads")), image_flags(cut("frames")).withColumn("has_image_text", F.lit(True))):
        part = part.withColumnRenamed("document_id", "_d")
        d = d.join(part, F.col("id") == F.col("_d"), "left").drop("_d")
    return d.withColumn("has_image_text", F.coalesce("has_image_text", F.lit(False)))


def resolve(requests: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """requests with document_id: the document of that address without outer blanks, else the one of that canonical address.

    Two equality joins; an OR of them would compare every request to every document.
    """
    exact = docs.select(F.col("id").alias("_exact"), F.col("url").alias("_url"))
    canon_rows = docs.select("id", F.col("canonical_url").alias("_canon"))
    # only documents that some request may mean are grouped; a table from explode gets a join hint
    wanted = requests.select(fn.canonicalize_url(F.col(key)).alias("_canon")).distinct()
    canon = canon_rows.join(wanted.hint("merge"), "_canon", "left_semi").groupBy("_canon").agg(F.min("id").alias("_by_canon"))
    r = requests.join(exact.hint("merge"), F.trim(key) == F.col("_url"), "left").join(canon.hint("merge"), fn.canonicalize_url(F.col(key)) == F.col("_canon"), "left")
    return r.withColumn("document_id", F.coalesce("_exact", "_by_canon")).drop("_exact", "_url", "_canon", "_by_canon")
