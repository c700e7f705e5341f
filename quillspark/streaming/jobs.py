"""The same operators run incrementally."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.plans.jobs import ingest


def ingest_directory(spark: SparkSession, path: str, schema: str, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each new file of a landing folder goes through `ingest(batch, epoch)` once."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


OUTPUTS = ("documents", "runs", "flags", "rejects", "payloads")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def commits(spark: SparkSession, store: str) -> list[str]:
    """Names of the batches that the manifest holds, one small file each."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().startswith("batch=")) if fs.exists(where) else []


def committed(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The rows of one of OUTPUTS that committed batches wrote; what a failed one left isn't read. None before the first."""
    paths = [f"{store}/{name}/{b}" for b in commits(spark, store)]
    paths = [p for p in paths if _exists(spark, p)]
    return spark.read.option("basePath", f"{store}/{name}").parquet(*paths) if paths else None


def batch_name(landing: DataFrame) -> str:
    """A name made of the rows themselves, whatever their order: the same batch has it again after any restart."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(landing.columns)]
    digest = F.xxhash64(*columns)
    one = landing.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("x"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(20,0)")).alias("s")).first()
    return f"batch={one.n}-{(one.x or 0) % (1 << 64):016x}-{int(one.s or 0) % (1 << 64):016x}"


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _commit(spark: SparkSession, store: str, name: str, epoch: int) -> None:
    """Name the batch in the manifest: written aside, then renamed, which is all or nothing."""
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/{name}")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/_{name}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(f'{{"epoch": {epoch}}}'.encode()))
    out.close()
    fs.rename(aside, to)


def ingest_once(landing: DataFrame, epoch: int, store: str, sources: DataFrame, legs: DataFrame, policy: DataFrame | None = None) -> bool:
    """Put one batch of landed feeds through the ingest, exactly once; whether it was new.

    Everything a batch makes lies in folders of the batch's own name, written whole; then the manifest
    names it. A batch that failed anywhere before is made again from the same stored documents, those of
    committed batches, and written over; one that is named is left alone. So a crash between any two
    writes, or between the last and the stream's own commit, neither loses nor doubles a row.
    """
    spark = landing.sparkSession
    name = batch_name(landing)
    if name in commits(spark, store):
        return False
    done = ingest(landing, legs, sources, committed(spark, store, "documents"), policy)
    parts = (done.inserted, done.runs.withColumn("epoch", F.lit(epoch)), done.flags, done.rejects, done.payloads)
    for label, rows in zip(OUTPUTS, parts, strict=True):
        _put(rows, f"{store}/{label}/{name}")
    _commit(spark, store, name, epoch)
    return True


def ingest_feeds(spark: SparkSession, path: str, checkpoint: str, store: str, sources: DataFrame, legs: DataFrame, policy: DataFrame | None = None) -> StreamingQuery:
    """Landed feeds (source, url, body, retrieved_at), file by file, through the ingest into Parquet under `store`; read with `committed`."""

    def batch(landing: DataFrame, epoch: int) -> None:
        ingest_once(landing, epoch, store, sources, legs, policy)

    return ingest_directory(spark, path, "source string, url string, body string, retrieved_at timestamp", batch, checkpoint)


def without_replays(rows: DataFrame, key: str = "canonical_url", time: str = "retrieved_at", overlap: str = "60 seconds") -> DataFrame:
    """Rows of a key already seen within the overlap are dropped."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, overlap).dropDuplicatesWithinWatermark([key])


def latest_by(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """The newest values of each key by (created_at, id), for update mode."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("v")).select(key, "v.*")


def run_health(runs: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs, failures and inserted rows of each source and interval."""
    r = runs.withColumn("finished_at", F.col("finished_at").cast("timestamp")).withWatermark("finished_at", late)
    d = r.groupBy(F.window("finished_at", every), "source_name").agg(F.count("*").alias("runs"), F.sum(F.col("error").isNotNull().cast("long")).alias("failed"), F.sum("inserted").alias("inserted"))
    return d.select(F.col("window.start").alias("start"), "source_name", "runs", "failed", "inserted")


def _rising(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of one batch in the order of their requests."""
    return sorted(rows, key=lambda r: (r.us, r.seq))


def _after(state: tuple | None, r: Row) -> bool:
    return state is None or (r.us, r.seq) > tuple(state)


class TopicFold(StatefulProcessor):
    """Wanted sets, in order, to assignments and tombstones: the state of a document is its set and the last request that counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.have = handle.getValueState("have", "slugs array<string>, us long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        state = self.have.get() if self.have.exists() else None
        have, last = (set(state[0]), state[1:]) if state else (set(), None)
        for r in _rising(rows):
            if not _after(last, r):  # a replayed or late request: what came after it stands
                continue
            want = set(r.tags or [])
            for slug in sorted(want - have):
                yield Row(document_id=key[0], topic_slug=slug, assigned=True, us=r.us, seq=r.seq)
            for slug in sorted(have - want):
                yield Row(document_id=key[0], topic_slug=slug, assigned=False, us=r.us, seq=r.seq)
            have, last = want, (r.us, r.seq)
        if last is not None:
            self.have.update((sorted(have), *last))

    def close(self) -> None:
        pass


class ReadFold(StatefulProcessor):
    """Marks of a document's readers: a map of the last operation of each, and the last clearing of all.

    Out come changes: (document_id, reader, read_at), read_at null where a mark is gone. A clearing of all
    empties the map; what it cleared can't come back by a request that is older. Marks older than `keep`
    seconds are dropped when the watermark has passed them, each reader's by a timer of the document.
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getMapState("own", "reader string", "op string, us long, seq long")
        self.cleared = handle.getValueState("cleared", "us long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        changed: dict[str, int | None] = {}
        for r in _rising(rows):
            if not _after(self.cleared.get() if self.cleared.exists() else None, r):
                continue
            if r.op == "clear_all":
                changed |= {k[0]: None for k, v in self.own.iterator() if v[0] == "mark"}
                for k, v in list(self.own.iterator()):
                    if (v[1], v[2]) < (r.us, r.seq):
                        self.own.removeKey(k)
                    elif v[0] == "mark":
                        changed[k[0]] = v[1]
                self.cleared.update((r.us, r.seq))
                continue
            before = self.own.getValue((r.reader,)) if self.own.containsKey((r.reader,)) else None
            if not _after(before[1:] if before else None, r):
                continue
            self.own.updateValue((r.reader,), (r.op, r.us, r.seq))
            if r.op == "mark":
                changed[r.reader] = r.us
                if self.keep is not None:
                    self.handle.registerTimer(r.us // 1000 + 1000 * self.keep)
            elif before and before[0] == "mark":
                changed[r.reader] = None
        for reader, at in changed.items():
            yield Row(document_id=key[0], reader=reader, us=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = expiredTimerInfo.getExpiryTimeInMs() - 1000 * self.keep
        for k, v in list(self.own.iterator()):
            if v[1] // 1000 <= limit:
                self.own.removeKey(k)
                if v[0] == "mark":
                    yield Row(document_id=key[0], reader=k[0], us=None)

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocksdb(df: DataFrame) -> None:
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}: the state is kept in RocksDB")


def fold_topics(requests: DataFrame) -> DataFrame:
    """Wanted sets of topics (document_id, tags, request_ts, seq), as they come, to rows of the topic log.

    A request not after the last one of its document changes nothing, so replays give no row.
    """
    _needs_rocksdb(requests)
    kind = requests.schema["document_id"].dataType.simpleString()
    rows = requests.select("document_id", "tags", F.unix_micros(F.col("request_ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"))
    out = rows.groupBy("document_id").transformWithState(TopicFold(), f"document_id {kind}, topic_slug string, assigned boolean, us long, seq long", "Append", "None")
    return out.select("document_id", "topic_slug", "assigned", F.timestamp_micros("us").alias("created_at"), "seq")


def fold_reads(requests: DataFrame, keep: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Read requests (document_id, op, reader, request_ts, seq) to changes of marks, (document_id, reader, read_at), null where one is gone.

    keep: seconds after which a mark expires; the newest change of a (document, reader) is its state.
    """
    _needs_rocksdb(requests)
    kind = requests.schema["document_id"].dataType.simpleString()
    rows = requests.select("document_id", "op", "reader", F.col("request_ts").cast("timestamp").alias("request_ts"), F.unix_micros(F.col("request_ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"))
    if keep is not None:
        rows = rows.withWatermark("request_ts", late)
    out = rows.groupBy("document_id").transformWithState(ReadFold(keep), f"document_id {kind}, reader string, us long", "Append", "None" if keep is None else "EventTime")
    return out.select("document_id", "reader", F.timestamp_micros("us").alias("read_at"))
