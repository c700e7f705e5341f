"""The streamed ingest after crashes, and the folds with state after replays and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import writes
from quillspark.streaming import jobs

NOW = datetime(2024, 1, 3)
LONG = "word " * 200


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link><description>{LONG}{t}</description></item>" for t, u in items) + "</channel></rss>"


class Crash(RuntimeError):
    pass


@pytest.mark.parametrize("fails_at", [0, 3, 4, 5, 6])
def test_a_crash_after_any_write_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, fails_at):
    """fails_at: the write after which the batch dies; 6: after the manifest, before the stream's own commit."""
    store, n, put, commit = str(tmp_path / "store"), [0], jobs._put, jobs._commit

    def counted(write):
        def f(*args):
            write(*args)
            n[0] += 1
            if n[0] == fails_at + 1:
                raise Crash

        return f

    monkeypatch.setattr(jobs, "_put", counted(put))
    monkeypatch.setattr(jobs, "_commit", counted(commit))
    sources = spark.createDataFrame([("a",)], "name string")
    legs = spark.createDataFrame([], "url string, primary string, reader string, scrape string")
    batches = [[("One", "https://a.com/1"), ("Two", "https://a.com/2")], [("Two", "https://a.com/2"), ("Three", "https://a.com/3")]]
    for epoch, items in enumerate(batches):
        landing = spark.createDataFrame([("a", "https://f/a", rss(*items), NOW + timedelta(hours=epoch))], "source string, url string, body string, retrieved_at timestamp")
        for _ in range(3):  # the stream runs a batch again until it has committed it
            try:
                jobs.ingest_once(landing, epoch, store, sources, legs)
            except Crash:
                continue
            break
        jobs.ingest_once(landing, epoch + 7, store, sources, legs)  # and another stream may see it again
    docs = jobs.committed(spark, store, "documents")
    assert sorted(r.url for r in docs.collect()) == [f"https://a.com/{k}" for k in (1, 2, 3)]
    runs = jobs.committed(spark, store, "runs").orderBy("epoch").collect()
    assert [(r.inserted, r.skipped) for r in runs] == [(2, 0), (1, 1)]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def run(spark, tmp_path, schema, batches, fold, name):
    """All batches, a restart after each; returns all rows that came out, in order."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"{name}-in"))
        q = fold(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return out


def test_topics_like_the_batch_form(rocks, tmp_path):
    spark = rocks
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    a = [(1, ["ai", "mexico"], at(1), 1), (2, ["ai"], at(2), 2), (1, ["mexico"], at(3), 3)]
    b = [(1, [], at(5), 5), (2, ["jewelry", "ai"], at(4), 4), (1, ["ai"], at(6), 6)]
    schema = "document_id long, tags array<string>, request_ts timestamp, seq long"
    got = run(spark, tmp_path, schema, [a, a, b, a], jobs.fold_topics, "topics")  # with replays
    docs = spark.createDataFrame([(k, f"https://x/{k}", f"https://x/{k}", None) for k in (1, 2)], "id long, url string, canonical_url string, flag_reason string")
    reqs = spark.createDataFrame([(f"https://x/{d}", t, "me", ts, s) for d, t, ts, s in a + b], "key string, tags array<string>, reporter string, request_ts timestamp, seq long")
    log = spark.createDataFrame([], "id long, document_id long, topic_slug string, assigned boolean, reporter string, created_at timestamp")
    want, _ = writes.apply_topics(reqs, docs, log)
    assert sorted((r.document_id, r.seq, r.topic_slug, r.assigned) for r in got) == sorted((r.document_id, r.seq, r.topic_slug, r.assigned) for r in want.collect())


def test_reads_like_the_batch_form(rocks, tmp_path):
    spark = rocks
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    a = [(1, "mark", "x", at(1), 1), (1, "mark", "y", at(2), 2), (2, "mark", "x", at(3), 3), (1, "clear", "y", at(4), 4)]
    b = [(1, "mark", "z", at(5), 5), (1, "clear_all", None, at(6), 6), (2, "mark", "w", at(7), 7), (1, "mark", "y", at(8), 8)]
    c = [(1, "mark", "x", at(4), 40), (2, "clear", "x", at(9), 9)]  # the first comes late: all was cleared after it
    schema = "document_id long, op string, reader string, request_ts timestamp, seq long"
    state = {}
    for r in run(spark, tmp_path, schema, [a, b, a, c], jobs.fold_reads, "reads"):
        state[r.document_id, r.reader] = r.read_at
    want = writes.read_state(spark.createDataFrame(a + b + c, schema)).collect()
    assert {k: v for k, v in state.items() if v is not None} == {(r.document_id, r.reader): r.read_at for r in want}


def test_marks_expire(rocks, tmp_path):
    spark = rocks
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    schema = "document_id long, op string, reader string, request_ts timestamp, seq long"
    batches = [[(1, "mark", "x", at(0), 1)], [(2, "mark", "y", at(200), 2)], [(2, "mark", "z", at(201), 3)]]
    got = run(spark, tmp_path, schema, batches, lambda s: jobs.fold_reads(s, keep=3600), "expiry")
    assert (1, "x", None) in [tuple(r) for r in got] and not [r for r in got if r.document_id == 2 and r.read_at is None]
