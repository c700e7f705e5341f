"""Snapshots of the logs: the same rows as the logs themselves, and few files for few documents."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import effective as eff
from quillspark.operators.states import States
from quillspark.plans import queries as q
from quillspark.sources.tables import Tables

SF = "/root/testdata/sf0.001"


class Cut:
    """The tables with the rows of their logs up to a share of them only."""

    def __init__(self, t, share):
        self.documents = t.documents
        at = lambda log, c: log.filter(F.col(c) <= log.agg(F.percentile_approx(c, share)).first()[0])
        self.importance, self.topics, self.reads = at(t.importance, "id"), at(t.topics, "id"), at(t.reads, "read_at")


def state(df):
    return sorted(map(str, df.select("id", "importance_score", "importance_reporter", "topics", "readers", "read_at", "read_by").collect()))


def test_same_rows_before_and_after_each_version(spark, tmp_path):
    t = Tables(spark, SF)
    want = state(eff.with_state(t.documents, t))
    kept = States(spark, f"file://{tmp_path}/states", buckets=8)
    with_states = Tables(spark, SF, states=kept)
    assert state(eff.with_state(t.documents, with_states)) == want  # no version yet
    for number, share in enumerate((0.3, 0.7, 1.0), 1):
        assert kept.compact(Cut(t, share)) == number
        assert state(eff.with_state(t.documents, with_states)) == want
        for name in ("importance", "topics"):
            n, _ = kept.snapshot(name).count(), getattr(t, name).count()
            assert n == getattr(Cut(t, share), name).select(*[c for c in ("document_id", "topic_slug") if c in getattr(t, name).columns]).distinct().count()


def test_late_rows_within_the_overlap(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "id long, document_id long, score double, reporter string, created_at timestamp"
    rows = [(k, k % 3, k / 10, None, at + timedelta(minutes=k)) for k in range(10)]

    class T:
        importance = spark.createDataFrame([r for r in rows if r[0] != 8], schema)
        topics = spark.createDataFrame([], "id long, document_id long, topic_slug string, assigned boolean, reporter string, created_at timestamp")
        reads = spark.createDataFrame([], "document_id long, reader string, read_at timestamp")
        documents = spark.createDataFrame([(1, "u", "c")], "id long, url string, canonical_url string")

    kept = States(spark, f"file://{tmp_path}/states", buckets=4)
    kept.compact(T)
    full = spark.createDataFrame(rows, schema)  # row 8 was appended after row 9
    got = eff.latest_importance(kept.rows("importance", full, overlap=5)).orderBy("document_id").collect()
    assert [r.id for r in got] == [9, 7, 8]
    with pytest.raises(RuntimeError, match="another job"):
        kept._commit(1, {})


def test_lookup_of_few_opens_few_files(spark, tmp_path):
    t = Tables(spark, SF)
    kept = States(spark, f"file://{tmp_path}/states", buckets=32)
    kept.compact(Cut(t, 0.5))
    s = Tables(spark, SF, states=kept)
    docs = t.documents.select("id", "url", "canonical_url").orderBy("id").limit(3).collect()
    keys = [docs[0].url, docs[1].canonical_url.replace("https", "HTTPS") + "#x", "https://nowhere.example/", f" {docs[0].url} "]
    pick = lambda d: sorted(map(str, d.select("key", "document_id", "title", "importance_score", "topics", "image_texts", "read").collect()))
    want = pick(q.lookup(t, keys))
    assert pick(q.lookup(s, keys)) == want
    by_table = q.lookup(t, spark.createDataFrame([(k.strip(),) for k in dict.fromkeys(k.strip() for k in keys)], "key string"))
    assert pick(by_table) == want
    ids = [docs[0].id]
    rows = kept.rows("importance", t.importance, ids)
    plan = rows._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert len(kept.buckets_of(ids, t.importance.schema["document_id"].dataType)) == 1
    scores = lambda d: [(r.key, r.document_id, r.effective) for r in d.collect()]
    assert scores(q.importance(s, keys=keys[:1])) == scores(q.importance(t, keys=keys[:1]))
    assert len(q.importance(t, True, keys[:1]).collect()) >= 1
    people = {r.id for r in q.human_annotated(t).collect()}
    assert {r.id for r in q.human_annotated(t, [docs[0].id, docs[1].id]).collect()} == people & {docs[0].id, docs[1].id}


@pytest.mark.parametrize("bad", [[], ["x"] * 101, ["  "], [None], ["x" * 2049], "one"])
def test_identifiers_are_checked(spark, bad):
    with pytest.raises(ValueError, match="identifier"):
        q.lookup(Tables(spark, SF), bad)
