"""The composed jobs: ingest, annotation, the backfill plan; and feeds streamed through the ingest."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.plans import jobs
from quillspark.plans import queries as q
from quillspark.sources.tables import Tables
from quillspark.streaming.jobs import ingest_feeds

NOW = datetime(2024, 1, 3)
SF = "/root/testdata/sf0.001"
LONG = "word " * 200


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link><description>{b}</description></item>" for t, u, b in items) + "</channel></rss>"


@pytest.fixture(scope="module")
def landing(spark):
    rows = [
        ("a", "https://f/a", rss(("One", "https://a.com/1", LONG), ("Two", "https://a.com/2", "thin"), ("", "https://a.com/3", "x"), ("One again", "https://a.com/1?u=2", LONG)), NOW),
        ("b", "https://f/b", "<rss><channel></channel></rss>", NOW),
        ("c", "https://f/c", rss(("Lost", "https://c.com/1", LONG)), NOW),
    ]
    return spark.createDataFrame(rows, "source string, url string, body string, retrieved_at timestamp")


def legs(spark):
    return spark.createDataFrame([("https://a.com/2", None, None, None, "HTTP 404")], "url string, primary string, reader string, scrape string, primary_error string")


def sources(spark):
    return spark.createDataFrame([("a",), ("b",)], "name string")


def test_ingest(spark, landing):
    done = jobs.ingest(landing, legs(spark), sources(spark), None, started_at=F.lit(NOW), finished_at=F.lit(NOW))
    assert sorted((r.url, r.title) for r in done.inserted.collect()) == [("https://a.com/1", "One"), ("https://a.com/2", "Two")]
    assert [r.url for r in done.skipped.collect()] == ["https://a.com/1?u=2"]
    assert [(r.source, r.reject_reason) for r in done.unknown_sources.collect()] == [("c", "unknown source")]
    assert [(r.key, r.reason) for r in done.flags.collect()] == [("https://a.com/2", "unrecoverable")]
    runs = {r.source_name: r for r in done.runs.collect()}
    assert (runs["a"].inserted, runs["a"].skipped, runs["a"].parse_skipped, runs["a"].error) == (2, 1, 1, None)
    assert runs["a"].skipped_reasons == ["missing title", "https://a.com/2: primary: HTTP 404; reader: not tried; scrape: not tried"]
    assert (runs["b"].inserted, runs["b"].error) == (0, "empty feed: dead")
    again = jobs.ingest(landing, legs(spark), sources(spark), done.inserted.drop("ordinal"))
    assert again.inserted.count() == 0 and again.skipped.count() == 3


def test_streamed_ingest(spark, landing, tmp_path):
    landing.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in (1, 2):  # a second checkpoint sees the files again
        ingest_feeds(spark, str(tmp_path / "in"), str(tmp_path / f"c{k}"), str(tmp_path / "store"), sources(spark), legs(spark)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store/documents")).count() == 2
    assert spark.read.parquet(str(tmp_path / "store/runs")).filter("source_name = 'a' and epoch = 0").count() == 1


def test_fallback_lanes_and_payloads(spark):
    """Candidates in turn, each source's threshold, posts and pages, payloads and discovery causes."""
    rows = [
        ("a", "https://f/1", "<rss><channel></channel></rss>", NOW, 0),
        ("a", "https://f/2", rss(("Short", "https://a.com/s", "thirty letters of text, not any more"), ("", "https://a.com/x", "x")), NOW, 1),
        ("a", "https://f/3", rss(("Never", "https://a.com/n", LONG)), NOW, 2),
        ("b", "https://f/b", rss(("Short", "https://b.com/s", "thirty letters of text, not any more here")), NOW, 0),
        ("d", "https://f/d1", "<html>Just a moment...</html>", NOW, 0),
        ("d", "https://f/d2", "<rss><channel><item>", NOW, 1),
    ]
    landing = spark.createDataFrame(rows, "source string, url string, body string, retrieved_at timestamp, ordinal int")
    legs = spark.createDataFrame([("https://b.com/s", None, "", LONG, '{"env": 1}')], "url string, primary string, reader string, scrape string, scrape_payload string")
    names = spark.createDataFrame([("a",), ("b",), ("d",), ("p",), ("h",)], "name string")
    policy = spark.createDataFrame([("a", "auto", 10), ("b", "auto", 500)], "name string, mode string, threshold int")
    posts = spark.createDataFrame([("p", '{"url": "https://www.Site.com/reel/Ab1/", "shortCode": "Ab1", "caption": "First line\\nmore", "ownerUsername": "me"}', NOW)], "source string, payload string, retrieved_at timestamp")
    pages = spark.createDataFrame([("h", "https://h.com/1", f"<html><title>T</title><article>{LONG}</article></html>", NOW), ("h", "https://h.com/2", "<html></html>", NOW)], "source string, url string, html string, retrieved_at timestamp")
    done = jobs.ingest(landing, legs, names, None, policy, F.lit(NOW), F.lit(NOW), posts, pages, spark.createDataFrame([("h", "https://h.com/map: unknown root")], "source string, cause string"))
    stored = {r.url: r for r in done.inserted.collect()}
    assert set(stored) == {"https://a.com/s", "https://b.com/s", "https://www.site.com/p/Ab1/", "https://h.com/1"}
    assert stored["https://b.com/s"].content == LONG and stored["https://www.site.com/p/Ab1/"].title == "First line"
    assert done.flags.count() == 0  # 36 letters are enough for a
    assert {r.url: r.payload[:7] for r in done.payloads.collect()} == {"https://b.com/s": '{"env":', "https://www.site.com/p/Ab1/": '{"url":'}
    runs = {r.source_name: r for r in done.runs.collect()}
    assert {n: (r.inserted, r.parse_skipped, r.error) for n, r in runs.items()} == {"a": (1, 1, None), "b": (1, 0, None), "d": (0, 0, "unparseable"), "p": (1, 0, None), "h": (1, 0, None)}
    assert runs["h"].skipped_reasons == ["https://h.com/2: no title or body", "https://h.com/map: unknown root"]
    assert runs["a"].skipped_reasons == ["missing title"] and runs["d"].skipped_reasons is None


def test_merge_causes(spark):
    d = spark.createDataFrame([(["a"], None, ["b", "c"]), (None, None, None)], "x array<string>, y array<string>, z array<string>")
    assert [r[0] for r in d.select(jobs.merge_causes("x", "y", "z")).collect()] == [["a", "b", "c"], None]


def test_targets_and_annotation(spark):
    t = Tables(spark, SF)
    docs = t.documents.select("id", "url", "canonical_url").orderBy("id").limit(60).collect()
    pending = {r.id for r in q.pending(t).collect()}
    people = {r.id for r in q.human_annotated(t).collect()}
    asked = [(0, f" {docs[0].url} "), (1, docs[1].canonical_url), (2, docs[0].url), (3, "https://nowhere.example/"), (4, " ")]
    ids = spark.createDataFrame(asked, "ordinal int, key string")
    assert {r.key: r.place.n for r in jobs.select_targets(t, ids).collect()} == {docs[0].url: 0, docs[1].canonical_url: 1, "https://nowhere.example/": 3}
    assert jobs.select_targets(t).count() == len(pending)
    rows = [(i, "pillar", {"ai": 0.9, "jewelry": 0.1}, "ai", 0.8, None) for i in range(60)] + [(i, "digest", {}, "yes", 0.9, 1.5) for i in range(60)]
    judged = spark.createDataFrame(rows, "document_id long, axis string, probabilities map<string,double>, choice string, confidence double, score double")
    done = jobs.annotate(t, judged, F.lit(NOW), ids, tokens=spark.createDataFrame([(0, 100), (1, 50)], "document_id long, tokens long"))
    free = {0, 1} - people
    assert {r.document_id for r in done.importance.collect()} == free
    causes = {(r.key, r.cause) for r in done.causes.collect()}
    assert ("https://nowhere.example/", "unknown article") in causes
    assert sum(c == "human-annotated; skipped" for _, c in causes) == len({0, 1} & people)
    total = done.totals.first()
    assert (total.annotated, total.skipped) == (len(free), 3 - len(free))


def test_backfill_plan(spark):
    t = Tables(spark, SF)
    ids = sorted(r.id for r in q.backfill_candidates(t).collect())
    pay = spark.createDataFrame([(ids[0], '{"displayUrl":"u0","childPosts":[{"displayUrl":"u1"}]}'), (ids[1], "{}")], "document_id long, payload string")
    frames, counts = jobs.backfill_plan(t, pay)
    assert sorted((r.document_id, r.frame_index, r.url) for r in frames.collect()) == [(ids[0], 0, "u0"), (ids[0], 1, "u1")]
    assert tuple(counts.first()) == (len(ids) - 2, 1)
    assert jobs.backfill_plan(t, pay, cover_only=True)[0].count() == 1


def test_unknown_source_is_rejected(spark):
    t = Tables(spark, SF)
    with pytest.raises(ValueError, match="unknown source: 'nobody'"):
        q.period_bundle(t, datetime(2024, 1, 1), datetime(2024, 1, 9), sources=["src1", "nobody"])
    got = q.period_bundle(t, datetime(2024, 1, 1), datetime(2024, 2, 9), sources=[" src1 "], min_importance=None, topics=[])
    assert {r.source for r in got.collect()} == {"src1"}


def test_source_position(spark):
    rows = [("a", 1, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 1, 3)), ("a", 3, datetime(2024, 1, 2))]
    d = q.source_position(spark.createDataFrame(rows, "source string, id int, published_at timestamp")).orderBy("position", "id")
    assert [r.source for r in d.collect()] == ["b", "a", "a"]


def test_feeds_are_parsed_once_for_items_and_rejects(spark, monkeypatch):
    from quillspark.plans import jobs

    labels, real = [], jobs.written
    monkeypatch.setattr(jobs, "written", lambda d, label: labels.append((label, d)) or real(d, label))
    body = "<rss><channel><item><title>t</title><link>https://a.example/1</link></item><item><title>t</title></item></channel></rss>"
    rows = [("a", "https://a.example/feed", body), ("b", "https://b.example/feed", "<rss><channel><item>"), ("c", "https://c.example/feed", "<rss><channel></channel></rss>")]
    landing = spark.createDataFrame(rows, "source string, url string, body string").selectExpr("*", "timestamp '2024-01-01' AS retrieved_at")
    items, rejects, failed = jobs.chosen_feeds(landing)
    parsing = [d for _, d in labels if "xml" in d._jdf.queryExecution().analyzed().toString().lower()]
    assert len(parsing) == 1  # two before
    assert [(r.source, r.item, r.url) for r in items.collect()] == [("a", 0, "https://a.example/1")]
    assert sorted((r.source, r.item, r.cause) for r in rejects.collect() if r.item is not None) == [("a", 1, "missing link")]
    assert sorted((r.source, r.cause) for r in rejects.collect() if r.item is None) == [("b", "unparseable"), ("c", "empty feed: dead")]
    assert sorted((r.source, r.error) for r in failed.collect()) == [("b", "unparseable"), ("c", "empty feed: dead")]
