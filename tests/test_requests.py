"""Rules over request tables."""

from datetime import date

from pyspark.sql import functions as F

from quillspark.operators import requests


def test_checked_form_and_all_reasons(spark):
    rows = [("2024-02-30", ["a"], None), (" 2024-02-28T23:00:00Z ", [" a "], " me "), ("2024-02-28", [], " "), ("28.2.2024", None, "x" * 101)]
    good, bad = requests.validate(spark.createDataFrame(rows, "digest_date string, keys array<string>, reporter string"), "picks")
    assert [tuple(r) for r in good.collect()] == [(date(2024, 2, 28), ["a"], "me"), (date(2024, 2, 28), [], None)]
    assert [r.reject_reasons for r in bad.collect()] == [["digest_date must be an ISO date"], ["digest_date must be an ISO date", "identifiers missing", "reporter too long"]]


def test_reads_search_and_topics(spark):
    reads = spark.createDataFrame([("u", "mark", "me"), ("u", "mark", " "), ("u", "clear_all", None), (None, "burn", None), ("u", None, None)], "key string, op string, reader string")
    assert [r[0] for r in reads.select(requests.reject_reasons("reads")).collect()] == [[], ["reader missing"], [], ["identifier missing", "unknown operation"], ["unknown operation"]]
    search = spark.createDataFrame([("k", None, None, None), (" ", 0, float("nan"), ["a", None]), ("k", 100, 1.0, [])], "keyword string, limit int, min_importance double, topics array<string>")
    assert [r[0] for r in search.select(requests.reject_reasons("search")).collect()] == [[], ["keyword missing", "limit must be 1 to 100", "min_importance must be 0 to 1", "topic tags must not be blank"], []]
    topics = spark.createDataFrame([("u", None, None), ("u", [], None), ("u", ["ai", ""], None)], "key string, tags array<string>, reporter string")
    assert [r[0] for r in topics.select(requests.reject_reasons("topics")).collect()] == [["tags missing"], [], ["topic tags must not be blank"]]
    assert requests.validate(topics.limit(0), "topics")[0].count() == 0
    assert topics.select(F.size(requests.reject_reasons("lookup"))).count() == 3
