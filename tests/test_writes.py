import random
from datetime import datetime

import pandas as pd

from quillspark.operators import writes
from quillspark.operators.judgments import judged, model_input, read_off
from quillspark.operators.upsert import KEYS, guard_sources, upsert_documents

T = [datetime(2024, 1, 1, h) for h in range(9)]
DOC = "id int, url string, canonical_url string, flag_reason string, content string"


def docs(spark):
    return spark.createDataFrame([(1, "https://a.com/1?x", "https://a.com/1", None, "body"), (2, "https://a.com/2", "https://a.com/2", "thin", "body")], DOC)


def sequential(rows, stored=()):
    seen = [{r[k] for r in stored if r[k] is not None} for k in KEYS]
    out = []
    for r in rows:
        if all(r[k] is None or r[k] not in s for k, s in zip(KEYS, seen, strict=True)):
            out.append(r["ordinal"])
            for k, s in zip(KEYS, seen, strict=True):
                s.add(r[k])
    return out


def test_upsert_equals_sequential(spark):
    rng = random.Random(3)
    schema = "ordinal int, url string, canonical_url string, content_hash string"
    cases = [[(1, "u1", "c1", "h1"), (2, "u2", "c2", "h1"), (3, "u2", "c3", "h3")]]
    cases += [[(i, f"u{rng.randint(0, 12)}", f"c{rng.randint(0, 14)}", f"h{rng.randint(0, 12)}") for i in range(25)] for _ in range(2)]
    stored = [(100, "u1", "c99", "h98")]
    names = ["ordinal", *KEYS]
    for k, case in enumerate(cases):
        s = spark.createDataFrame(stored, schema) if k == 1 else None
        inserted, skipped = upsert_documents(spark.createDataFrame(case, schema), s)
        got = sorted(r.ordinal for r in inserted.collect())
        want = sequential([dict(zip(names, r, strict=True)) for r in case], [dict(zip(names, r, strict=True)) for r in stored] if k == 1 else ())
        assert got == want
        assert sorted(got + [r.ordinal for r in skipped.collect()]) == [r[0] for r in case]


def test_guard(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    ok, bad = guard_sources(new, spark.createDataFrame([("a",)], "name string"))
    assert [r.n for r in ok.collect()] == [1]
    assert [(r.n, r.reject_reason) for r in bad.collect()] == [(2, "unknown source")]


def test_importance(spark):
    reqs = spark.createDataFrame([("https://A.com/1", 0.9, "why", "me", T[0], 1), ("https://a.com/2", 0.9, "why", None, T[1], 2), ("https://a.com/3", 0.9, "", None, T[2], 3), ("https://a.com/1", 1.5, "", None, T[3], 4)], "key string, score double, rationale string, reporter string, request_ts timestamp, seq int")
    ok, bad = writes.apply_importance(reqs, docs(spark))
    assert sorted((r.document_id, r.score) for r in ok.collect()) == [(1, 0.9), (2, 0.3)]
    assert sorted((r.seq, r.reject_reason) for r in bad.collect()) == [(3, "unknown document"), (4, "score out of range")]


def test_topics_fold(spark):
    log = spark.createDataFrame([(1, 1, "ai", True, "me", T[0])], "id int, document_id int, topic_slug string, assigned boolean, reporter string, created_at timestamp")
    reqs = spark.createDataFrame([("https://a.com/1", ["Luxury Goods", "ai"], "me", T[1], 1), ("https://a.com/1", [], "me", T[2], 2), ("https://a.com/2", ["nonsense"], "me", T[3], 3)], "key string, tags array<string>, reporter string, request_ts timestamp, seq int")
    ok, bad = writes.apply_topics(reqs, docs(spark), log)
    assert sorted((r.seq, r.topic_slug, r.assigned) for r in ok.collect()) == [(1, "luxury", True), (2, "ai", False), (2, "luxury", False)]
    assert [r.reject_reason for r in bad.collect()] == ["unknown topic"]


def test_reads(spark):
    log = spark.createDataFrame([(1, "mark", "a", T[0], 1), (1, "mark", "b", T[1], 2), (1, "clear", "a", T[2], 3), (2, "mark", "a", T[0], 1), (2, "clear_all", None, T[1], 2), (2, "mark", "c", T[2], 3)], "document_id int, op string, reader string, request_ts timestamp, seq int")
    assert sorted((r.document_id, r.reader) for r in writes.read_state(log).collect()) == [(1, "b"), (2, "c")]


def test_flags(spark):
    reqs = spark.createDataFrame([("https://a.com/1", "other", None, "me", T[0], 1), ("https://a.com/1", "thin", None, "me", T[1], 2), ("https://a.com/1", None, None, "me", T[2], 3), ("https://a.com/2", "truncated", "cut", "me", T[3], 4)], "key string, reason string, detail string, reporter string, request_ts timestamp, seq int")
    ok, bad = writes.apply_flags(reqs, docs(spark))
    assert [(r.seq, r.reject_reason) for r in bad.collect()] == [(1, "detail missing")]
    assert [(r.document_id, r.flag_reason) for r in writes.current_flags(ok).collect()] == [(2, "truncated")]


def test_picks(spark):
    picks = spark.createDataFrame([("2024-01-01", 1, "old", T[0])], "digest_date string, document_id int, reporter string, created_at timestamp")
    reqs = spark.createDataFrame([("2024-01-01", ["https://a.com/2", "https://a.com/1"], None, T[5]), ("2024-01-08", ["https://a.com/1", "https://nowhere"], "me", T[5])], "digest_date string, keys array<string>, reporter string, request_ts timestamp")
    out, bad = writes.record_picks(reqs, picks, docs(spark))
    assert sorted((r.document_id, r.change, r.created_at) for r in out.collect()) == [(1, "kept", T[0]), (2, "added", T[5])]
    assert [r.digest_date for r in bad.collect()] == ["2024-01-08"]


def test_read_off(spark):
    j = spark.createDataFrame(
        [(1, "pillar", {"luxury": 0.5, "ai": 0.3, "consumer-trends": 0.9, "none": 0.9}, "luxury", 0.8, None), (1, "content-type", {}, "news", 0.1, None), (1, "digest", {}, None, 0.9, 4.0), (2, "pillar", {"ai": 0.9}, "ai", 0.4, None), (3, "content-type", {}, "odd", 0.9, None)],
        "document_id int, axis string, probabilities map<string,double>, choice string, confidence double, score double",
    )
    got = {r.document_id: (r.topics, r.score, r.cause) for r in read_off(j).collect()}
    assert got == {1: (["luxury", "ai", "news"], 1.0, None), 2: ([], None, "low-confidence"), 3: ([], None, "unknown content type: odd")}


def test_topics_refused(spark):
    log = spark.createDataFrame([], "id int, document_id int, topic_slug string, assigned boolean, reporter string, created_at timestamp")
    reqs = spark.createDataFrame([("https://a.com/1", ["ai", " "], "me", T[1], 1), ("https://a.com/1", ["ai"], "x" * 101, T[2], 2), ("https://a.com/1", None, "me", T[3], 3), ("https://a.com/1", ["AI"], " " + "x" * 100, T[4], 4)], "key string, tags array<string>, reporter string, request_ts timestamp, seq int")
    ok, bad = writes.apply_topics(reqs, docs(spark), log)
    assert sorted((r.seq, r.reject_reason) for r in bad.collect()) == [(1, "blank topic"), (2, "reporter too long"), (3, "blank topic")]
    assert [(r.topic_slug, r.assigned) for r in ok.collect()] == [("ai", True)]


def test_frame_texts_and_payloads(spark):
    rows = [("https://a.com/1", 0, " no_text. ", T[1]), ("https://a.com/1", 1, "old", T[1]), ("https://a.com/1", 1, "No text here", T[2]), ("https://x.com/9", 0, "lost", T[1])]
    ok, bad = writes.upsert_frame_texts(spark.createDataFrame(rows, "key string, frame_index int, image_text string, created_at timestamp"), docs(spark), "m2")
    assert sorted((r.document_id, r.frame_index, r.image_text, r.model) for r in ok.collect()) == [(1, 0, "NO_TEXT", "m2"), (1, 1, "No text here", "m2")]
    assert [r.reject_reason for r in bad.collect()] == ["unknown document"]
    pay = spark.createDataFrame([("https://a.com/2", "a", T[1]), ("https://a.com/2", "b", T[2])], "key string, payload string, created_at timestamp")
    assert [(r.document_id, r.payload) for r in writes.upsert_newest(pay, docs(spark), ("document_id",), "created_at")[0].collect()] == [(2, "b")]


def test_seeding_clearing_and_backfill(spark):
    seeded = writes.seed_sources(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", "1")], "name string, id string")).collect()
    assert [(r.name, len(r.id)) for r in seeded] == [("b", 36)]
    picks = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "digest_date string, document_id int")
    left, gone = writes.clear_picks(spark.createDataFrame([("d1",), ("d9",)], "digest_date string"), picks)
    assert [r.document_id for r in left.collect()] == [3] and sorted(map(tuple, gone.collect())) == [("d1", 2), ("d9", 0)]
    old = spark.createDataFrame([(1, " me ", T[1]), (2, " ", T[1]), (3, "you", T[2])], "id int, read_by string, read_at timestamp")
    have = spark.createDataFrame([(3, "you", T[0])], "document_id int, reader string, read_at timestamp")
    assert [(r.document_id, r.reader) for r in writes.backfill_reads(old, have).collect()] == [(1, "me")]


def test_scorer(spark):
    def scorer(frames):
        for f in frames:
            yield pd.DataFrame([(i, "pillar", {"ai": 0.9}, "ai", 0.8, None) for i in f["id"]], columns=["document_id", "axis", "probabilities", "choice", "confidence", "score"])

    d = spark.createDataFrame([(1, "t", "s", "c" * 5_000)], "id long, title string, source string, content string")
    assert [(r.document_id, r.topics) for r in read_off(judged(d, scorer)).collect()] == [(1, ["ai"])]
    assert len(model_input(d).first().content) == 3_000


def test_requests_of_one_task_are_dealt_before_their_addresses_are_worked_out(spark):
    docs = spark.createDataFrame([(i, f"https://a.example/{i}?x=1", f"https://a.example/{i}") for i in range(40)], "id long, url string, canonical_url string")
    reqs = spark.createDataFrame([(f" https://A.example/{i}#top ", "thin", None, "me", datetime(2024, 1, 1), i) for i in range(40)], "key string, reason string, detail string, reporter string, request_ts timestamp, seq long").coalesce(1)
    ok, bad = writes.apply_flags(reqs, docs)
    assert sum("flag-requests" in f for f in set(ok.inputFiles())) > 1  # one task did all rows before
    assert sorted(r.document_id for r in ok.collect()) == list(range(40)) and bad.count() == 0
