"""The three-key upsert against one row after the other."""

import random

import pytest

from quillspark.operators import upsert
from quillspark.operators.upsert import upsert_documents

SCHEMA = "ordinal int, url string, canonical_url string, content_hash string, n int, _row string"


def plain(rows, stored=()):
    """Numbers of the rows that are inserted: in the order of ordinal and keys."""
    have = [{s[k] for s in stored if s[k] is not None} for k in range(3)]
    first = lambda x: (x is not None, x)
    out = []
    for r in sorted(rows, key=lambda r: tuple((v is not None, v or (0 if k == 0 else "")) for k, v in enumerate(r[:4]))):
        if not any(v is not None and v in have[k] for k, v in enumerate(r[1:4])):
            out.append(r[:4])
            for k, v in enumerate(r[1:4]):
                if v is not None:
                    have[k].add(v)
    return sorted(out, key=lambda r: [first(v) for v in r])


def got(done):
    first = lambda x: (x is not None, x)
    return sorted((tuple(r)[:4] for r in done.inserted.collect()), key=lambda r: [first(v) for v in r])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ties", [1, 4])
def test_like_one_after_the_other(spark, seed, ties):
    r = random.Random(seed)
    key = lambda p, n: None if r.random() < 0.1 else f"{p}{r.randrange(n)}"
    rows = [(i // ties if r.random() < 0.95 else None, key("u", 90), key("c", 60), key("h", 70), i, "x") for i in range(150)]
    stored = [(f"u{k}", f"c{100 + k}", f"h{k + 3}") for k in range(5)]
    new = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = upsert_documents(new, None)
    assert got(done) == plain(rows)
    assert done.inserted.columns == new.columns and done.inserted.count() + done.skipped.count() == len(rows)
    known = spark.createDataFrame(stored, "url string, canonical_url string, content_hash string")
    assert got(upsert_documents(new, known)) == plain(rows, stored)


def test_the_same_row_twice_is_stored_once(spark):
    rows = [(1, "u", "c", "h", 1, "x"), (1, "u", "c", "h", 2, "y"), (None, None, None, None, 3, "z"), (None, None, None, None, 4, "z")]
    done = upsert_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), None)
    inserted = [tuple(r) for r in done.inserted.collect()]
    assert sum(r[1] == "u" for r in inserted) == 1 and sum(r[1] is None for r in inserted) == 2
    assert done.skipped.count() == 1
    none = upsert_documents(spark.createDataFrame([], SCHEMA), None)
    assert (none.inserted.count(), none.skipped.count(), none.rounds) == (0, 0, 0)


def test_hot_content_takes_two_rounds(spark, monkeypatch):
    """A third of all rows has one content; whether that key is broadcast or not."""
    rows = [(i, f"u{i}", f"c{i}", "hot" if i % 3 == 0 else f"h{i // 2}", i, "x") for i in range(6000)]
    new = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for most in (upsert.HOT_KEYS, 1):
        monkeypatch.setattr(upsert, "HOT_KEYS", most)
        done = upsert_documents(new, None)
        assert got(done) == plain(rows) and done.rounds <= 2


def test_a_chain_takes_half_its_rows(spark):
    rows = [(i, f"u{i // 2}", f"c{(i + 1) // 2}", f"h{i}", i, "x") for i in range(12)]
    done = upsert_documents(spark.createDataFrame(rows, SCHEMA), None)
    assert got(done) == plain(rows) and done.rounds == 6
