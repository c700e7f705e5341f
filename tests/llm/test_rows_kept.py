"""One result a row, and columns as they were, whatever ids, blocks, names and odd rows."""

import random
import re
import time

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, lines, toxicity
from quillspark.llm.store import table
from tests.llm.cases import labels, no_docs, odd_docs, text


def test_many_blocks_of_items_keep_a_row_for_each_row(spark, monkeypatch):
    items = [(f"i{k}", text(900 + k, 30)) for k in range(23)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(k % 4 if k % 5 else None, f"{text(k, 80)} {items[k % 23][1] if k % 2 else ''} {text(k + 50, 80)} {items[(k * 7) % 23][1] if k % 3 == 0 else ''}") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r or -1, sorted(i for i, w in items if w in t)) for r, t in rows)
    for block in (5, 2_000):
        monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", block)
        got = decontaminate.contaminated(d, bench).collect()
        assert sorted((r.doc_id or -1, list(r.item_ids)) for r in got) == want
        assert decontaminate.drop_contaminated(d, bench).count() == sum(not w for _, w in want)


CLASHING = ("_gone", "_gid", "_gk", "n_lines", "n_removed", "_N_LINES", "_keep", "_turn", "_text", "_lines")


def test_line_dedup_takes_any_names(spark):
    passage = "\n".join(text(500 + k, 9) for k in range(6))
    rows = [(1, f"{passage}\nend one"), (2, f"start two\n{passage}"), (None, f"{passage}"), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in CLASHING))
    out = lines.dedup_lines(d)
    assert out.columns[: len(d.columns)] == d.columns and len(set(c.lower() for c in out.columns)) == len(out.columns)
    got = {r[0]: r for r in out.collect()}
    assert all(r[2 : len(d.columns)] == (7,) * len(CLASHING) for r in got.values())
    assert got[1][1] == rows[0][1] and got[2][1].startswith("start two") and len(got[2][1]) < 60 and got[3][1] is None


def test_plain_lines(spark):
    """cut=LINE_FEEDS: windows of three physical lines, against a plain version."""
    r = random.Random(2)
    pool = [text(k, 6, end="; ") for k in range(12)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(40)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), cut=lines.LINE_FEEDS).collect()}
    seen: set = set()
    for i, t in sorted(rows):
        own = re.split(r"(?<=\n)", t)
        covered, new = set(), []
        for p in range(len(own) - 2):
            w = tuple(x.strip(" ") for x in own[p : p + 3])
            if sum(map(len, own[p : p + 3])) < lines.MIN_CHARS:
                continue
            if w in seen or w in new:
                covered |= {p, p + 1, p + 2}
            else:
                new.append(w)
        seen |= set(new)
        assert got[i] == "".join(x for p, x in enumerate(own) if p not in covered), i


def test_linear_segments():
    """Against the definition (the best segment, then the same on either side), and in time that doubles with the length."""
    r = random.Random(4)

    def split(s, lo, hi):
        total, i, j = max(((sum(s[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        return [] if total <= 0 else [*split(s, lo, i), (round(total, 6), i, j - 1), *split(s, j, hi)]

    for _ in range(150):
        s = [r.uniform(-3, 2) for _ in range(r.randint(1, 40))]
        assert [(round(v, 6), a, b) for v, a, b in toxicity.segments(s)] == split(s, 0, len(s))
    took = []
    for n in (20_000, 80_000):  # falling sums: every search has all earlier candidates before it
        start = time.perf_counter()
        toxicity.segments([x for k in range(n) for x in (1.0, -1.5)])
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.2


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    labels(spark, [(k, k % 2, (k + 1) % 2) for k in range(6)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", text(3, 40)), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs(spark), no_docs(spark)):
        docs = table(docs.withColumn("n_removed", F.lit(1)), "test-odd")
        for name, stage in corpus_pipeline.STAGES:
            out = table(stage(spark, docs, str(tmp_path)), "test-stage")
            if name != "mixing":
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            docs = out if name != "mixing" else docs
        assert out.count() == docs.count()
