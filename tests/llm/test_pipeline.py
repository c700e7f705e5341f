import collections

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert len(seen["toxicity"]) == len(seen["line_dedup"]) > 0.8 * len(before)
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    texts = collections.Counter(r.text for r in seen["near_dedup"])
    assert max(texts.values()) == 1
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in r.text for r in seen["decontamination"] for x in items)
    assert {r.doc_id for r in seen["mixing"]} == {r.doc_id for r in seen["decontamination"]}


def test_run_and_entry(spark):
    import __spark_entry__ as e

    assert "pipeline" in e.queries()
    assert sum(n.startswith("op") for n in e.queries()) == 10
    assert corpus_pipeline.run(spark, SF).agg(F.sum("taken")).first()[0] > 0
