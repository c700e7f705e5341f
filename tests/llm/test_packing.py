"""Packing: ids against the library, the cuts against a plain search, whole results on odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import packing
from quillspark.llm.queries import op13_order_packing
from tests.llm import cases

MODEL = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(MODEL)


def test_ids_are_the_librarys(library):
    e, r = packing.Encoder(MODEL), random.Random(5)
    assert e.fast is not None
    parts = ["a", "Be", "é", "  ", " ", "\n", "\t", "'s", "'", "9", ".", "<|endoftext|>", "　", "漢", "😀", "\x00", "\x1c", "\x85", "don't", "!?", "ﬁ", "²"]
    for text in [*("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)), " " * 300_000 + "x", "ab" * 30_000]:
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def padded(n, size):
    return 0 if n >= packing.LEAST and n & (n - 1) == 0 else size - n


def test_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 32)
    r = np.random.default_rng(3)
    for _ in range(60):
        gaps = r.integers(1, 60, r.integers(2, 60))
        places = np.concatenate([[0], np.cumsum(gaps)])
        costs = r.choice([0, 4, 24], len(places))
        size = int(r.choice([128, 256]))
        best = [0.0] + [float("inf")] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= size:
                    best[j] = min(best[j], best[i] + padded(n, size) + costs[j])
        path = packing.cuts(places, costs, size)
        assert path[0] == 0 and path[-1] == len(places) - 1
        assert sum(padded(int(places[j] - places[i]), size) + costs[j] for i, j in zip(path, path[1:], strict=False)) == best[-1]


def check(rows, texts, library, size=1024):
    """rows: of the result; texts: by id, as many times as they occur."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    whole = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault(r.doc_id, []).append(r)
    for key, times in texts.items():
        ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in times]
        assert sum(map(len, ids)) == sum(r.length for r in whole[key])
        for r in whole[key]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.crc for x in ids)
        if len(ids) == 1:
            at = 0
            for r in sorted(whole[key], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    assert set(whole) == set(texts)
    return sequences


def test_odd_rows(spark, library):
    docs = cases.odd_docs(spark)
    rows = packing.pack(docs, MODEL).withColumn("crc", F.crc32("ids")).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check(rows, texts, library)
    assert packing.pack(cases.no_docs(spark), MODEL).collect() == []
    with pytest.raises(ValueError, match="of its own"):
        packing.pack(docs.withColumnRenamed("doc_id", "length"), MODEL, id_col="length")


def test_query_on_the_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = op13_order_packing(spark, sf).withColumnRenamed("ids_crc32", "crc").collect()
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sequences = check(rows, texts, library)
    lengths = [sum(r.length for r in p) for p in sequences.values()]
    lost = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert lost < 0.02 * 1024 * len(lengths)


def test_documents_keep_their_order(spark):
    docs = spark.createDataFrame([(i, cases.text(i, 300)) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, MODEL).orderBy("sequence_id", "offset").collect()
    assert [(r.doc_id, r.start) for r in rows] == sorted((r.doc_id, r.start) for r in rows)


def test_blocks_are_settled_one_after_another(library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 4096)
    encoder = packing.Encoder(MODEL)
    stream, out = packing.Stream(encoder, 7, 1024), []
    texts = [cases.text(i, 30 + 97 * (i % 9)) for i in range(60)] + ["word " * 9000]
    for i, t in enumerate(texts):
        stream.add(i, np.append(encoder.encode(t), np.uint32(0)))
        if stream.held >= packing.BLOCK:
            out.append(stream.settle(False))
    out.append(stream.settle(True))
    got = {}
    for o in out:
        for row, start, ids in zip(o["row"], o["start"], o["ids"], strict=True):
            assert len(got.setdefault(row, b"")) == 4 * start
            got[row] += ids
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in got.items()} == {i: [*encoder.encode(t).tolist(), 0] for i, t in enumerate(texts)}
    assert sorted({s for o in out for s in o["sequence_id"]}) == list(range(7, stream.sequence))
