"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of 1,024 bytes (the last may be shorter); each is compressed with either
dictionary. The difference of the two sizes over the block's size says which dictionary knows the
text better. A document's features are the mean difference, the mean of the worst quarter of its
blocks, its compressed size over its size, and whether it is short; a logistic fit on labelled texts
that aren't in the dictionaries makes them a probability.

Null and empty texts have all features 0 and get the score of that. Very long texts are compressed
whole, block by block. Repeated rows are scored alike. Other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.labelled import logistic, sample
from quillspark.llm.store import by_text, table

#: Labelled rows that are fitted on at most, about; those of each class that the dictionaries see.
MAX_TRAIN_ROWS = 20_000
MAX_DICTIONARY_ROWS = 1_500
#: Bytes of them that the driver gets for each class, about.
MAX_DICTIONARY_TEXT = 32 << 20
DICTIONARY_BYTES = 112_640
BLOCK = 1024
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray


def _blocks(texts) -> list[bytes]:
    return [b[i : i + BLOCK] for b in texts for i in range(0, len(b), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of whole texts, dealt in blocks; too little text for training is used raw."""
    blocks = _blocks(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b" " * 16


class Measure:
    """Both compressors; made once a task."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes | None) -> list[float]:
        if not text:
            return [0.0] * 4
        parts = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        if len(parts) > 1 and len(parts[-1]) < BLOCK // 4:
            parts[-2:] = [parts[-2] + parts[-1]]
        good, bad = ([len(c.compress(p)) for p in parts] for c in self.by)
        diff = sorted((b - g) / len(p) for g, b, p in zip(good, bad, parts, strict=True))
        worst = diff[: max(1, len(diff) // 4)]
        n = len(text)
        return [(sum(bad) - sum(good)) / n, sum(worst) / len(worst), min(1.0, sum(good) / n), 64.0 / (64.0 + n)]


def fit(docs: DataFrame, labels: DataFrame, by: int = 3, held: int = 1, max_rows: int = MAX_TRAIN_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on labelled rows whose crc32(id) modulo `by` isn't `held`; about max_rows at most.

    The dictionaries are trained on the driver from at most about MAX_DICTIONARY_ROWS whole texts of each
    class, of MAX_DICTIONARY_TEXT bytes together. Without labels of both kinds every text gets the share of good labels, or 0.5.
    """
    rows = table(sample(docs, labels, label, by, held, max_rows, id_col, text_col), "quality-sample")
    got = rows.filter("_part < 6").groupBy("_label").agg(F.count("*"), F.sum(F.octet_length("_text"))).collect()
    counts, sizes = {r[0]: r[1] for r in got}, {r[0]: r[2] for r in got}
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for y, n in counts.items():
        share = min(1.0, MAX_DICTIONARY_ROWS / n, MAX_DICTIONARY_TEXT / max(sizes[y], 1))
        picked = rows.filter((F.col("_part") < 6) & (F.col("_label") == y) & (F.pmod(F.xxhash64("_text", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)))
        texts[y] = [r[0].encode() for r in picked.select("_text").collect()]
    if not texts[0] or not texts[1]:
        n = sum(counts.values())
        p = min(0.99, max(0.01, counts.get(1, 0) / n)) if n else 0.5
        return QualityModel(b" " * 16, b" " * 16, np.array([0, 0, 0, 0, np.log(p / (1 - p))]))
    m = QualityModel(dictionary(sorted(texts[1])), dictionary(sorted(texts[0])), np.zeros(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(m.good, m.bad)
        for batch in batches:
            x = [measure.features(t.encode()) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    part = by_text(rows.filter("_part >= 6").select("_text", "_label")).mapInArrow(run, "y int, x array<double>").toArrow().to_pandas()
    if part.empty:
        return m
    m.weights = logistic(np.array(part["x"].tolist()), part["y"].to_numpy(float), ridge=1e-6)
    return m


def score(docs: DataFrame, m: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, size_difference, compressed_share): score is 0 to 1, higher for good text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(m.good, m.bad)
        for batch in batches:
            x = np.array([measure.features((t.as_py() or "").encode()) for t in batch.column(1)]).reshape(-1, 4)
            z = np.clip(x @ m.weights[:4] + m.weights[4], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z))), pa.array(x[:, 0]), pa.array(x[:, 2])], names=[id_col, "score", "size_difference", "compressed_share"])

    d = T.DoubleType()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", d), T.StructField("size_difference", d), T.StructField("compressed_share", d)])
    return by_text(docs.select(id_col, text_col)).mapInArrow(run, schema)
