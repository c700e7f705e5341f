"""Keyword search over an index of character trigrams by file, with the exact ILIKE after it.

The index says which trigrams of lower-cased title or content occur in which file of the documents. A
keyword's literal pieces of three characters or more, between its wildcards, must have all their trigrams
in a file for any document of it to match, so only such files are read; the match itself is tested on the
texts. A keyword without such a piece reads all files. Files are indexed once; update() adds what is new,
and files that aren't indexed yet are always read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.rows import fixed

GRAM = 3
BUCKETS = 64
#: Characters of a text whose trigrams are made at once.
PIECE = 4096
#: Pieces of a text, in one walk through it; each goes GRAM - 1 characters into the next, so that no trigram is lost.
PIECES = rf"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"
#: Characters whose trigrams are sorted at once.
SORTED = 1 << 20


def like(kw: str, *columns: str) -> Column:
    """Any of the columns holds the keyword in any case; % and _ in it match as in LIKE."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{kw}%"), F.lit(False))
    return out


def pieces(kw: str) -> list[str]:
    """The literal parts of a keyword between its wildcards; a backslash makes the next character literal."""
    out, part, literal = [], "", False
    for c in kw:
        if literal or c not in "%_\\":
            part, literal = part + c, False
        elif c == "\\":
            literal = True
        else:
            out.append(part)
            part = ""
    return [p for p in [*out, part] if p]


def _distinct_grams(texts: list[str]) -> list[str]:
    """The different trigrams of the texts; none goes from one text into the next."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return []
    keys = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    ends = np.cumsum([len(x) for x in texts])
    inside = np.ones(len(codes), bool)
    for back in range(1, GRAM):
        inside[ends[ends >= back] - back] = False
    u = np.unique(keys[inside[: len(keys)]])
    text = np.stack([u >> np.uint64(42), u >> np.uint64(21) & np.uint64(0x1FFFFF), u & np.uint64(0x1FFFFF)], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, part) to (file, gram), each trigram once for about SORTED characters of a file."""

    def out(file: str, parts: list[str]) -> pa.RecordBatch:
        g = _distinct_grams(parts)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(g), pa.string()), pa.array(g, pa.string())], names=["file", "gram"])

    held: dict[str, tuple[list[str], int]] = {}
    for batch in batches:
        for file, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts, size = held.pop(file, ([], 0))
            parts.append(part)
            held[file] = (parts, size + len(part))
            if held[file][1] >= SORTED:
                yield out(file, held.pop(file)[0])
        for file in list(held)[:-1]:  # a task reads one file after the other
            yield out(file, held.pop(file)[0])
    for file, (parts, _) in held.items():
        yield out(file, parts)


def grams(texts: DataFrame) -> DataFrame:
    """The different (file, gram) of (file, text): the trigrams of the texts in lower case.

    A text is lower-cased once, whole, and cut in one walk, so the work grows with its length.
    """
    d = fixed(texts.select("file", F.lower("text").alias("_low")), "_parts", F.regexp_extract_all("_low", F.lit(PIECES), F.lit(1)))
    return d.select("file", F.explode("_parts").alias("part")).mapInArrow(_grams, "file string, gram string").distinct()


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class KeywordIndex:
    """The index at `path` of the Parquet documents at `documents`."""

    def __init__(self, spark: SparkSession, path: str, documents: str, columns: tuple[str, ...] = ("title", "content")):
        self.spark, self.path, self.documents, self.columns = spark, path.rstrip("/"), documents, columns

    def _read(self, name: str, schema: str) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _docs(self, files: list[str] | None = None) -> DataFrame:
        schema = self.spark.read.parquet(self.documents).schema
        if files is not None and not files:
            return self.spark.createDataFrame([], schema)
        # files of a partitioned table keep their partition columns
        return self.spark.read.schema(schema).option("basePath", self.documents).parquet(*(files or [self.documents]))

    def _files(self) -> list[str]:
        return [re.sub("^file:/+", "file:///", f) for f in self._docs().inputFiles()]

    def update(self) -> int:
        """Index the files that aren't yet; how many."""
        done = self._read("files", "file string")
        have = set() if done is None else {r[0] for r in done.collect()}
        new = [f for f in self._files() if f not in have]
        if not new:
            return 0
        docs = self._docs(new).withColumn("file", F.regexp_replace("_metadata.file_path", "^file:/+", "file:///"))
        texts = docs.select("file", F.explode(F.array(*self.columns)).alias("text")).filter("text is not null")
        rows = grams(texts)
        rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/grams")
        # named last: a file whose trigrams are only half written is still read by every search
        self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{self.path}/files")
        return len(new)

    def files(self, kw: str) -> list[str]:
        """The files that may hold the keyword, as many as the table has at most."""
        every = self._files()
        wanted = sorted({p.lower()[i : i + GRAM] for p in pieces(kw) for i in range(len(p.lower()) - GRAM + 1)})
        done, posted = self._read("files", "file string"), self._read("grams", "gram string, file string, bucket int")
        if not wanted or done is None or posted is None:
            return every
        have = {r[0] for r in done.collect()}
        one = self.spark.range(1).select(*[_bucket(F.lit(g)).alias(f"b{i}") for i, g in enumerate(wanted)]).first()
        hit = posted.filter(F.col("bucket").isin(sorted(set(one))) & F.col("gram").isin(wanted)).distinct().groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        may = {r[0] for r in hit.select("file").collect()}
        return [f for f in every if f in may or f not in have]

    def search(self, kw: str) -> DataFrame:
        """The documents that hold the keyword, in the columns of the table."""
        return self._docs(self.files(kw)).filter(like(kw, *self.columns))
