"""Latest-wins states kept up to date: a compacted snapshot of each log by document, and the rows that came since.

A snapshot holds the newest row of each key and lies in folders by a hash of the document, so that a lookup
of few documents opens few of them. Merging is idempotent: a row that the snapshot has already changes
nothing, so the rows since are taken from the snapshot's mark on, less an overlap for rows that were
numbered before it but appended after. What comes out is a log like the given one, only short; all that
groups a log by document gives the same rows on it. An identity map, from addresses and canonical addresses
to documents, lies beside it, by a hash of the address.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as fn

BUCKETS = 64


@dataclass(frozen=True)
class Kept:
    """How a log is compacted: keys, order of its rows, the column whose maximum is the snapshot's mark, whether it has one row a key itself."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    mark: str
    single: bool = False


def newest(rows: DataFrame, kept: Kept) -> DataFrame:
    """The newest row of each key."""
    values = [c for c in rows.columns if c not in kept.keys]
    d = rows.groupBy(*kept.keys).agg(F.max_by(F.struct(*values), F.struct(*kept.order)).alias("_v"))
    return d.select(*[c if c in kept.keys else F.col(f"_v.{c}").alias(c) for c in rows.columns])


LOGS = {
    "importance": Kept(("document_id",), ("created_at", "id"), "id"),
    "topics": Kept(("document_id", "topic_slug"), ("created_at", "id"), "id"),
    "reads": Kept(("document_id", "reader"), ("read_at",), "read_at", True),
}


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class States:
    """Snapshots under `path`, one folder a version; a version counts once a file names it, so readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> tuple[int, dict]:
        """(number, mark and schema of each log) of the newest version; 0 before the first."""
        fs, p = self._fs(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/versions/{done[-1]}", wholetext=True).first()[0]
        return done[-1], json.loads(text)

    def _commit(self, number: int, what: dict) -> None:
        fs, aside = self._fs(f"{self.path}/versions/_{number}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if not fs.rename(aside, self._fs(f"{self.path}/versions/{number}")[1]):
            raise RuntimeError(f"version {number} was written by another job")

    def snapshot(self, name: str) -> DataFrame | None:
        number, logs = self.version()
        return self._read(name, number, logs[name]["schema"]) if number else None

    def _read(self, name: str, number: int, schema: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{self.path}/{name}/version={number}")

    def _write(self, rows: DataFrame, name: str, number: int, key: str) -> dict:
        """Write rows by the bucket of a key; their schema."""
        by = rows.withColumn("bucket", bucket(F.col(key), self.buckets))
        by.repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={number}")
        return by.schema.jsonValue()

    def buckets_of(self, keys: list, kind: T.DataType) -> list[int]:
        """The folders that a few keys of a type lie in."""
        one = self.spark.range(1).select(*[bucket(F.lit(k).cast(kind), self.buckets).alias(f"b{i}") for i, k in enumerate(keys)])
        return sorted(set(one.first())) if keys else []

    def rows(self, name: str, log: DataFrame, ids: list | None = None, overlap: int = 0) -> DataFrame:
        """A short log with the state of `log`: the snapshot's rows, and those from its mark on.

        ids: the state of these documents only; then no other folder of the snapshot is opened. overlap: how
        far below the mark, where it is a number, a late row may be numbered.
        """
        number, logs = self.version()
        new = log if ids is None else log.filter(F.col("document_id").isin(ids))
        if not number:
            return new
        mark = logs[name]["mark"]
        if mark is not None:
            low = F.lit(mark).cast(log.schema[LOGS[name].mark].dataType)
            counted = log.schema[LOGS[name].mark].dataType.typeName() in ("long", "integer")
            new = new.filter(F.col(LOGS[name].mark) >= (low - overlap if overlap and counted else low))
        old = self.snapshot(name)
        if ids is not None:
            old = old.filter(F.col("bucket").isin(self.buckets_of(ids, log.schema["document_id"].dataType)) & F.col("document_id").isin(ids))
        rows = old.select(log.columns).unionByName(new)
        return newest(rows, LOGS[name]) if LOGS[name].single else rows

    def compact(self, tables, overlap: int = 0) -> int:
        """Write the next version from the last one and the rows since; its number. tables: what has the logs and the documents as attributes."""
        number, logs = self.version()[0] + 1, {}
        for name, kept in LOGS.items():
            rows = newest(self.rows(name, getattr(tables, name), overlap=overlap), kept)
            schema = self._write(rows, name, number, "document_id")
            mark = self._read(name, number, schema).agg(F.max(kept.mark).cast("string")).first()[0]
            logs[name] = {"mark": mark, "schema": schema}
        docs = tables.documents
        maps = docs.select(F.lit(0).alias("kind"), F.col("url").alias("key"), F.col("id").alias("document_id")).unionAll(docs.select(F.lit(1), "canonical_url", "id"))
        logs["identity"] = {"mark": None, "schema": self._write(maps.filter("key is not null"), "identity", number, "key")}
        self._commit(number, logs)
        return number

    def identify(self, identifiers: list[str]) -> DataFrame:
        """(key, document_id) of a few addresses: the document of that address, else the least one of that canonical address; null for none."""
        if not self.version()[0]:
            raise LookupError("no version has been written")
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(identifiers)], "key string")
        asked = asked.select("key", F.trim("key").alias("_exact"), fn.canonicalize_url(F.col("key")).alias("_canon"))
        keys = [v for r in asked.collect() for v in (r._exact, r._canon) if v is not None]
        maps = self.snapshot("identity").filter(F.col("bucket").isin(self.buckets_of(keys, T.StringType())) & F.col("key").isin(keys))
        maps = maps.groupBy("kind", F.col("key").alias("_k")).agg(F.min("document_id").alias("_id"))
        out = asked
        for kind, on in ((0, "_exact"), (1, "_canon")):
            part = maps.filter(F.col("kind") == kind).select(F.col("_k").alias(on), F.col("_id").alias(f"_d{kind}"))
            out = out.join(F.broadcast(part), on, "left")  # at most a row for each key asked for
        return out.select("key", F.coalesce("_d0", "_d1").alias("document_id"))
