"""Where jobs of this subpackage cut their lineage: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
#: Where each table that was written lies.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Tasks over which the rows of one key are dealt at least.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one if there is but one machine (tests); else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _FALLBACK[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        return


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Everything after reads finished files, so a lost executor costs the reading tasks only, and
    joins see real sizes. The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Free the files of tables that nothing reads any more; only for what a later table has replaced."""
    for df in tables:
        if df in _PATHS:
            _remove(df.sparkSession, _PATHS.pop(df))


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of `one`, which has one row a key, however many rows share a key.

    `by` deals the rows of a key over SALTS tasks. The keys and salts that occur are found by a distinct
    (tasks keep one row each of a hot key), get the columns of `one`, and then meet the rows.
    """
    d = rows.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    per = d.select(*on, "_salt").distinct().join(one.hint("merge"), on, "inner")
    return d.join(per.hint("merge"), [*on, "_salt"], how).drop("_salt")


#: Keys that hot_join may broadcast, at most.
HOT_KEYS = 100_000


def hot_join(rows: DataFrame, one: DataFrame, on: str, n: str) -> DataFrame:
    """rows (inner) with the columns of `one`, a written table with a row a key and, as `n`, how many rows have that key.

    Keys of over 1/HOT_KEYS of all these rows (and of 100 at least) are fewer than HOT_KEYS: they are
    broadcast, so their rows stay where they lie. All other keys meet their rows by a shuffle.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    most = max(100, total // HOT_KEYS)
    names = [c for c in one.columns if c not in (on, n)]
    hot = one.filter(F.col(n) > most).select(on, F.struct(*names).alias("_hot"))
    d = rows.join(F.broadcast(hot), on, "left")
    met = d.filter("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in names])
    rest = d.filter("_hot is null").drop("_hot").join(one.filter(F.col(n) <= most).select(on, *names).hint("merge"), on)
    return met.unionAll(rest.select(*rows.columns, *names))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores as make it none of the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row.

    Catalyst writes a projected expression into the lambdas that use it, where it would run once an
    element; it can't do so through a generator, which here makes one row of one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Rows of text that Spark hands to Python at once; texts may be long, and the default is 10,000 rows.
TEXT_ROWS = 500


def by_text(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold TEXT_ROWS rows at most; to be called before mapInArrow."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return df
