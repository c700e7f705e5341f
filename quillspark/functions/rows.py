"""Helpers over rows and tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often and wherever it is used later.

    A generator that makes one row of one keeps Catalyst from writing the expression into its users.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row however often it is used: it is bound as the element of an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one if there is but one machine; else an error."""
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


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: what follows survives lost executors. The files go when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has at most, for work that costs much a row: adaptive execution puts short rows together in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores as make it none of the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
