"""Table reads and lineage cuts that every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few short columns, about 100 bytes each) that a table sent to every executor holds at most.
BROADCAST_ROWS = 100_000
_LOCAL: dict[str, str] = {}
_SCOPE: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_SCOPE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table; a folder that is gone already is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside lie in one folder, which is deleted at the end: write what is to stay before, outside of it."""
    folder = new_path(spark, "scratch")
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        forget(spark, folder)


def cut(df: DataFrame, name: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: no lineage, no second evaluation.

    instead_of is a cut table that nothing but df has been made from (the round before, in a loop):
    it is deleted once df is written. Other tables stay until their `scratch` ends, or for good.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead_of is not None:
        forget(spark, instead_of._cut_path)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast where it has at most so many rows, which is counted first; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
