"""Intermediate results as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset and the
    master is local (tests), a temporary folder is made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="textloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a query ends: what is written needs them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost
    executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame, key: str, n: int, name: str = "t") -> DataFrame:
    """``df`` as a table in ``n`` buckets of ``key``: joins and groups by it shuffle the other side alone. Tasks should have few keys each."""
    spark = df.sparkSession
    table = f"textloom_{name}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.bucketBy(n, key).option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that is no longer read."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
