"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.tables import dropped, new_path, shared_folder, shuffles_dropped, written

__all__ = ["BLANKS", "WORD", "ascii_lower", "bucketed", "dropped", "shared_folder", "small_batches", "words", "written"]

#: A word is a maximal run of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def bucketed(df: DataFrame, key: str, name: str = "t", rows_each: int = 20_000) -> DataFrame:
    """``df`` as a table that is dealt out by ``key`` once: joins on it shuffle the other side alone.

    There are as many buckets as shuffle partitions at least, and more with more rows.
    """
    spark = df.sparkSession
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_each))  # Spark's most buckets
    table = f"textloom_{name}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows to a Python worker at once, from now on in this session.

    Ten thousand whole texts, Spark's own limit, are tens of megabytes in each worker and as many beside it in the JVM.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    # trimming and splitting is several times cheaper than matching each word
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
