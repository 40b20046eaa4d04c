"""The relations that all operators share: prepared units, tokens, document-feature counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.tables import written


def prepared(units: DataFrame, unit: str = "doc_id", text: str = "text", toks: Column | None = None, *carry: str) -> DataFrame:
    """(unit_id, tokens, ...): one row a unit; units without tokens stay."""
    made = tokens(F.col(text)) if toks is None else toks
    return units.select(F.col(unit).alias("unit_id"), made.alias("tokens"), *carry)


def token_rel(prep: DataFrame, *carry: str) -> DataFrame:
    """(unit_id, pos, term, ...): one row a token."""
    # the outer form, as a plain explode makes the planner filter by size first, which tokenises once more
    return prep.select("unit_id", *carry, F.posexplode_outer("tokens").alias("pos", "term")).where(F.col("term").isNotNull())


def dfm(rel: DataFrame) -> DataFrame:
    """(unit_id, term, count): the document-feature matrix in long form."""
    return rel.groupBy("unit_id", "term").agg(F.count("*").alias("count"))


def running(rows: DataFrame, by: Sequence[Column], values: Mapping[str, Column], how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds running sums (or, by ``how``, minima) of values over one order of all rows, each row included.

    Rows are dealt into ranges of the order, which are summed by themselves; what precedes a range is added, from one
    row for each range. So no task holds more than a range.
    """
    dealt = written(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("_part").agg(*[how(c).alias(f"_{name}") for name, c in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", *[how(f"_{name}").over(earlier).alias(f"_{name}") for name in values])
    together = lambda a, b: F.coalesce(a + b, b) if how is F.sum else F.least(a, b)
    made = dealt.withColumns({f"_own_{name}": how(c).over(within) for name, c in values.items()}).join(starts, "_part")
    return made.select(*rows.columns, *[together(F.col(f"_{name}"), F.col(f"_own_{name}")).alias(name) for name in values])


def drawn(seed: int, *keys: Column) -> Column:
    """A number of 32 bits for the keys, by MD5: the same on any cluster and in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)
