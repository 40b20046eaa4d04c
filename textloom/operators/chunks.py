"""Headings, parent windows and overlap of chunks, and repeated edge lines of paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = " \t\n\r\x0b\x0c"


def paragraphs_of(text: Column) -> Column:
    """Stripped, non-empty parts between blank lines."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(_BLANK))), lambda p: p != "")


def heading_of(paragraph: Column) -> Column:
    """The heading that a paragraph opens with: a line after one to six "#", or a line above "===" or "---"; else null."""
    marked = F.regexp_extract(paragraph, r"\A#{1,6}[ \t]+(\S[^\n]*)", 1)
    under = F.regexp_extract(paragraph, r"\A([^\n]{1,80})\n[=-]{3,}[ \t]*(?:\n|\z)", 1)
    return F.nullif(F.btrim(F.coalesce(F.nullif(marked, F.lit("")), under)), F.lit(""))


def with_headings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, text, heading): paragraphs with the nearest heading at or before them, null before the first."""
    made = docs.select(F.col(doc).alias("doc_id"), F.posexplode(paragraphs_of(F.col(text))).alias("position", "text"))
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return made.select("doc_id", "position", "text", F.last(heading_of(F.col("text")), ignorenulls=True).over(before).alias("heading"))


def parent_windows(leaves: DataFrame, boundary: Column, size: int = 3) -> DataFrame:
    """``leaves`` (doc_id, position, ...) with parent: -1, -2, ... for each run of up to ``size`` leaves within a boundary."""
    order = Window.partitionBy("doc_id").orderBy("position")
    new = F.coalesce(~F.lag(boundary).over(order).eqNullSafe(boundary), F.lit(True)).cast("int")
    runs = leaves.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    within = Window.partitionBy("doc_id", "_run").orderBy("position")
    opened = runs.withColumn("_open", ((F.row_number().over(within) - 1) % size == 0).cast("int"))
    return opened.withColumn("parent", -F.sum("_open").over(order)).drop("_new", "_run", "_open")


def overlap_chars(left: Column, right: Column, least: int = 32, most: int = 4000) -> Column:
    """Length of the longest end of one text that the next begins with; 0 below ``least``. ``most`` is the longest chunk's."""

    def one(a: str | None, b: str | None) -> int:
        if a is None or b is None or min(len(a), len(b)) < least:
            return 0
        head = b[:least]  # an end can only begin where the next text's first characters stand
        at = a.find(head, max(0, len(a) - min(len(b), most)))
        while at >= 0 and not b.startswith(a[at:]):
            at = a.find(head, at + 1)
        return len(a) - at if at >= 0 else 0

    @F.pandas_udf("int")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")

    return overlap(left, right)


def without_edge_lines(text: Column, least_length: int = 8, repeats: int = 3, least_paragraphs: int = 4) -> Column:
    """Drops lines that head, or end, at least ``repeats`` paragraphs; texts of few paragraphs stay as they are."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+"), lambda p: F.btrim(p, F.lit(_BLANK)) != "")
    strip = lambda x: F.btrim(x, F.lit(_BLANK))

    def cleaned(paragraphs: Column) -> Column:
        lines = F.transform(paragraphs, lambda p: F.split(p, "\n"))
        filled = F.transform(lines, lambda x: F.filter(F.transform(x, strip), lambda y: y != ""))

        def common(at: int) -> Column:
            edge = F.filter(F.transform(filled, lambda x: F.try_element_at(x, F.lit(at))), lambda y: F.length(y) >= least_length)
            return F.array_distinct(F.filter(edge, lambda y: F.size(F.filter(edge, lambda z: z == y)) >= repeats))

        def cut(bound: Column) -> Column:
            heads, tails = bound["heads"], bound["tails"]

            def one(x: Column) -> Column:
                x = F.when(F.array_contains(heads, strip(F.element_at(x, 1))), F.slice(x, 2, F.size(x))).otherwise(x)
                last = strip(F.try_element_at(x, F.lit(-1)))
                return F.when(F.coalesce(F.array_contains(tails, last), F.lit(False)), F.slice(x, 1, F.size(x) - 1)).otherwise(x)

            kept = F.filter(F.transform(F.transform(lines, one), lambda x: strip(F.array_join(x, "\n"))), lambda y: y != "")
            return F.array_join(kept, "\n\n")

        bound = F.array(F.struct(common(1).alias("heads"), common(-1).alias("tails")))
        some = F.element_at(F.transform(bound, lambda b: F.when((F.size(b["heads"]) > 0) | (F.size(b["tails"]) > 0), cut(b))), 1)
        return F.when(F.size(paragraphs) >= least_paragraphs, some)

    # a one-element transform binds the paragraphs, which are looked at several times
    return F.coalesce(F.element_at(F.transform(F.array(raw), cleaned), 1), text)
