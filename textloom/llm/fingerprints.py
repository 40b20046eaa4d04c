"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every distinct shingle hash below a fixed fraction of the hash
range, and no other. So the sketch of a longer document that contains a text holds all of the text's
sketch; the union of two sketches, made distinct, is the sketch of both documents together; and
because the fraction is the same for all, the share of one sketch found in another estimates
containment however unequal the documents are.

Defined cases: a null or blank text has an empty sketch and an empty fingerprint. A text of fewer
words than a shingle is one shingle. A text with words may still have no hash below the threshold; its
sketch is empty too, and its fingerprint is "~" and one hash of all its shingles, so that equal
texts have equal fingerprints and others differ. The likeness of two empty sketches is 1 if the
fingerprints are equal, else 0; containment of an empty sketch can't be told and is null. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bucketed, words, written

SHINGLE = 5
SCALED = 4


def sketched(text: Column, shingle: int = SHINGLE, scaled: int = SCALED) -> Column:
    """struct<hashes array<long>, whole long>: sorted distinct shingle hashes below 1/``scaled`` of the
    range, and one hash of all shingles in order.

    Hashes are drawn from the signed 64-bit range, lowest value first.
    """
    threshold = -(2**63) + 2**64 // scaled

    def of(w: Column) -> Column:
        last = F.size(w) - shingle
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]),
        )
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(hashes)

    def keep(h: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < F.lit(threshold))))
        return F.struct(low.alias("hashes"), F.when(F.size(h) > 0, F.xxhash64(h)).alias("whole"))

    # a one-element transform binds a value, so that it isn't computed anew for each use
    bound = F.transform(F.array(words(text)), of)
    return F.element_at(F.transform(bound, keep), 1)


def sketch(text: Column, shingle: int = SHINGLE, scaled: int = SCALED) -> Column:
    """Sorted distinct shingle hashes (array<long>) below 1/``scaled`` of the range."""
    return sketched(text, shingle, scaled)["hashes"]


def fingerprint(made: Column) -> Column:
    """What ``sketched`` made as text: the hashes as 16 hex digits each, in order, or "~" and the whole's hash."""
    hexed = lambda h: F.lpad(F.hex(h), 16, "0")
    return (
        F.when(F.size(made["hashes"]) > 0, F.concat_ws("", F.transform(made["hashes"], hexed)))
        .when(made["whole"].isNotNull(), F.concat(F.lit("~"), hexed(made["whole"])))
        .otherwise("")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two that ``sketched`` made: shared hashes over all hashes."""
    shared = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    every = F.size(a["hashes"]) + F.size(b["hashes"]) - shared
    same = a["whole"].eqNullSafe(b["whole"]).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(every == 0, same).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, from their sketches; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together."""
    return F.sort_array(F.array_distinct(F.concat(a, b)))


def in_order(rows: DataFrame, rows_each: int = 1_000_000) -> DataFrame:
    """(row, before, n_before) for each of ``rows`` (row, id, tie, n): the row before it by descending id, ties
    by tie and row, and that row's n. Before the first is the last. Null ids come last.

    Only these numbers are sorted, in ranges of about ``rows_each``; the ends of the ranges, one row each,
    are brought together in one task.
    """
    by = [F.desc_nulls_last("id"), F.col("tie").asc(), F.col("row").asc()]
    parts = rows.count() // rows_each + 1
    dealt = written(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part").orderBy(*by)
    placed = dealt.select("row", "n", "part", F.lag(F.struct("row", "n")).over(w).alias("before"), F.lead("row").over(w).isNull().alias("last"))
    ends = placed.where("last").select(F.col("part"), F.struct("row", "n").alias("end"))
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(every), F.last("end").over(whole)).alias("end"))
    return placed.join(ends, "part").select("row", F.coalesce("before", "end").alias("before")).select("row", F.col("before.row").alias("before"), F.col("before.n").alias("n_before"))


def edited(text: Column, following: Column, n: Column) -> Column:
    """The text with its last third replaced by as many first code points of another."""
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - k).cast("int")), F.substring(following, F.lit(1), k))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    Reads only the two named columns, so others may have any name. Rows with equal ids follow each other.
    The texts are dealt out once; what each hands to the row before it, a third of that row's length
    at most, moves once more. Returns id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    containments contain_edited (share of the document that the edited text holds) and
    contain_next.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = bucketed(base, "row", "texts")
    order = written(in_order(texts.select("row", "id", F.xxhash64("text").alias("tie"), F.length("text").alias("n"))), "order")
    # each row hands its beginning and its sketch to the row before it
    given = texts.select("row", "text").join(order.hint("shuffle_hash"), "row").select(
        F.col("before").alias("row"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_before") / 3).cast("int")).alias("following"), sketched(F.col("text")).alias("next")
    )
    made = texts.join(given.hint("shuffle_hash"), "row").select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        sketched(F.col("text")).alias("own"),
        "next",
        edited(F.col("text"), F.col("following"), F.length("text")).alias("edited"),
    ).withColumn("changed", sketched(F.col("edited")))
    s, e, n = F.col("own"), F.col("changed"), F.col("next")
    return made.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(s).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        likeness(s, e).alias("near_edited"),
        likeness(s, n).alias("near_next"),
        containment(s["hashes"], e["hashes"]).alias("contain_edited"),
        containment(s["hashes"], n["hashes"]).alias("contain_next"),
    )
