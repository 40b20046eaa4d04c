"""A stored inverted index whose blocks say the most that they can give, and searches that skip the others.

Documents are dealt into blocks of about ``each``; a posting is the row of one term in one block, with the documents that
hold the term there, their BM25 weights but for the term's rarity, and the largest of these. A query's score in a block is at most the sum of its terms' largest
weights there. So a search first scores each query's few most promising blocks in full, which gives a k-th score to
beat, and then only those blocks whose sum can reach it. Nothing that is skipped could be in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.retrieval import top
from textloom.tables import written


@dataclass
class Postings:
    """``lists``: (term, block, documents array<struct<chunk_id, weight>>); ``bounds``: (term, block, most), the same rows without the documents; ``rarity``:
    (term, idf), by which a weight is multiplied when it is asked for, so that building joins nothing by term."""

    lists: DataFrame
    bounds: DataFrame
    rarity: DataFrame


def _block(n: Column, each: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.greatest(F.ceil(n / each), F.lit(1))).cast("int").alias("block")


def _stored(rows: DataFrame, n: int, mean: float, k1: float, b: float) -> Postings:
    """The index of ``rows`` (block, chunk_id, length, term, count)."""
    c = F.col("count")
    weight = c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    lists = rows.select("block", "term", F.struct("chunk_id", weight.alias("weight")).alias("x")).groupBy("block", "term").agg(F.collect_list("x").alias("documents"), F.max("x.weight").alias("most"))
    made = written(lists.sortWithinPartitions("term", "block"), "postings")
    df = made.groupBy("term").agg(F.sum(F.size("documents")).alias("df"))
    rarity = written(df.select("term", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "rarity")
    return Postings(made.select("term", "block", "documents"), made.select("term", "block", "most"), rarity)


def build(rel: DataFrame, lengths: DataFrame, each: int = 256, k1: float = 1.5, b: float = 0.75) -> Postings:
    """The index of ``rel`` (chunk_id, term, count) with ``lengths`` (chunk_id, length), weighed as ``retrieval.lexical`` does.

    A row holds one term's documents of one block, so about ``each`` at most, however common the term is.
    """
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    return _stored(rel.join(lengths, "chunk_id").select("*", _block(F.lit(n), each)), n, mean, k1, b)


def of_units(units: DataFrame, each: int = 256, k1: float = 1.5, b: float = 0.75) -> Postings:
    """The index of ``units`` (chunk_id, tokens); rows that share an id are one. Only the units move, once, to the task of their block: all its terms are counted and listed there."""
    some = units.where(F.size("tokens") > 0)
    n, mean = some.agg(F.countDistinct("chunk_id"), F.sum(F.size("tokens")) / F.countDistinct("chunk_id")).first()
    length = F.sum(F.size("tokens")).over(Window.partitionBy("block", "chunk_id"))  # rows of one id
    dealt = some.select(_block(F.lit(n), each), "chunk_id", "tokens").repartition("block").withColumn("length", length)
    counts = dealt.select("block", "chunk_id", "length", F.explode("tokens").alias("term")).groupBy("block", "chunk_id", "length", "term").agg(F.count("*").alias("count"))
    return _stored(counts, n, mean, k1, b)


def _scored(index: Postings, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, k) of all documents in the wanted blocks (query_id, block) of each query."""
    lists = index.lists.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")  # the queries' own terms
    rows = wanted.join(terms, "query_id").join(lists, ["term", "block"]).select("query_id", "idf", F.explode("documents").alias("x"))
    return rows.groupBy("query_id", "x.chunk_id").agg(F.round(F.sum(F.col("idf") * F.col("x.weight")), 9).alias("score"), F.count("*").alias("k"))


def search(index: Postings, terms: DataFrame, top_k: int, every: bool = True, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """The result of ``retrieval.lexical``, (query_id, chunk_id, score, rank), and (query_id, blocks, scored): how many blocks had any of
    the query's terms (all of them, with ``every``), and how many were looked into."""
    asked = written(terms.select("query_id", "term").distinct().join(index.rarity, "term", "left"), "asked")
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    sums = asked.join(index.bounds, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.count("*").alias("have")).join(need, "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = written((sums.where("have = need") if every else sums).withColumn("place", F.row_number().over(order)), "bounds")
    whole = lambda rows: (rows.join(need, "query_id").where("k = need") if every else rows).select("query_id", "chunk_id", "score")
    early = written(whole(_scored(index, bounds.where(F.col("place") <= first).select("query_id", "block"), asked)), "early")
    beat = top(early, top_k).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("beat"))
    # a hair below, as sums of bounds and of weights may be rounded differently
    reach = bounds.join(beat, "query_id", "left").where((F.col("place") <= first) | F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-6))
    reach = written(reach.select("query_id", "block", "place"), "reach")
    late = whole(_scored(index, reach.where(F.col("place") > first).select("query_id", "block"), asked))
    looked = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(reach.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id")
    return top(early.unionAll(late), top_k), looked
