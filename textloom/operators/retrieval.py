"""Dense and lexical retrieval, fusion, reranking, packing, memory ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.relations import ratio
from textloom.operators.similarity import cosine
from textloom.tables import written


#: Two levels of digests, as ``digests`` takes them.
DIGEST_SQL = """WITH l AS (SELECT lang, doc_id // 1000 AS k, doc_id, {line} AS line FROM documents),
    b AS (SELECT lang, k, sha256(string_agg(line, ',' ORDER BY doc_id, line)) AS h FROM l GROUP BY lang, k)
    SELECT lang, sha256(string_agg(h, ',' ORDER BY k)) AS {out} FROM b GROUP BY lang"""


def digests(rows: DataFrame, group: str, key: str, line: Column, out: str, each: int = 1000) -> DataFrame:
    """(group, out): one digest of all of a group's lines in order of an integer key.

    Lines are hashed in runs of ``each`` keys first, so that what meets in one row is a run's lines, or one digest for each run.
    """
    lined = rows.select(group, F.floor(F.col(key) / each).alias("k"), F.struct(F.col(key).alias("key"), line.alias("line")).alias("x"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v["line"]), ","), 256)
    runs = lined.groupBy(group, "k").agg(joined("x").alias("h"))
    return runs.select(group, F.struct(F.col("k").alias("key"), F.col("h").alias("line")).alias("x")).groupBy(group).agg(joined("x").alias(out))


def dense(chunks: DataFrame, queries: DataFrame, k: int, least: float, block: int = 512) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks of highest cosine for each query, over all chunks.

    Queries and chunks are dealt into blocks, and each pair of blocks is one matrix product in one task, which keeps only
    its own best ``k`` of each query. ``chunks``: (chunk_id, embedding), ``queries``: (query_id, q).
    """
    rows = max(1, -(-queries.count() // block))
    columns = max(1, -(-chunks.count() // (8 * block)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"), deal("query_id", rows).alias("i"), spread(columns).alias("j"))
    right = chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), spread(rows).alias("i"), deal("chunk_id", columns).alias("j"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        # vectors of other lengths, and null ones, are near nothing
        out: list[pa.Table] = []
        for size in {len(v) for v in a["v"].to_pylist() if v}:
            x, y = (t.filter(pc.fill_null(pc.equal(pc.list_value_length(t["v"]), size), False)) for t in (a, b))
            if not len(x) or not len(y):
                continue
            p, q = (np.array(t["v"].to_pylist(), np.float64) for t in (x, y))
            long = [np.sqrt((m * m).sum(axis=1)) for m in (p, q)]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round(np.nan_to_num(p @ q.T / long[0][:, None] / long[1][None, :]), 9)
            ids = np.array(y["id"].to_pylist())
            for row, query in zip(scores, x["id"].to_pylist()):
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
                out.append(pa.table({"query_id": pa.array([query] * len(at), pa.int64()), "chunk_id": pa.array(ids[at], pa.int64()), "score": row[at]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id bigint, chunk_id bigint, score double")
    return top(found, k)


def top(scores: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` of each query by (-score, chunk_id), with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def lexical(rel: DataFrame, terms: DataFrame, lengths: DataFrame, top_k: int, k1: float = 1.5, b: float = 0.75, every: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25. ``rel``: (chunk_id, term, count); ``terms``: (query_id, term);
    ``lengths``: (chunk_id, length). With ``every`` a chunk must hold all terms of the query."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    asked = terms.distinct()
    df = rel.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    need = terms.distinct().groupBy("query_id").agg(F.count("*").alias("need"))
    hit = rel.join(asked, "term").join(df, "term").join(lengths, "chunk_id").crossJoin(F.broadcast(stats))
    n, c = F.col("n"), F.col("count")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    by = hit.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("k")).join(need, "query_id")
    return top((by.where("k = need") if every else by).select("query_id", "chunk_id", "score"), top_k)


def lexical_units(units: DataFrame, terms: DataFrame, top_k: int, **settings) -> DataFrame:  # noqa: ANN003
    """``lexical`` over ``units`` (chunk_id, tokens); rows that share an id are one. Only the tokens that a query asks for are counted and moved."""
    asked = terms.select("term").distinct()
    held = units.select("chunk_id", F.explode("tokens").alias("term")).join(asked, "term", "left_semi")
    rel = written(held.groupBy("chunk_id", "term").agg(F.count("*").alias("count")), "asked")  # read twice
    lengths = units.where(F.size("tokens") > 0).groupBy("chunk_id").agg(F.sum(F.size("tokens")).alias("length"))
    return lexical(rel, terms, written(lengths, "lengths"), top_k, **settings)


def fused(*lists: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): sums of 1 / (k + rank) over the lists, rounded to six digits."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for one in lists[1:]:
        every = every.unionAll(one.select("query_id", "chunk_id", "rank"))
    scores = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))
    return top(scores, limit or 1 << 30)


def reranked(ranked: DataFrame, window: int = 20) -> DataFrame:
    """Adds new_rank: the first ``window`` ranks by overlap of query and chunk tokens, then score, then rank.

    ``ranked`` has query_tokens and chunk_tokens; the tail keeps its order.
    """
    asked = F.array_distinct("query_tokens")
    overlap = ratio(F.size(F.array_intersect(asked, "chunk_tokens")).cast("double"), F.size(asked))
    ahead = F.col("rank") <= window
    order = Window.partitionBy("query_id").orderBy(
        F.when(ahead, 0).otherwise(1), F.when(ahead, -F.col("overlap")).otherwise(0.0), F.when(ahead, -F.col("score")).otherwise(0.0), "rank"
    )
    return ranked.withColumn("overlap", overlap).withColumn("new_rank", F.row_number().over(order))


def diversified(ranked: DataFrame, per_document: int, limit: int) -> DataFrame:
    """At most ``per_document`` chunks of a document in rank order, then the first ``limit``."""
    by_doc = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    kept = ranked.withColumn("_k", F.row_number().over(by_doc)).where(F.col("_k") <= per_document)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("position") <= limit).drop("_k")


def ordered(ranked: DataFrame, policy: str = "relevance") -> DataFrame:
    """Adds position: by rank; by document in order of its best rank; or by document and place."""
    best = F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    made = ranked.withColumn("_best", best)
    keys = {"relevance": ["rank"], "grouped": ["_best", "rank"], "chronology": ["doc_id", "chunk_index"]}[policy]
    return made.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).drop("_best")


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): each hit replaced by its parent where it has one, first seen first."""
    joined = children.join(parents.select(F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("_known")), "parent_chunk_id", "left")
    named = joined.withColumn("chunk_id", F.when(F.col("_known"), F.col("parent_chunk_id")).otherwise(F.col("chunk_id")))
    return named.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def budgeted(context: DataFrame, order: str, budget: int) -> DataFrame:
    """Adds kept_tokens: chunks of each query taken in order while the budget lasts; the first too large one is cut to what is left."""
    before = F.sum("n_tokens").over(Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return context.withColumn("kept_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.lit(budget) - before)).cast("long"))


def packed(context: DataFrame, max_tokens: int, reserved: int = 512) -> DataFrame:
    """(query_id, chunk_id, rank, n_tokens, kept_tokens) of ``budgeted``, by rank."""
    return budgeted(context.select("query_id", "chunk_id", "rank", "n_tokens"), "rank", max(0, max_tokens - reserved))


# How much each level of memory weighs.
LEVELS = {"user": 1.0, "project": 0.95, "session": 0.85, "agent": 0.75, "episodic": 0.65}


def memory_score(level: Column, relevance: Column, confidence: Column, age_days: Column) -> Column:
    """0.4 level + 0.35 relevance + 0.15 confidence + 0.1 recency, which fades over 90 days."""
    known = F.lit(0.5)
    for name, w in LEVELS.items():
        known = F.when(level == name, w).otherwise(known)
    return 0.4 * known + 0.35 * relevance + 0.15 * confidence + 0.1 * F.greatest(F.lit(0.0), 1 - age_days / 90)


def consolidated(items: DataFrame, key_chars: int = 160) -> DataFrame:
    """One item for each normal form of its first characters: the latest."""
    key = F.substring(F.lower(F.regexp_replace(F.btrim("content"), r"\s+", " ")), 1, key_chars)
    order = Window.partitionBy("_key").orderBy(F.desc("created_at"), F.desc("item_id"))
    return items.withColumn("_key", key).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_key", "_k")


def entailment(claim: Column, evidence: Column) -> Column:
    """Share of the claim's distinct tokens that the evidence holds."""
    asked = F.array_distinct(claim)
    return ratio(F.size(F.array_intersect(asked, evidence)).cast("double"), F.size(asked))


def citations(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """(claim_id, valid): the cited chunk ids of each claim that may be cited."""
    cited = claims.select("claim_id", F.explode_outer("chunk_ids").alias("chunk_id"))
    ok = cited.join(allowed.select("chunk_id", F.lit(True).alias("_ok")).distinct(), "chunk_id", "left")
    return ok.groupBy("claim_id").agg(F.sort_array(F.collect_set(F.when(F.col("_ok"), F.col("chunk_id")))).alias("valid"))


def intents(text: Column, patterns: Sequence[tuple[str, str]], other: str = "lookup") -> Column:
    """The first intent whose pattern fits."""
    out = F.lit(other)
    for name, pattern in reversed(list(patterns)):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
