"""Retrieval in one call: many questions planned and answered together over shared scans, with a trace of each step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import postings
from textloom.operators import retrieval as rt
from textloom.tables import written


@dataclass
class Answers:
    """context: (query_id, chunk_id, doc_id, position, n_tokens, kept_tokens) that goes to the reader; trace: (query_id, step, n)."""

    context: DataFrame
    trace: DataFrame


def retrieve(
    chunks: DataFrame, questions: DataFrame, index: postings.Postings, least: float = 0.1, k: int = 60, window: int = 20, per_document: int = 2,
    max_tokens: int = 2000, reserved: int = 512,
) -> Answers:
    """Answers every question at once.

    ``chunks``: (chunk_id, doc_id, tokens, n_tokens, embedding); ``questions``: (query_id, tokens, q, top_k, candidates, diversify), the last three from the
    plan of its intent. A dense and a lexical branch give up to ``candidates`` each; their ranks are fused, the head is ranked anew by
    common tokens, a question that asks for it keeps ``per_document`` chunks of a document, and what is left is packed while the budget lasts. A step
    is one job over all questions; each ends in a written table, from which the trace counts.
    """
    plan = written(questions.select("query_id", "top_k", "candidates", "diversify"), "plan")
    most = plan.agg(F.max("candidates")).first()[0] or 0
    of_plan = lambda df: df.join(plan, "query_id")
    if not most:
        none = chunks.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "doc_id", F.lit(0).alias("position"), "n_tokens", F.col("n_tokens").alias("kept_tokens")).limit(0)
        return Answers(none, plan.select("query_id", F.lit("plan").alias("step"), F.lit(0).cast("long").alias("n")).limit(0))
    dense = of_plan(rt.dense(chunks.select("chunk_id", "embedding"), questions.select("query_id", "q"), most, least)).where("rank <= candidates")
    dense = written(dense.select("query_id", "chunk_id", "score", "rank"), "dense")
    terms = questions.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    found, _ = postings.search(index, terms, most)
    lexical = written(of_plan(found).where("rank <= candidates").select("query_id", "chunk_id", "score", "rank"), "lexical")
    fused = written(of_plan(rt.fused(dense, lexical, k=k)).where("rank <= candidates").select("query_id", "chunk_id", "score", "rank"), "fused")
    known = chunks.select("chunk_id", "doc_id", F.col("tokens").alias("chunk_tokens"), "n_tokens")
    told = fused.join(known, "chunk_id").join(questions.select("query_id", F.col("tokens").alias("query_tokens")), "query_id")
    again = rt.reranked(told, window).select("query_id", "chunk_id", "doc_id", "n_tokens", F.col("new_rank").alias("rank"))
    by_doc = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    capped = of_plan(again).withColumn("_k", F.row_number().over(by_doc)).where(~F.col("diversify") | (F.col("_k") <= per_document))
    placed = capped.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("position <= top_k")
    placed = written(placed.select("query_id", "chunk_id", "doc_id", "position", "n_tokens"), "placed")
    context = written(rt.budgeted(placed, "position", max(0, max_tokens - reserved)), "context")

    n = lambda df, step: df.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(step).alias("step"), "n")
    trace = plan.select("query_id", F.lit("plan").alias("step"), F.col("candidates").cast("long").alias("n"))
    steps = {"dense": dense, "lexical": lexical, "fused": fused, "selected": placed, "packed": context.where("kept_tokens > 0")}
    for step, df in steps.items():
        trace = trace.unionAll(n(df, step))
    return Answers(context, trace)
