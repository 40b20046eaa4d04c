"""Queries on retrieval and memory ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.operators import models as md
from textloom.operators import retrieval as rt
from textloom.plans.documents import INJECTION
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import query, table
from textloom.tables import written

_COS = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))"
_DENSE = f"""ds AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({_COS}, 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
  dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds WHERE score >= 0.1 QUALIFY rank <= 10)"""


def _dense(spark, d, k=10):
    """Queries: every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    chunks, queries = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.dense(chunks, queries, k, 0.1)


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dn")
def rt_dense(spark, d):
    return rounded(_dense(spark, d))


def _query_terms(spark, d):
    """The distinct tokens of each whole benchmark item are a query."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("t"))
    return b.select("query_id", F.explode("t").alias("term"))


def _lexical(spark, d, k=20):
    return rt.lexical_units(prep(spark, d).withColumnRenamed("unit_id", "chunk_id"), _query_terms(spark, d), k)


_LEX = r""", qt AS (SELECT item_id AS query_id, unnest(l) AS term FROM (SELECT item_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS l
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)?') AS t FROM benchmark))),
  f AS (SELECT doc_id AS chunk_id, term, count(*) AS c FROM tok GROUP BY ALL), ln AS (SELECT chunk_id, sum(c) AS length FROM f GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM ln),
  df AS (SELECT term, count(*) AS df FROM f GROUP BY term), nd AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1),
  sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score, count(*) AS k FROM f JOIN qt USING (term) JOIN df USING (term) JOIN ln USING (chunk_id), st GROUP BY 1, 2),
  lx AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN nd USING (query_id) WHERE k = need QUALIFY rank <= 20)"""


@query(_LEX + " SELECT query_id, chunk_id, round(score, 4) AS score FROM lx", uses="tk tok")
def rt_lexical(spark, d):
    return _lexical(spark, d).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query(
    f"""WITH {_DENSE}, b AS (SELECT query_id, chunk_id, 11 - rank AS rank FROM dn), u AS (SELECT query_id, chunk_id, rank FROM dn UNION ALL SELECT * FROM b),
    s AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM u GROUP BY 1, 2)
    SELECT query_id, chunk_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s"""
)
def rt_rrf(spark, d):
    one = _dense(spark, d)
    return rt.fused(one, one.withColumn("rank", 11 - F.col("rank")))


@query(
    f"""WITH {_DENSE}, l AS (SELECT dn.*, e.label, row_number() OVER (PARTITION BY query_id, e.label ORDER BY rank) AS k FROM dn JOIN embeddings e ON e.vec_id = chunk_id)
    SELECT query_id, chunk_id, label AS doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM l WHERE k <= 2 QUALIFY position <= 5"""
)
def rt_diversify(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return rt.diversified(_dense(spark, d).join(e, "chunk_id"), 2, 5).select("query_id", "chunk_id", "doc_id", "rank", "position")


@query(
    f"""WITH {_DENSE}, l AS (SELECT dn.*, e.label, row_number() OVER (PARTITION BY query_id, e.label ORDER BY rank) AS k FROM dn JOIN embeddings e ON e.vec_id = chunk_id)
    SELECT query_id, chunk_id, rank FROM l WHERE k <= 2"""
)
def win_doc_cap(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return rt.diversified(_dense(spark, d).join(e, "chunk_id"), 2, 1000).select("query_id", "chunk_id", "rank")


@query(
    f"""WITH {_DENSE}, l AS (SELECT dn.*, e.label, min(rank) OVER (PARTITION BY query_id, e.label) AS best FROM dn JOIN embeddings e ON e.vec_id = chunk_id)
    SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY best, rank) AS position FROM l"""
)
def win_context_order(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return rt.ordered(_dense(spark, d).join(e, "chunk_id"), "grouped").select("query_id", "chunk_id", "rank", "position")


_REL = "rv AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0)"
_EVAL = f"""WITH {_DENSE}, {_REL}, w AS (SELECT query_id, count(*) AS n FROM rv GROUP BY 1), h AS (SELECT dn.query_id, dn.rank, (rv.chunk_id IS NOT NULL)::INT AS rel FROM dn LEFT JOIN rv ON rv.query_id = dn.query_id AND rv.chunk_id = dn.chunk_id),
  b AS (SELECT query_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS f, sum(rel / log2(rank + 1)) AS dcg FROM h GROUP BY 1)
  SELECT query_id, round(hits / n, 6) AS recall, round(hits / 10, 6) AS precision, round(coalesce(1 / f, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM b JOIN w USING (query_id)"""


def _relevant(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e.select("label", F.col("vec_id").alias("chunk_id")), "label").select("query_id", "chunk_id")


@query(_EVAL)
def win_rank_metrics(spark, d):
    return rounded(md.ranked_metrics(_dense(spark, d), _relevant(spark, d), 10))


@query(f"SELECT round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM ({_EVAL})")
def rt_eval(spark, d):
    made = md.ranked_metrics(_dense(spark, d), _relevant(spark, d), 10)
    return rounded(made.agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]), 5)


@query("SELECT doc_id AS chunk_id, source FROM documents SEMI JOIN labels USING (doc_id) WHERE lang = 'en' AND n_chars > 100")
def rt_scope(spark, d):
    scoped = docs(spark, d).where("lang = 'en' AND n_chars > 100").join(table(spark, d, "labels"), "doc_id", "left_semi")
    return scoped.select(F.col("doc_id").alias("chunk_id"), "source")


@query(f"SELECT doc_id AS chunk_id FROM documents WHERE NOT regexp_matches(text, '{INJECTION}')")
def rt_injection_filter(spark, d):
    return docs(spark, d).where(~F.col("text").rlike(INJECTION)).select(F.col("doc_id").alias("chunk_id"))


_INTENTS = (("compare", "(?i)compare|versus"), ("define", "(?i)what is|define"), ("list", "(?i)list|which"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)compare|versus') THEN 'compare' WHEN regexp_matches(text, '(?i)what is|define') THEN 'define' WHEN regexp_matches(text, '(?i)list|which') THEN 'list' ELSE 'lookup' END AS intent FROM conversations")
def rt_query_analysis(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rt.intents(F.col("text"), _INTENTS).alias("intent"))


@query("""WITH c AS (SELECT conv_id AS query_id, turn AS rank, conv_id || ':' || (turn // 3) AS parent FROM conversations) SELECT query_id, parent AS chunk_id, min(rank) AS rank FROM c GROUP BY 1, 2""")
def rt_parent(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.concat_ws(":", F.col("conv_id"), F.floor(F.col("turn") / 3)).alias("parent_chunk_id")
    )
    return rt.with_parents(c, c.select(F.col("parent_chunk_id").alias("chunk_id")).distinct())


@query("""WITH c AS (SELECT conv_id AS query_id, conv_id || ':' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS rank, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM conversations),
    s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT query_id, chunk_id, rank, n_tokens, greatest(0, least(n_tokens, 88 - before))::BIGINT AS kept_tokens FROM s""")
def rt_budget(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"),
        F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("n_tokens"),
    )
    return rt.packed(c, 600, 512)


@query(
    _LEX + """, o AS (SELECT lx.*, round(len(list_intersect(q.t, tk.t)) / len(q.t), 6) AS overlap FROM lx JOIN (SELECT query_id, list(term) AS t FROM qt GROUP BY query_id) q USING (query_id) JOIN tk ON tk.doc_id = chunk_id)
    SELECT query_id, chunk_id, rank, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC, rank) AS new_rank FROM o""",
    uses="tk tok",
)
def rt_rerank(spark, d):
    hits = written(_lexical(spark, d), "hits")  # a true size for the planner, so that texts that are no hit stay where they are
    lexical = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text").join(hits, "chunk_id").withColumn("chunk_tokens", tokens(F.col("text"))).drop("text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("query_tokens"))
    return rounded(rt.reranked(lexical.join(asked, "query_id")).select("query_id", "chunk_id", "rank", "overlap", "new_rank"))


@query(""", b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+(?:[''’][\\p{L}\\p{M}]+)?')) AS t FROM benchmark)
    SELECT item_id AS claim_id, round(len(list_intersect(b.t, tk.t)) / len(b.t), 6) AS score FROM b JOIN tk ON tk.doc_id = b.item_id""", uses="tk")
def rt_entail_lexical(spark, d):
    b = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("claim"))
    joined = b.join(prep(spark, d), F.col("item_id") == F.col("unit_id"))
    return rounded(joined.select(F.col("item_id").alias("claim_id"), rt.entailment(F.col("claim"), F.col("tokens")).alias("score")))


@query("""WITH c AS (SELECT item_id AS claim_id, unnest([item_id, item_id + 1, item_id + 100000]) AS chunk_id FROM benchmark) SELECT claim_id, list_sort(list(DISTINCT chunk_id) FILTER (WHERE chunk_id IN (SELECT doc_id FROM labels))) AS valid FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE chunk_id IN (SELECT doc_id FROM labels)) > 0""")
def rt_citations(spark, d):
    x = F.col("item_id")
    claims = table(spark, d, "benchmark").select(x.alias("claim_id"), F.array(x, x + 1, x + 100000).alias("chunk_ids"))
    return rt.citations(claims, table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))).where(F.size("valid") > 0)


@query(rt.DIGEST_SQL.format(line="doc_id || ':' || n_chars", out="revision"))
def rt_evidence_hash(spark, d):
    return rt.digests(docs(spark, d), "lang", "doc_id", F.concat_ws(":", "doc_id", "n_chars"), "revision")


@query("""SELECT event_id, round(0.4 * CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.95 ELSE 0.65 END + 0.35 * ((event_id % 100) / 100.0) + 0.15 * ((event_id % 7) / 7.0) + 0.1 * greatest(0, 1 - (event_id % 120) / 90.0), 6)::DOUBLE AS score FROM events""")
def mem_rank(spark, d):
    level = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "project").otherwise("episodic")
    x = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(rt.memory_score(level, x % 100 / 100, x % 7 / 7, (x % 120).cast("double")), 6).alias("score"))


@query("""WITH k AS (SELECT conv_id, turn, left(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), 160) AS k FROM conversations) SELECT k.conv_id, k.turn FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC, conv_id DESC) = 1""")
def mem_consolidate(spark, d):
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("created_at"), F.col("text").alias("content"))
    return rt.consolidated(items).select(F.col("item_id").alias("conv_id"), F.col("created_at").alias("turn"))


@query("""SELECT item_id, round(0.7 * ((item_id % 10) / 10.0) + 0.3 * ((item_id % 3) / 3.0), 6)::DOUBLE AS score FROM benchmark""")
def ai_score(spark, d):
    x = F.col("item_id")
    return table(spark, d, "benchmark").select("item_id", F.round(0.7 * (x % 10 / 10) + 0.3 * (x % 3 / 3), 6).alias("score"))
