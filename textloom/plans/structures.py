"""Queries on interval joins, approximate search and the stored inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import stems
from textloom.functions.text import tokens
from textloom.operators import ann, postings, service, spans
from textloom.operators import similarity as sm
from textloom.operators import settings as st
from textloom.operators import lexical as lx
from textloom.operators import retrieval as rt
from textloom.operators.relations import token_rel
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.glue import _INTENT, _PLAN
from textloom.plans.lexical import _DICT, DICTIONARY
from textloom.plans.registry import query, table
from textloom.plans.retrieval import _COS, _INTENTS, _LEX, _query_terms

_WORDS = ("the", "und", "que", "de")


def contexts(prep_df, around=5):
    """(doc_id, chunk_id, start, end, score, rank, content_hash): a window about each of some words; the score is how many of these it holds."""
    listed = F.array(*[F.lit(w) for w in _WORDS])

    def windows(toks):
        at = F.filter(F.transform(toks, lambda t, i: F.when(F.array_contains(listed, t), i)), lambda i: i.isNotNull())
        low, high = lambda i: F.greatest(i - around, F.lit(0)), lambda i: F.least(i + around + 1, F.size(toks))
        cut = lambda i: F.slice(toks, low(i) + 1, high(i) - low(i))
        return F.transform(at, lambda i: F.struct(
            i.alias("rank"), low(i).alias("start"), high(i).alias("end"), F.size(F.filter(cut(i), lambda t: F.array_contains(listed, t))).alias("score"),
            F.md5(F.array_join(cut(i), " ").cast("binary")).alias("content_hash"),
        ))

    # a one-element transform binds the tokens, which would else be made anew for each window
    made = F.element_at(F.transform(F.array(F.col("tokens")), windows), 1)
    return prep_df.select(F.col("unit_id").alias("doc_id"), F.explode(made).alias("w")).select(
        "doc_id", F.concat_ws(":", "doc_id", F.lpad(F.col("w.rank").cast("string"), 8, "0")).alias("chunk_id"), *[F.col(f"w.{c}").cast("long").alias(c) for c in ("start", "end", "score", "rank")], "w.content_hash"
    )


_SAME = "(y.h = {x}.h OR (least(y.e, {x}.e) - greatest(y.s, {x}.s)) >= 0.8 * (greatest(y.e, {x}.e) - least(y.s, {x}.s)) - 1e-9)"


@query(
    """, p AS (SELECT doc_id, t, unnest(list_filter(range(0, len(t)), lambda i: t[i + 1] IN ('the', 'und', 'que', 'de'))) AS r FROM tk),
    b AS (SELECT doc_id, t, r, greatest(r - 5, 0) AS s, least(r + 6, len(t)) AS e FROM p),
    w AS (SELECT doc_id, r, {'r': r, 's': s, 'e': e, 'h': md5(array_to_string(t[s + 1 : e], ' '))} AS w, len(list_filter(t[s + 1 : e], lambda y: y IN ('the', 'und', 'que', 'de'))) AS score FROM b),
    l AS (SELECT doc_id, list([w] ORDER BY score DESC, r) AS l FROM w GROUP BY doc_id),
    k AS (SELECT doc_id, l, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: """ + _SAME.format(x="x[1]") + """)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l),
    o AS (SELECT doc_id, kept, unnest(l)[1] AS w FROM k)
    SELECT doc_id, doc_id || ':' || lpad(w.r::VARCHAR, 8, '0') AS chunk_id, doc_id || ':' || lpad(list_filter(kept, lambda y: y.r = w.r OR """ + _SAME.format(x="w") + """)[1].r::VARCHAR, 8, '0') AS representative FROM o""",
    uses="tk",
)
def rt_context_dedup(spark, d):
    """Windows about common words; one whose span nearly coincides with a better one's, or says the same, gives way to it."""
    return spans.representatives(contexts(prep(spark, d)), ["doc_id"], 0.8)


@query(
    _DICT + """, o AS (SELECT h.unit_id, h.start, h."end", h.expression, max(struct_pack(e := x.e, low := -x.s)) AS far FROM h LEFT JOIN x ON x.doc_id = h.unit_id AND x.s < h."end" AND h.start < x.e GROUP BY ALL)
    SELECT unit_id, start, "end", expression, -far.low AS bar_start, far.e AS bar_end FROM o""",
    uses="tk tok",
)
def join_span_overlap(spark, d):
    """Every dictionary hit with the exclusion that it overlaps, if any."""
    p = prep(spark, d)
    long = lambda df, *more: df.select("unit_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *more)
    hits = lx.dictionary_hits(p, {k: v for k, v in DICTIONARY.items() if k != "exclusions"})
    return spans.overlaps(long(hits, "expression"), long(lx.dictionary_hits(p, {"barred": DICTIONARY["exclusions"]})))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    allowed = e.join(table(spark, d, "labels"), F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("chunk_id"))
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), allowed


@query(
    f"""SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id IN (SELECT doc_id FROM labels) QUALIFY rank <= 10"""
)
def rt_exact_topk(spark, d):
    """The exact nearest vectors among the allowed ones."""
    vectors, asked, allowed = _vectors(spark, d)
    return rounded(rt.dense(vectors.join(allowed, "chunk_id", "left_semi"), asked, 10, -1.0))


@query("SELECT count(*) AS n_queries, true AS enough, true AS all_allowed FROM embeddings WHERE vec_id % 50 = 0")
def rt_ann_recall(spark, d):
    """Approximate search against the exact one, under the same allow-list: is recall at 10 at least 0.9, and nothing else found?"""
    vectors, asked, allowed = _vectors(spark, d)
    found = ann.search(ann.build(vectors), asked, 10, allowed=allowed)
    by = ann.recall(found, rt_exact_topk(spark, d))
    return by.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("enough")).crossJoin(  # one row each
        found.join(allowed, "chunk_id", "left_anti").agg((F.count("*") == 0).alias("all_allowed"))
    )


@query()
def rt_ann(spark, d):
    """What approximate search finds; its recall is ``rt_ann_recall``."""
    vectors, asked, allowed = _vectors(spark, d)
    return ann.search(ann.build(vectors), asked, 10, allowed=allowed)


def _index(spark, d):
    return postings.of_units(prep(spark, d).withColumnRenamed("unit_id", "chunk_id"))


@query(_LEX + " SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM lx", uses="tk tok")
def join_inverted_index(spark, d):
    """Lexical retrieval from stored postings; blocks that can't reach the k-th score are skipped."""
    found, _ = postings.search(_index(spark, d), _query_terms(spark, d), 20)
    return rounded(found, 4).select("query_id", "chunk_id", "score", "rank")


# --- retrieval in one call -------------------------------------------------------------------


def _answers(spark, d):
    """Every benchmark item is a question over all documents; a document's source stands for what it is part of."""
    given = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), tokens(F.col("text")).alias("tokens"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("n_tokens"))
    chunks = given.withColumn("embedding", sm.hashed_embedding(F.col("tokens"), 64))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"), rt.intents(F.col("text"), _INTENTS).alias("intent"))
    questions = asked.select("query_id", "tokens", sm.hashed_embedding(F.col("tokens"), 64).alias("q"), *st.retrieval_plan(F.col("intent")))
    return service.retrieve(chunks, questions, _index(spark, d))


_VECTOR = "list_transform(range(64), lambda k: len(list_filter(list_transform({t}, lambda x: ('0x' || md5(x)[1:8])::BIGINT % 64), lambda x: x = k))::DOUBLE)"
_SERVICE = (
    _LEX.replace("QUALIFY rank <= 20", "QUALIFY rank <= 40")
    + r""", bt AS (SELECT item_id AS query_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)?') AS t FROM benchmark),
  pl AS (SELECT query_id, """ + _PLAN + """ FROM (SELECT query_id, """ + _INTENT + """ AS intent FROM bt)),
  ce AS (SELECT doc_id AS chunk_id, """ + _VECTOR.format(t="t") + """ AS v FROM tk), qe AS (SELECT query_id, """ + _VECTOR.format(t="t") + """ AS q FROM bt),
  ds AS (SELECT query_id, chunk_id, round(coalesce(nullif(list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v)), 'nan'::DOUBLE), 0), 9) AS score FROM qe, ce),
  dn AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds WHERE score >= 0.1) JOIN pl USING (query_id) WHERE rank <= candidates),
  lc AS (SELECT query_id, chunk_id, score, rank FROM lx JOIN pl USING (query_id) WHERE rank <= candidates),
  fs AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM dn UNION ALL SELECT query_id, chunk_id, rank FROM lc) GROUP BY ALL),
  fu AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs) JOIN pl USING (query_id) WHERE rank <= candidates),
  ro AS (SELECT fu.*, len(list_intersect(list_distinct(bt.t), tk.t)) / len(list_distinct(bt.t)) AS overlap, tk.source AS doc_id FROM fu JOIN bt USING (query_id) JOIN tk ON tk.doc_id = chunk_id),
  rr AS (SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -overlap ELSE 0 END, CASE WHEN rank <= 20 THEN -score ELSE 0 END, rank) AS rank FROM ro),
  cp AS (SELECT rr.*, row_number() OVER (PARTITION BY query_id, rr.doc_id ORDER BY rank) AS k FROM rr),
  sl AS (SELECT * FROM (SELECT cp.*, top_k, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM cp JOIN pl USING (query_id) WHERE NOT diversify OR k <= 2) WHERE position <= top_k),
  nt AS (SELECT query_id, chunk_id, sl.doc_id, position, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM sl JOIN documents d ON d.doc_id = chunk_id),
  cx AS (SELECT *, greatest(0, least(n_tokens, 1488 - (sum(n_tokens) OVER (PARTITION BY query_id ORDER BY position) - n_tokens)))::BIGINT AS kept_tokens FROM nt)"""
)


@query(
    _SERVICE + """ SELECT query_id, 'plan' AS step, candidates::BIGINT AS n FROM pl UNION ALL SELECT query_id, 'dense', count(*) FROM dn GROUP BY 1 UNION ALL SELECT query_id, 'lexical', count(*) FROM lc GROUP BY 1
    UNION ALL SELECT query_id, 'fused', count(*) FROM fu GROUP BY 1 UNION ALL SELECT query_id, 'selected', count(*) FROM cx GROUP BY 1 UNION ALL SELECT query_id, 'packed', count(*) FROM cx WHERE kept_tokens > 0 GROUP BY 1""",
    uses="tk tok",
)
def rt_service(spark, d):
    """The trace of all questions' retrieval: how many chunks each step left."""
    return _answers(spark, d).trace


@query(_SERVICE + " SELECT query_id, chunk_id, doc_id, position, n_tokens, kept_tokens FROM cx", uses="tk tok")
def rt_service_context(spark, d):
    """What all questions' retrieval hands to the reader."""
    return _answers(spark, d).context


# --- stems, case and encodings -----------------------------------------------------------------


def _stemmed(spark, d):
    return stems.stemmed(token_rel(prep(spark, d, "lang"), "lang"))


@query()
def tok_stem(spark, d):
    """Each document's stems in order, by its language."""
    made = _stemmed(spark, d).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("x"))  # a row a text
    return made.select("unit_id", F.transform("x", lambda v: v["stem"]).alias("tokens"))


@query()
def agg_stem_freq(spark, d):
    """How often each stem of a language occurs, and in how many units."""
    by_unit = _stemmed(spark, d).groupBy("lang", "stem", "unit_id").agg(F.count("*").alias("n"))
    return by_unit.groupBy("lang", "stem").agg(F.sum("n").alias("count"), F.count("*").alias("units"))


@query()
def kwic_stem(spark, d):
    """Tokens of any form of a word: those of the word's stem, in the document's language."""
    wanted = [(lang, stems.stem_of(w, lang)) for lang, w in (("en", "thes"), ("de", "enungen"), ("fr", "lements"), ("es", "osos"))]
    hits = _stemmed(spark, d).join(F.broadcast(spark.createDataFrame(wanted, "lang string, stem string")), ["lang", "stem"])  # four rows
    return hits.select("unit_id", "pos", "term", "stem")


@query("SELECT doc_id AS unit_id, lower(translate(text, 'Iİ', 'ıi')) AS text FROM documents")
def rt_turkish_norm(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), stems.lowered_turkish(F.col("text")).alias("text"))


@query("SELECT doc_id AS unit_id, text AS text, text AS mended FROM documents")
def tx_encoding(spark, d):
    """Texts that are whole stay; the same texts misread as Latin-1 are put right."""
    text = F.col("text")
    misread = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), stems.repaired(text).alias("text"), stems.repaired(misread).alias("mended"))
