"""Queries on similarity and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import similarity as sm
from textloom.operators import weighed as wd
from textloom.operators.relations import dfm, token_rel
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import query, table

_W = """, f AS (SELECT doc_id, term, count(*) AS c FROM tok GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
  df AS (SELECT term, count(*) AS df FROM f GROUP BY term), r AS (SELECT doc_id, term, c * (ln((n + 1) / (df + 1)) + 1) AS w FROM f JOIN df USING (term), n),
  l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM r GROUP BY doc_id), v AS (SELECT doc_id, term, w / l AS w FROM r JOIN l USING (doc_id))"""


def _weights(spark, d):
    p = prep(spark, d)
    return sm.unit_tfidf(dfm(token_rel(p)), p.count())


def _groups(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("group_key"))


@query(
    _W + """ SELECT a.doc_id AS i, b.doc_id AS j, round(sum(a.w * b.w), 5) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id
    GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.60001""",
    uses="tk tok",
)
def sim_tfidf_pairwise(spark, d):
    return rounded(wd.tfidf_pairs(prep(spark, d), 0.60001), 5)


@query(
    """, s AS (SELECT doc_id, term, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, term FROM tok)),
    p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) / (a.n + b.n - count(*)) AS score FROM s a JOIN s b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)
    SELECT i, j, round(score, 6) AS score FROM p WHERE score >= 0.5""",
    uses="tk tok",
)
def sim_jaccard_pairwise(spark, d):
    return rounded(sm.jaccard_pairs(dfm(token_rel(prep(spark, d))), 0.5))


@query(_W + " SELECT b.doc_id AS unit_id, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b ON a.term = b.term AND b.doc_id <> 7 WHERE a.doc_id = 7 GROUP BY 1", uses="tk tok")
def sim_query(spark, d):
    return rounded(sm.query_scores(_weights(spark, d), 7))


_C = _W + """, m AS (SELECT lang, term, sum(w) / any_value(k) AS m FROM v JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS k FROM documents GROUP BY lang) USING (lang) GROUP BY lang, term),
  q AS (SELECT lang, sqrt(sum(m * m)) AS q FROM m GROUP BY lang)"""


@query(
    _C + """ SELECT a.lang AS a, b.lang AS b, round(sum(a.m * b.m) / (any_value(qa.q) * any_value(qb.q)), 6) AS score FROM m a JOIN m b ON a.term = b.term AND a.lang < b.lang
    JOIN q qa ON qa.lang = a.lang JOIN q qb ON qb.lang = b.lang GROUP BY 1, 2""",
    uses="tk tok",
)
def sim_centroid_between(spark, d):
    return rounded(sm.centroid_between(_weights(spark, d), _groups(spark, d)))


@query(
    _C + """ SELECT v.doc_id AS unit_id, d.lang AS group_key, round(sum(v.w * m.m) / any_value(q.q), 6) AS score
    FROM v JOIN documents d USING (doc_id) JOIN m ON m.lang = d.lang AND m.term = v.term JOIN q ON q.lang = d.lang GROUP BY 1, 2""",
    uses="tk tok",
)
def sim_item_to_group(spark, d):
    return rounded(sm.item_to_group(_weights(spark, d), _groups(spark, d)))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def vec_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(sm.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))  # one row


@query(
    f"""SELECT a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE {_COS} >= 0.2500001"""
)
def sim_embedding_pairwise(spark, d):
    """Vectors of the same label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(sm.vector_pairs(e, 0.2500001))


def _groups_sql(key):
    return f"""WITH k AS (SELECT doc_id AS unit_id, {key} AS key FROM documents)
    SELECT key, min(unit_id) OVER w AS first, unit_id, count(*) OVER w AS count FROM k WINDOW w AS (PARTITION BY key) QUALIFY count(*) OVER w >= 2"""


_NORM = r"lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


@query(_groups_sql("sha256(text)"))
def dup_exact(spark, d):
    return sm.checksum_groups(docs(spark, d))


@query(_groups_sql(f"sha256({_NORM})"))
def dup_normalized(spark, d):
    return sm.checksum_groups(docs(spark, d), normal=True)


def _lexical_sql(threshold):
    """All pairs of different normal forms whose sizes allow the score."""
    return f""", one AS (SELECT {_NORM} AS t, min(doc_id) AS u FROM documents GROUP BY 1),
    g AS (SELECT u, unnest(CASE WHEN t = '' THEN [] WHEN len(t) < 5 THEN [t] ELSE list_transform(range(1, len(t) - 3), lambda i: t[i : i + 4]) END) AS g FROM one),
    c AS (SELECT u, g, count(*) AS c FROM g GROUP BY u, g), n AS (SELECT u, sum(c) AS n FROM c GROUP BY u), s AS (SELECT * FROM c JOIN n USING (u)),
    p AS (SELECT a.u AS i, b.u AS j, sum(least(a.c, b.c)) AS sh, any_value(a.n) AS ni, any_value(b.n) AS nj FROM s a JOIN s b
      ON a.g = b.g AND a.u < b.u AND a.n >= {threshold} * b.n AND b.n >= {threshold} * a.n GROUP BY a.u, b.u),
    lexical AS (SELECT i, j, round(sh / (ni + nj - sh), 4) AS score FROM p WHERE sh / (ni + nj - sh) >= {threshold})"""


@query("WITH " + _lexical_sql(0.85).lstrip(", ") + " SELECT * FROM lexical")
def dup_lexical(spark, d):
    return sm.lexical_pairs(docs(spark, d))


@query("WITH " + _lexical_sql(0.92).lstrip(", ") + " SELECT * FROM lexical")
def qa_near_dups(spark, d):
    return sm.lexical_pairs(docs(spark, d), 0.92)


def _signatures(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), sm.minhash()(F.col("text")).alias("signature"))


_MINHASH = r"""wd AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
  gm AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS g FROM wd WHERE len(w) > 0),
  hx AS (SELECT doc_id, ('0x' || left(md5(g), 8))::BIGINT AS x FROM gm), co(k, a, b) AS (VALUES """ + ", ".join(
    f"({k}, {a}::HUGEINT, {b}::HUGEINT)" for k, (a, b) in enumerate(zip(*sm._coefficients(64, 1)))
) + """),
  mn AS (SELECT doc_id, k, min(((a * x + b) % 2305843009213693951)::BIGINT & 4294967295) AS v FROM hx, co GROUP BY doc_id, k),
  sg AS (SELECT doc_id AS unit_id, coalesce(s, list_transform(range(64), lambda i: 4294967295)) AS signature FROM documents LEFT JOIN (SELECT doc_id, list(v ORDER BY k) AS s FROM mn GROUP BY doc_id) USING (doc_id)),
  dg AS (SELECT signature, min(unit_id) AS u FROM sg GROUP BY signature), bd AS (SELECT u, signature, band, signature[4 * band + 1 : 4 * band + 4] AS s FROM dg, range(16) r(band)),
  ls AS (SELECT DISTINCT a.u AS i, b.u AS j, a.signature AS x, b.signature AS y FROM bd a JOIN bd b ON a.band = b.band AND a.s = b.s AND a.u < b.u)"""


@query(f"WITH {_MINHASH} SELECT unit_id, signature FROM sg")
def dup_minhash(spark, d):
    return _signatures(spark, d)


@query(f"WITH {_MINHASH} SELECT i, j FROM ls")
def dup_lsh(spark, d):
    return sm.lsh_candidates(_signatures(spark, d))


@query(
    f"""WITH {_MINHASH} SELECT i, j, len(list_filter(list_zip(x, y), lambda p: p[1] = p[2])) / 64 AS score FROM ls WHERE len(list_filter(list_zip(x, y), lambda p: p[1] = p[2])) >= 51.2
    UNION ALL SELECT u, unit_id, 1.0::DOUBLE FROM sg JOIN dg USING (signature) WHERE unit_id <> u"""
)
def dup_estimate(spark, d):
    """Of units of one signature the first has the links to others, and each other one a link to it."""
    return sm.estimated_links(_signatures(spark, d))


def _stars(groups):
    """The first unit of each group with each other one."""
    return groups.where("unit_id <> first").select(F.col("first").alias("i"), F.col("unit_id").alias("j"), F.lit(1.0).alias("score"))


@query(
    "WITH " + _lexical_sql(0.85).lstrip(", ") + f""", e AS ({_groups_sql("sha256(text)")}), m AS ({_groups_sql(f"sha256({_NORM})")})
    SELECT first AS i, unit_id AS j, 1.0::DOUBLE AS score, 'exact' AS method FROM e WHERE first <> unit_id
    UNION ALL SELECT first, unit_id, 1.0, 'normalized' FROM m WHERE first <> unit_id UNION ALL SELECT i, j, score, 'lexical' FROM lexical"""
)
def dup_report(spark, d):
    """The pairs of the three tiers that a report has unless others are asked for; a group of equal texts is a star at its first unit."""
    one = docs(spark, d)
    return sm.combined(
        ("exact", _stars(sm.checksum_groups(one))), ("normalized", _stars(sm.checksum_groups(one, normal=True))), ("lexical", sm.lexical_pairs(one))
    )


@query(
    """, c AS (SELECT doc_id, list_transform(range(64), lambda k: len(list_filter(s, lambda x: x = k))::DOUBLE) AS c FROM (SELECT doc_id, list_transform(t, lambda x: ('0x' || md5(x)[1:8])::BIGINT % 64) AS s FROM tk))
    SELECT doc_id AS unit_id, list_transform(c, lambda x: x / CASE WHEN list_sum(c) = 0 THEN 1 ELSE sqrt(list_dot_product(c, c)) END) AS embedding FROM c""",
    uses="tk",
)
def emb_hash(spark, d):
    return prep(spark, d).select("unit_id", sm.hashed_embedding(F.col("tokens"), 64).alias("embedding"))
