"""Queries on keyness, collocation, concordance and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import lexical as lx
from textloom.operators.relations import token_rel
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import query

_KEY = """, k AS (SELECT term, sum((lang = 'en')::INT)::BIGINT AS a, sum((lang = 'de')::INT)::BIGINT AS b FROM tok WHERE lang IN ('en', 'de') GROUP BY term),
  s AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM k), x AS (SELECT *, ta + tb AS n, a + b AS r FROM k, s),
  g AS (SELECT *, CASE WHEN a > 0 THEN a * ln(a / (ta * r / n)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (tb * r / n)) ELSE 0 END AS own,
    CASE WHEN ta - a > 0 THEN (ta - a) * ln((ta - a) / (ta * (n - r) / n)) ELSE 0 END + CASE WHEN tb - b > 0 THEN (tb - b) * ln((tb - b) / (tb * (n - r) / n)) ELSE 0 END AS rest,
    n * (a * (tb - b) - b * (ta - a)) * (a * (tb - b) - b * (ta - a)) / (r * (n - r) * ta * tb) AS chi FROM x)"""


def _pair(spark, d):
    rel = token_rel(prep(spark, d, "lang"), "lang")
    return rel.where("lang = 'en'"), rel.where("lang = 'de'")


@query(_KEY + " SELECT term, a, b, ta::BIGINT AS total_a, tb::BIGINT AS total_b FROM g", uses="tk tok")
def key_counts(spark, d):
    return lx.keyness_counts(*_pair(spark, d))


@query(_KEY + " SELECT term, a, b, round(2 * (own + rest), 4) AS statistic FROM g", uses="tk tok")
def key_g2(spark, d):
    return rounded(lx.keyness_counts(*_pair(spark, d)).select("term", "a", "b", lx.log_likelihood().alias("statistic")), 4)


@query(_KEY + " SELECT term, a, b, round(chi, 4) AS statistic, round(sqrt(chi / n), 6) AS phi FROM g", uses="tk tok")
def key_chi2(spark, d):
    made = lx.keyness_counts(*_pair(spark, d)).withColumn("statistic", lx.chi_square())
    phi = F.sqrt(F.col("statistic") / (F.col("total_a") + F.col("total_b")))
    return made.select("term", "a", "b", F.round("statistic", 4).alias("statistic"), F.round(phi, 6).alias("phi"))


@query(
    _KEY + """ SELECT term, round(log2(((a + 0.5) / ta) / ((b + 0.5) / tb)), 6) AS log_ratio,
    round(((a + 0.5) / (ta - a + 0.5)) / ((b + 0.5) / (tb - b + 0.5)), 4) AS odds_ratio,
    CASE WHEN a / ta > b / tb THEN 'a' WHEN a / ta < b / tb THEN 'b' ELSE 'neutral' END AS direction,
    round(least(ta * r / n, tb * r / n, ta * (n - r) / n, tb * (n - r) / n), 4) AS expected_min FROM g""",
    uses="tk tok",
)
def key_effect(spark, d):
    made = lx.with_effects(lx.keyness_counts(*_pair(spark, d)))
    return made.select("term", F.round("log_ratio", 6).alias("log_ratio"), F.round("odds_ratio", 4).alias("odds_ratio"), "direction", F.round("expected_min", 4).alias("expected_min"))


#: Exact p-values by sums of the probabilities of all tables with the same margins.
_FISHER = _KEY + """, fa AS (SELECT term, a, b, ta, tb, r, n, lgamma(ta + 1) + lgamma(tb + 1) + lgamma(r + 1) + lgamma(n - r + 1) - lgamma(n + 1) AS base FROM g),
  fb AS (SELECT *, base - lgamma(a + 1) - lgamma(ta - a + 1) - lgamma(b + 1) - lgamma(tb - b + 1) AS seen FROM fa),
  fc AS (SELECT term, a, b, seen, base, ta, tb, r, unnest(range(greatest(0, r - tb)::BIGINT, least(r, ta)::BIGINT + 1)) AS k FROM fb),
  fp AS (SELECT term, any_value(a) AS a, any_value(b) AS b, least(1, sum(CASE WHEN lp <= seen + 1e-6 THEN exp(lp) ELSE 0 END)) AS p FROM (SELECT *, base - lgamma(k + 1) - lgamma(ta - k + 1) - lgamma(r - k + 1) - lgamma(tb - r + k + 1) AS lp FROM fc) GROUP BY term)"""


def _fisher(spark, d):
    counts = lx.keyness_counts(*_pair(spark, d))
    return counts.select("term", "a", "b", lx.fisher_p("a", "b", "total_a", "total_b").alias("p"))


@query(_FISHER + " SELECT term, a, b, round(p, 5) AS p FROM fp", uses="tk tok")
def key_fisher(spark, d):
    """Exact p-values of all terms; tested against enumeration too."""
    return rounded(_fisher(spark, d), 5)


@query(_FISHER + """, rk AS (SELECT term, p, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS m FROM (SELECT term, round(p, 7) AS p FROM fp))
    SELECT term, round(p, 5) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 4) AS q FROM rk""", uses="tk tok")
def key_bh(spark, d):
    """The exact p-values of all terms, adjusted for their number."""
    tests = _fisher(spark, d).select("term", F.round("p", 7).alias("p"))
    return lx.benjamini_hochberg(tests, "p", "q", "term").select("term", F.round("p", 5).alias("p"), F.round("q", 4).alias("q"))


@query()
def key_report(spark, d):
    return lx.keyness(*_pair(spark, d))


@query(_FISHER + """, rk AS (SELECT term, p, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS m FROM (SELECT term, round(p, 7) AS p FROM fp))
    SELECT term AS id, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 4) AS q, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) <= 0.05 AS stands FROM rk WHERE p IS NOT NULL""", uses="tk tok")
def win_bh(spark, d):
    """Which terms stand at a false discovery rate of 5 %."""
    tests = _fisher(spark, d).select(F.col("term").alias("id"), F.round("p", 7).alias("p"))
    return lx.benjamini_hochberg(tests, "p", "q", "id").select("id", F.round("q", 4).alias("q"), (F.col("q") <= 0.05).alias("stands"))


@query(
    """, w AS (SELECT a.doc_id, a.term AS x, b.term AS y FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 5 AND a.term <> b.term)
    SELECT least(x, y) AS term_a, greatest(x, y) AS term_b, count(*) AS count FROM w GROUP BY 1, 2""",
    uses="tk tok",
)
def col_pairs(spark, d):
    return lx.pair_counts(prep(spark, d))


@query(
    """ SELECT coalesce(list_aggregate(list_transform(range(1, len(t)), lambda i: len(list_filter(t[i + 1 : i + 5], lambda y: y <> t[i]))), 'sum'), 0)::BIGINT AS n_pairs, doc_id AS unit_id FROM tk""",
    uses="tk",
)
def join_window_pairs(spark, d):
    """How many pairs each unit's windows make."""
    p = prep(spark, d)
    made = lx.window_pairs(p.select("tokens", "unit_id"), carry=("unit_id",)).groupBy("unit_id").agg(F.count("*").alias("n_pairs"))
    return p.select("unit_id").join(made, "unit_id", "left").na.fill(0, ["n_pairs"])


_COL = """, w AS (SELECT a.term AS x, b.term AS y FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 5 AND a.term <> b.term),
  c AS (SELECT least(x, y) AS term_a, greatest(x, y) AS term_b, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(*) >= 20),
  f AS (SELECT term, count(*) AS f FROM tok GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM tok),
  j AS (SELECT term_a, term_b, c AS count, fa.f AS freq_a, fb.f AS freq_b, n, ln((c / n) / ((fa.f / n) * (fb.f / n))) AS pmi, 2.0 * c / (fa.f + fb.f) AS dice
    FROM c JOIN f fa ON fa.term = term_a JOIN f fb ON fb.term = term_b, n WHERE fa.f >= 50 AND fb.f >= 50)"""


def _scores(spark, d, top_n):
    p = prep(spark, d)
    return lx.collocations(p, token_rel(p), 5, False, 20, 50, "pmi", top_n)


@query(
    _COL + """ SELECT term_a, term_b, count, freq_a, freq_b, round(pmi, 6) AS pmi, round(pmi / -ln(count / n), 6) AS npmi, round(dice, 6)::DOUBLE AS dice,
    round(14 + log2(dice), 6) AS log_dice, round((count - freq_a * freq_b / n) / sqrt(count), 6) AS t_score FROM j""",
    uses="tk tok",
)
def col_scores(spark, d):
    return rounded(_scores(spark, d, None))


@query(
    _COL + """ SELECT term_a, term_b, count, freq_a, freq_b, round(pmi, 6) AS pmi, round(pmi / -ln(count / n), 6) AS npmi, round(dice, 6)::DOUBLE AS dice,
    round(14 + log2(dice), 6) AS log_dice, round((count - freq_a * freq_b / n) / sqrt(count), 6) AS t_score FROM j
    ORDER BY j.pmi DESC, count DESC, term_a, term_b LIMIT 100""",
    uses="tk tok",
)
def col_report(spark, d):
    return rounded(_scores(spark, d, 100))


@query(
    _COL + """, top AS (SELECT * FROM j ORDER BY pmi DESC, count DESC, term_a, term_b LIMIT 100),
    e AS (SELECT term_a AS term, pmi, freq_a AS f FROM top UNION ALL SELECT term_b, pmi, freq_b FROM top)
    SELECT term, count(*) AS degree, round(sum(abs(pmi)), 6) AS weighted_degree, max(f) AS frequency FROM e GROUP BY term""",
    uses="tk tok",
)
def col_network(spark, d):
    return rounded(lx.network(_scores(spark, d, 100)))


_WS = r"""WITH u AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS t FROM documents),
  p AS (SELECT doc_id, t, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM u),
  k AS (SELECT *, lower(regexp_replace(w, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')) AS k FROM p)"""
_HIT = """SELECT doc_id AS unit_id, i::BIGINT AS token_start, array_to_string(t[greatest(i - 4, 1) : i], ' ') AS left_context,
  array_to_string(t[i + 1 : i + {n}], ' ') AS node, array_to_string(t[i + 1 + {n} : i + {n} + 5], ' ') AS right_context FROM {src}"""


def _hits(df):
    return df.withColumn("token_start", F.col("token_start").cast("long"))


@query(_WS + _HIT.format(n=1, src="k WHERE k = 'the'"))
def kwic_word(spark, d):
    return _hits(lx.kwic(docs(spark, d), ["the"]))


@query(_WS + ", m AS (SELECT a.* FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.k = 'of' AND b.k = 'the') " + _HIT.format(n=2, src="m"))
def kwic_phrase(spark, d):
    return _hits(lx.kwic(docs(spark, d), ["of", "the"]))


@query(_WS + _HIT.format(n=1, src="k WHERE regexp_matches(k, '^thin.*$')"))
def kwic_wildcard(spark, d):
    return _hits(lx.kwic(docs(spark, d), ["thin*"]))


@query(_WS + _HIT.format(n=1, src="k WHERE k = 'the'") + " ORDER BY doc_id, i LIMIT 100")
def kwic_cap(spark, d):
    return _hits(lx.kwic(docs(spark, d), ["the"]).orderBy("unit_id", "token_start").limit(100))


@query(
    """WITH m AS (SELECT doc_id AS unit_id, unnest(regexp_extract_all(text, '(?i)mail[0-9]+\\.example')) AS node FROM documents)
    SELECT unit_id, lower(node) AS node, count(*) AS n FROM m GROUP BY ALL"""
)
def kwic_regex(spark, d):
    found = lx.kwic_spans(docs(spark, d), r"mail[0-9]+\.example")
    return found.groupBy("unit_id", F.lower("node").alias("node")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS unit_id, len(regexp_extract_all(text, '(?i)of the'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i)of the')""")
def kwic_exact_phrase(spark, d):
    return lx.kwic_spans(docs(spark, d), "of the", "phrase").groupBy("unit_id").agg(F.count("*").alias("n"))


#: A small demonstration dictionary.
DICTIONARY = {"articles": {"english": ["the", "of the"], "german": ["der", "die"]}, "forms": ["thin*", "re:^ent.*ng$"], "exclusions": ["the other", "in the"]}

_DICT = """, h AS (
    SELECT doc_id AS unit_id, pos AS start, pos + 1 AS "end", 'the' AS expression, 'articles' AS category, 'english' AS subcategory FROM tok WHERE term = 'the'
    UNION ALL SELECT a.doc_id, a.pos, a.pos + 2, 'of the', 'articles', 'english' FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'
    UNION ALL SELECT doc_id, pos, pos + 1, term, 'articles', 'german' FROM tok WHERE term IN ('der', 'die')
    UNION ALL SELECT doc_id, pos, pos + 1, 'thin*', 'forms', NULL FROM tok WHERE starts_with(term, 'thin')
    UNION ALL SELECT doc_id, pos, pos + 1, 're:^ent.*ng$', 'forms', NULL FROM tok WHERE regexp_matches(term, '^ent.*ng$')),
  x AS (SELECT a.doc_id, a.pos AS s, a.pos + 2 AS e FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE (a.term = 'the' AND b.term = 'other') OR (a.term = 'in' AND b.term = 'the')),
  c AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = h.unit_id AND x.s < h."end" AND h.start < x.e))"""


def _dict_hits(spark, d):
    return lx.dictionary_hits(prep(spark, d), DICTIONARY)


for _name, _where in {
    "dict_match_token": "expression IN ('the', 'der', 'die')", "dict_match_phrase": "expression = 'of the'",
    "dict_match_wildcard": "expression = 'thin*'", "dict_match_regex": "expression = 're:^ent.*ng$'", "dict_exclusions": "true",
}.items():

    def _dict(spark, d, where=_where):
        return _dict_hits(spark, d).where(where).select("unit_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "expression", "category", "subcategory")

    query(_DICT + f" SELECT * FROM c WHERE {_where}", uses="tk tok", name=_name)(_dict)


@query(
    _DICT + """, n AS (SELECT count(*) AS u, sum(len(t)) AS t FROM tk),
    g AS (SELECT category, subcategory, expression, grouping(category, subcategory, expression) AS level, count(*) AS hits, count(DISTINCT unit_id) AS units_hit FROM c GROUP BY ROLLUP (category, subcategory, expression))
    SELECT category, subcategory, expression, level, hits, units_hit, round(hits * 1000 / t, 6)::DOUBLE AS rate, round(units_hit / u, 6) AS prevalence FROM g, n""",
    uses="tk tok",
)
def dict_report(spark, d):
    p = prep(spark, d)
    return rounded(lx.dictionary_report(lx.dictionary_hits(p, DICTIONARY), p)).withColumn("level", F.col("level").cast("long"))


@query("SELECT term, count(*) AS hits FROM tok WHERE term IN ('the', 'und', 'que') GROUP BY term", uses="tk tok")
def dict_flat(spark, d):
    return token_rel(prep(spark, d)).where(F.col("term").isin("the", "und", "que")).groupBy("term").agg(F.count("*").alias("hits"))

