"""Queries on frequencies, matrices, weightings, diversity and readability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import NUMBER, checksum, token_estimate, tokens, whitespace_tokens, without_numbers, without_terms
from textloom.operators import frequency as fr
from textloom.operators import weighed as wd
from textloom.operators.relations import dfm, prepared, token_rel
from textloom.plans.registry import query, table
from textloom.tables import written


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def prep(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    return prepared(docs(spark, d), "doc_id", "text", None, *carry)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _count(df: DataFrame) -> int:
    return df.count()


@query("SELECT doc_id AS unit_id, t AS tokens FROM tk", uses="tk")
def tok_unicode(spark, d):
    return prep(spark, d)


@query("SELECT doc_id AS unit_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS tokens FROM documents")
def tok_whitespace(spark, d):
    return prepared(docs(spark, d), toks=whitespace_tokens(F.col("text")))


@query(
    r"SELECT doc_id AS unit_id, list_filter(t, lambda x: NOT regexp_matches(x, '^\p{N}+([.,]\p{N}+)*$')) AS tokens FROM tk", uses="tk"
)
def tok_numbers(spark, d):
    return prepared(docs(spark, d), toks=without_numbers(tokens(F.col("text"))))


STOP = ("the", "of", "and", "in", "to", "is", "not")


@query("SELECT doc_id AS unit_id, list_filter(t, lambda x: x NOT IN ('the','of','and','in','to','is')) AS tokens FROM tk", uses="tk")
def tok_stopwords(spark, d):
    return prepared(docs(spark, d), toks=without_terms(tokens(F.col("text")), STOP, keep=("not",)))


@query("SELECT doc_id AS unit_id, array_to_string(t, ' ') AS joined FROM tk", uses="tk")
def tok_join(spark, d):
    return prep(spark, d).select("unit_id", F.array_join("tokens", " ").alias("joined"))


@query(
    r""", num AS (SELECT term, count(*) AS removed FROM tok WHERE regexp_matches(term, '^\p{N}+([.,]\p{N}+)*$') GROUP BY term)
    SELECT term, removed FROM num ORDER BY removed DESC, term LIMIT 20""",
    uses="tk tok",
)
def tok_preview(spark, d):
    gone = token_rel(prep(spark, d)).where(F.col("term").rlike(NUMBER))
    return gone.groupBy("term").agg(F.count("*").alias("removed")).orderBy(F.desc("removed"), "term").limit(20)


@query("SELECT doc_id AS unit_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_estimates(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id AS unit_id, sha256(text) AS text_hash FROM documents")
def seg_hash(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), checksum(F.col("text")).alias("text_hash"))


@query(
    """, l AS (SELECT doc_id, len(t) AS n FROM tk)
    SELECT count(*) AS n_units, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS mean_length, round(median(n), 6) AS median_length,
      min(n) AS min_length, max(n) AS max_length, round(stddev_pop(n), 6) AS sd_length,
      (SELECT count(DISTINCT term) FROM tok) AS n_types FROM l""",
    uses="tk tok",
)
def agg_corpus_stats(spark, d):
    return rounded(fr.corpus_stats(prep(spark, d)))


@query(
    """, u AS (SELECT doc_id AS unit_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_types FROM tk)
    SELECT *, round(CASE WHEN n_tokens = 0 THEN 0 ELSE n_types / n_tokens END, 6) AS ttr,
      round(CASE WHEN n_tokens = 0 THEN 0 ELSE n_types / sqrt(n_tokens) END, 6) AS guiraud,
      round(CASE WHEN n_tokens <= 1 OR n_types <= 1 THEN 0 ELSE ln(n_types) / ln(n_tokens) END, 6) AS herdan FROM u""",
    uses="tk",
)
def agg_diversity(spark, d):
    return rounded(fr.unit_diversity(prep(spark, d)))


for _name, _column in (("agg_ttr", "ttr"), ("agg_guiraud", "guiraud"), ("agg_herdan", "herdan")):

    def _corpus_richness(spark, d, column=_column):
        stats = fr.with_richness(fr.corpus_stats(prep(spark, d)))
        return rounded(stats.select(column))

    _sql = {
        "ttr": "count(DISTINCT term) / count(*)",
        "guiraud": "count(DISTINCT term) / sqrt(count(*))",
        "herdan": "ln(count(DISTINCT term)) / ln(count(*))",
    }[_column]
    query(f"SELECT round({_sql}, 6) AS {_column} FROM tok", uses="tk tok", name=_name)(_corpus_richness)


@query(
    """, n AS (SELECT doc_id, len(t) AS n FROM tk WHERE len(t) >= 50),
    w AS (SELECT doc_id, n, unnest(range(0, n - 49)) AS s FROM n),
    r AS (SELECT w.doc_id, w.s, len(list_distinct(tk.t[w.s + 1 : w.s + 50])) AS r FROM w JOIN tk USING (doc_id))
    SELECT doc_id AS unit_id, round(sum(r)::DOUBLE / (count(*) * 50), 6) AS mattr FROM r GROUP BY doc_id""",
    uses="tk",
)
def agg_mattr(spark, d):
    return rounded(fr.unit_mattr(prep(spark, d)))


@query(
    """, s AS (SELECT doc_id, pos // 50 AS s, count(*) AS n, count(DISTINCT term) / 50 AS r FROM tok GROUP BY ALL)
    SELECT doc_id AS unit_id, round(avg(r), 6) AS msttr FROM s WHERE n = 50 GROUP BY doc_id""",
    uses="tk tok",
)
def agg_msttr(spark, d):
    return rounded(fr.unit_msttr(prep(spark, d)))


_FREQ = """, c AS (SELECT term, count(*) AS raw_count, count(DISTINCT doc_id) AS document_frequency FROM {rel} GROUP BY term),
    t AS (SELECT sum(raw_count) AS total FROM c)
    SELECT term, raw_count, round(raw_count / total, 6) AS relative_frequency, round(raw_count / total * 1000, 6) AS rate, document_frequency,
      round(document_frequency / (SELECT count(*) FROM documents), 6) AS document_prevalence,
      row_number() OVER (ORDER BY raw_count DESC, term) AS rank,
      round(sum(raw_count) OVER (ORDER BY raw_count DESC, term ROWS UNBOUNDED PRECEDING) / total, 6) AS cumulative_share FROM c, t"""


@query(_FREQ.format(rel="tok"), uses="tk tok")
def agg_term_freq(spark, d):
    p = prep(spark, d)
    return rounded(fr.frequencies(token_rel(p), _count(p)))


@query(_FREQ.format(rel="tok") + " ORDER BY rank LIMIT 50", uses="tk tok")
def agg_term_report(spark, d):
    p = prep(spark, d)
    return rounded(fr.top_frequencies(token_rel(p), _count(p), 50))


@query(_FREQ.format(rel="tok"), uses="tk tok")
def win_rank_cumshare(spark, d):
    p = prep(spark, d)
    return rounded(fr.frequencies(token_rel(p), _count(p)))


_BIGRAM = """, bi AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tk)"""


@query(_BIGRAM + _FREQ.format(rel="bi"), uses="tk")
def agg_ngrams(spark, d):
    p = prep(spark, d)
    return rounded(fr.frequencies(fr.ngram_rel(p, 2), _count(p)))


@query(_BIGRAM + _FREQ.format(rel="bi") + " ORDER BY rank LIMIT 50", uses="tk")
def agg_ngram_report(spark, d):
    p = prep(spark, d)
    return rounded(fr.top_frequencies(fr.ngram_rel(p, 2), _count(p), 50))


@query("SELECT coalesce(nullif(source, ''), 'unspecified') AS group_key, count(*) AS n_units, sum(len(t))::BIGINT AS n_tokens FROM tk GROUP BY 1", uses="tk")
def agg_group_totals(spark, d):
    return fr.group_totals(prep(spark, d, "source"), "source")


@query("SELECT doc_id AS unit_id, term, count(*) AS count FROM tok GROUP BY ALL", uses="tk tok")
def agg_dfm(spark, d):
    return dfm(token_rel(prep(spark, d)))


_TRIM = """, f AS (SELECT doc_id AS unit_id, term, count(*) AS count FROM tok GROUP BY ALL),
    k AS (SELECT term FROM f GROUP BY term HAVING sum(count) >= 5 AND count(*) BETWEEN 3 AND 400)"""


@query(_TRIM + " SELECT f.* FROM f SEMI JOIN k USING (term)", uses="tk tok")
def agg_dfm_trim(spark, d):
    return fr.trimmed(dfm(token_rel(prep(spark, d))), min_tf=5, min_df=3, max_df=400).select("unit_id", "term", "count")


@query(_TRIM + " SELECT doc_id, pos, term FROM tok SEMI JOIN k USING (term)", uses="tk tok")
def agg_vocab_trim(spark, d):
    rel = token_rel(prep(spark, d))
    kept = fr.trimmed(dfm(rel), min_tf=5, min_df=3, max_df=400).select("term").distinct()
    return rel.join(kept, "term", "left_semi").select(F.col("unit_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "term")


@query(
    """, f AS (SELECT doc_id, term FROM tok GROUP BY ALL), s AS (SELECT (SELECT count(*) FROM documents) AS n_units, count(DISTINCT term) AS n_features, count(*) AS nnz FROM f)
    SELECT *, round(nnz / (n_units * n_features), 8) AS density FROM s""",
    uses="tk tok",
)
def agg_dfm_summary(spark, d):
    p = prep(spark, d)
    return rounded(fr.matrix_summary(dfm(token_rel(p)), _count(p)), 8)


_F = ", f AS (SELECT doc_id AS unit_id, term, count(*) AS c FROM tok GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM f GROUP BY term), l AS (SELECT unit_id, sum(c) AS l FROM f GROUP BY unit_id)"
_WEIGHTS = {
    "wt_count": ("count", "c::DOUBLE"), "wt_binary": ("binary", "1.0"), "wt_log_count": ("log_count", "ln(1 + c)"), "wt_tf": ("tf", "c / l"),
    "wt_tfidf": ("tfidf", "c * (ln((n + 1) / (df + 1)) + 1)"), "wt_sublinear": ("sublinear_tfidf", "(1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1)"),
    "wt_bm25": ("bm25", "ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * l / ((SELECT sum(l) FROM l) / n)))"),
}
for _name, (_scheme, _sql) in _WEIGHTS.items():

    def _weighted(spark, d, scheme=_scheme):
        p = prep(spark, d)
        return rounded(fr.weighted(dfm(token_rel(p)), scheme, _count(p)))

    query(_F + f" SELECT unit_id, term, round({_sql}, 6)::DOUBLE AS weight FROM f JOIN df USING (term) JOIN l USING (unit_id), n", uses="tk tok", name=_name)(_weighted)


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+') AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, E' \t\n\r\v\f') <> '')) AS s FROM documents),
    y AS (SELECT doc_id, sum(CASE WHEN v = '' THEN 0 ELSE greatest(1, CASE WHEN suffix(v, 'e') AND g > 1 THEN g - 1 ELSE g END) END)::BIGINT AS y
      FROM (SELECT doc_id, trim(lower(x), '''') AS v, len(regexp_extract_all(trim(lower(x), ''''), '[aeiouy]+')) AS g FROM (SELECT doc_id, unnest(w) AS x FROM w)) GROUP BY doc_id),
    m AS (SELECT w.doc_id AS unit_id, len(w)::BIGINT AS n_words, greatest(s, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_sentences, coalesce(y, 0)::BIGINT AS n_syllables FROM w LEFT JOIN y USING (doc_id))
    SELECT *, round(CASE WHEN n_words = 0 THEN 0 ELSE 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words) END, 6)::DOUBLE AS flesch,
      round(CASE WHEN n_words = 0 THEN 0 ELSE 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59 END, 6)::DOUBLE AS grade FROM m""",
)
def agg_readability(spark, d):
    return rounded(fr.readability(docs(spark, d)))


@query(
    """WITH p AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(
      list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)),
      list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)))) AS gram FROM p),
    m AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), f AS (SELECT gram, count(*) AS df FROM m GROUP BY gram), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
    w AS (SELECT doc_id, gram, c, c * (ln((n + 1) / (df + 1)) + 1) AS w FROM m JOIN f USING (gram), n)
    SELECT doc_id AS unit_id, count(*) AS n_features, sum(c)::BIGINT AS n_grams, round(sqrt(sum(w * w)), 4) AS norm FROM w GROUP BY doc_id""",
)
def vec_char(spark, d):
    """The matrix of character n-grams by TF-IDF, as its rows' sizes and lengths."""
    return rounded(wd.char_lengths(docs(spark, d).select(F.col("doc_id").alias("unit_id"), "text")), 4)
