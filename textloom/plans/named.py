"""The named analyses as queries: each gives what the query of its parts gives, so it shares that query's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import dispatch
from textloom.plans.frequency import docs, rounded
from textloom.plans.lexical import DICTIONARY
from textloom.plans.registry import ORACLE, query

#: Name, options, the entry whose SQL says the same, and digits.
_NAMED = (
    ("corpus_stats", {}, "agg_corpus_stats"), ("frequencies", {"top_n": 50}, "agg_term_report"), ("ngrams", {"n": 2, "top_n": 50}, "agg_ngram_report"),
    ("dfm", {"weighting": "bm25"}, "wt_bm25"), ("readability", {}, "agg_readability"), ("dictionary", {"spec": DICTIONARY}, "dict_report"),
    ("cooccurrence", {"min_count": 20, "min_frequency": 50}, "col_report"), ("similarity", {"metric": "jaccard", "min_score": 0.5}, "sim_jaccard_pairwise"),
    ("duplicate_detection", {}, "dup_report"), ("clustering", {"k": 5}, None), ("dimensionality_reduction", {}, None),
    ("keyness", {"group": "lang", "a": "en", "b": "de"}, None),
)
for _name, _options, _like in _NAMED:

    def _run(spark, d, name=_name, options=_options):
        return rounded(dispatch.run(name, docs(spark, d), **options))

    query(ORACLE[_like] if _like else None, name=_name)(_run)


@query(ORACLE["kwic_phrase"])
def kwic(spark, d):
    return dispatch.run("kwic", docs(spark, d), query="of the").withColumn("token_start", F.col("token_start").cast("long"))


@query(f"SELECT (SELECT count(*) FROM ({ORACLE['agg_term_report']})) AS n_terms, (SELECT count(*) FROM ({ORACLE['agg_readability']})) AS n_units, (SELECT n_tokens FROM ({ORACLE['agg_corpus_stats']})) AS n_tokens")
def analysis_pipeline(spark, d):
    """Three analyses in one call, and a figure of each."""
    made = dispatch.pipeline(docs(spark, d), [("frequencies", {"top_n": 50}), ("readability", {}), ("corpus_stats", {})])
    n_terms = made["frequencies"].agg(F.count("*").alias("n_terms"))
    return n_terms.crossJoin(made["readability"].agg(F.count("*").alias("n_units"))).crossJoin(made["corpus_stats"].select("n_tokens"))  # one row each
