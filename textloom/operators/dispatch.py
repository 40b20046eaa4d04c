"""The named analyses over a corpus of documents, with their settings: one entry for callers that have a name and options."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import factors as fc
from textloom.operators import frequency as fr
from textloom.operators import lexical as lx
from textloom.operators import models as md
from textloom.operators import similarity as sm
from textloom.operators.relations import dfm, prepared, token_rel


def _corpus_stats(docs: DataFrame) -> DataFrame:
    return fr.corpus_stats(prepared(docs))


def _frequencies(docs: DataFrame, top_n: int | None = None, rate_per: int = 1000) -> DataFrame:
    p = prepared(docs)
    return fr.top_frequencies(token_rel(p), p.count(), top_n, rate_per=rate_per) if top_n else fr.frequencies(token_rel(p), p.count(), rate_per=rate_per)


def _ngrams(docs: DataFrame, n: int = 2, top_n: int | None = None) -> DataFrame:
    p = prepared(docs)
    rel = fr.ngram_rel(p, n)
    return fr.top_frequencies(rel, p.count(), top_n) if top_n else fr.frequencies(rel, p.count())


def _dfm(docs: DataFrame, weighting: str = "count", min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    p = prepared(docs)
    kept = fr.trimmed(dfm(token_rel(p)), min_tf=min_tf, min_df=min_df, max_df=max_df)
    return fr.weighted(kept, weighting, p.count())


def _kwic(docs: DataFrame, query: str, window: int = 5, limit: int | None = None) -> DataFrame:
    hits = lx.kwic(docs, query.split(" "), window)
    return hits.orderBy("unit_id", "token_start").limit(limit) if limit else hits


def _readability(docs: DataFrame) -> DataFrame:
    return fr.readability(docs)


def _dictionary(docs: DataFrame, spec: Mapping, rate_per: float = 1000.0) -> DataFrame:
    p = prepared(docs)
    return lx.dictionary_report(lx.dictionary_hits(p, spec), p, rate_per)


def _keyness(docs: DataFrame, group: str, a: str, b: str, method: str = "log_likelihood", min_frequency: int = 1, top_n: int | None = 50) -> DataFrame:
    rel = token_rel(prepared(docs, "doc_id", "text", None, group), group)
    return lx.keyness(rel.where(F.col(group) == a), rel.where(F.col(group) == b), method, min_frequency, top_n)


def _cooccurrence(docs: DataFrame, window: int = 5, directional: bool = False, min_count: int = 1, min_frequency: int = 1, by: str = "pmi", top_n: int | None = 100) -> DataFrame:
    p = prepared(docs)
    return lx.collocations(p, token_rel(p), window, directional, min_count, min_frequency, by, top_n)


def _similarity(docs: DataFrame, metric: str = "tfidf", min_score: float = 0.5) -> DataFrame:
    p = prepared(docs)
    matrix = dfm(token_rel(p))
    if metric == "jaccard":
        return sm.jaccard_pairs(matrix, min_score)
    if metric == "tfidf":
        return sm.pairwise(sm.unit_tfidf(matrix, p.count()), min_score)
    raise ValueError(f"unknown metric {metric!r}")


def _duplicates(docs: DataFrame, methods: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    def star(normal: bool) -> DataFrame:
        groups = sm.checksum_groups(docs, normal=normal).where("unit_id <> first")
        return groups.select(F.col("first").alias("i"), F.col("unit_id").alias("j"), F.lit(1.0).alias("score"))

    def minhash() -> DataFrame:
        return sm.estimated_links(docs.select(F.col("doc_id").alias("unit_id"), sm.minhash()(F.col("text")).alias("signature")))

    tiers: dict[str, Callable[[], DataFrame]] = {
        "exact": lambda: star(False), "normalized": lambda: star(True), "lexical": lambda: sm.lexical_pairs(docs, threshold), "minhash": minhash,
    }
    return sm.combined(*[(m, tiers[m]()) for m in sm.methods(methods)])


def _clustering(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return md.clustered(prepared(docs), k, seed).select("unit_id", "cluster")


def _dimensions(docs: DataFrame, components: int = 2) -> DataFrame:
    return fc.principal(prepared(docs), components)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "corpus_stats": _corpus_stats, "frequencies": _frequencies, "ngrams": _ngrams, "dfm": _dfm, "kwic": _kwic, "readability": _readability,
    "dictionary": _dictionary, "keyness": _keyness, "cooccurrence": _cooccurrence, "similarity": _similarity, "duplicate_detection": _duplicates,
    "clustering": _clustering, "dimensionality_reduction": _dimensions,
}


def run(name: str, docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """One named analysis; an unknown name or option is an error before anything runs."""
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}; known are {sorted(OPERATORS)}")
    known = set(signature(OPERATORS[name]).parameters) - {"docs"}
    if set(options) - known:
        raise ValueError(f"{name} has no options {sorted(set(options) - known)}; known are {sorted(known)}")
    return OPERATORS[name](docs, **options)


def pipeline(docs: DataFrame, steps: list[tuple[str, dict]]) -> dict[str, DataFrame]:
    """Several analyses of the same documents, by name; all are checked before the first is planned."""
    for name, options in steps:
        if name not in OPERATORS or set(options) - set(signature(OPERATORS[name]).parameters):
            raise ValueError(f"step {name!r} with {sorted(options)} can't run")
    return {name: run(name, docs, **options) for name, options in steps}
