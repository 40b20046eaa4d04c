"""Corpus statistics, term and n-gram frequencies, lexical diversity, weightings, readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import ngrams, syllables
from textloom.operators.relations import ratio, running, token_rel
from textloom.tables import written


def corpus_stats(prep: DataFrame) -> DataFrame:
    """One row: units, tokens, vocabulary, and mean, median, least, greatest and population deviation of lengths."""
    n = F.size("tokens")
    lengths = prep.agg(
        F.count("*").alias("n_units"), F.coalesce(F.sum(n), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.percentile(n, F.lit(0.5)), F.lit(0.0)).alias("median_length"), F.coalesce(F.min(n), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_length"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("sd_length"),
    )
    vocabulary = token_rel(prep).agg(F.countDistinct("term").alias("n_types"))
    return lengths.crossJoin(vocabulary)  # one row each


def with_richness(stats: DataFrame, types: str = "n_types", toks: str = "n_tokens") -> DataFrame:
    """Adds type-token ratio, Guiraud's R and Herdan's C; 0 where undefined."""
    v, n = F.col(types), F.col(toks)
    return stats.withColumns(
        {
            "ttr": ratio(v, n),
            "guiraud": ratio(v, F.sqrt(n)),
            "herdan": F.when((n <= 1) | (v <= 1), 0.0).otherwise(F.ln(v) / F.ln(n)),
        }
    )


def unit_diversity(prep: DataFrame) -> DataFrame:
    """Richness of each unit."""
    made = prep.select("unit_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_types"))
    return with_richness(made)


def unit_mattr(prep: DataFrame, window: int = 50) -> DataFrame:
    """Moving-average type-token ratio within each unit, without a set for each window.

    A token is the first of its kind in the windows that start after its last occurrence; the
    number of these windows is its contribution. Null for units shorter than the window.
    """
    size = F.col("n")
    before = F.coalesce(F.lag("pos").over(Window.partitionBy("unit_id", "term").orderBy("pos")), F.lit(-1))
    rel = token_rel(prep.withColumn("n", F.size("tokens")), "n").where(size >= window)
    share = F.greatest(
        F.lit(0), F.least(F.col("pos"), size - window) - F.greatest(before, F.col("pos") - window)
    )
    made = rel.withColumn("share", share).groupBy("unit_id", "n").agg(F.sum("share").alias("total"))
    return made.select("unit_id", (F.col("total") / (window * (size - window + 1))).alias("mattr"))


def unit_msttr(prep: DataFrame, window: int = 50) -> DataFrame:
    """Mean type-token ratio of the full segments of each unit; the tail is dropped."""
    segments = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("tokens") / window).cast("int")),
        lambda k: F.size(F.array_distinct(F.slice("tokens", (k - 1) * window + 1, F.lit(window)))) / window,
    )
    return prep.where(F.size("tokens") >= window).select(
        "unit_id", (F.aggregate(segments, F.lit(0.0), lambda a, x: a + x) / F.size(segments)).alias("msttr")
    )


def frequencies(rel: DataFrame, n_units: Column | int, key: str = "term", rate_per: int = 1000) -> DataFrame:
    """Counts, rates, unit frequencies, rank by (-count, term) and running share of every term.

    The vocabulary is ranked in ranges, so that no task holds all of it.
    """
    counts = rel.groupBy(key).agg(F.count("*").alias("raw_count"), F.countDistinct("unit_id").alias("document_frequency"))
    return ranked(counts, n_units, key, rate_per)


def ranked(counts: DataFrame, n_units: Column | int, key: str, rate_per: int) -> DataFrame:
    counts = written(counts, "counts")
    total = counts.agg(F.sum("raw_count").alias("total"))
    share = F.col("raw_count") / F.col("total")
    units = n_units if isinstance(n_units, Column) else F.lit(n_units)
    placed = running(counts, [F.desc("raw_count"), F.col(key)], {"rank": F.lit(1), "run": F.col("raw_count")})
    return placed.crossJoin(F.broadcast(total)).select(  # one row
        key, "raw_count", share.alias("relative_frequency"), (share * rate_per).alias("rate"), "document_frequency",
        ratio(F.col("document_frequency"), units).alias("document_prevalence"), "rank", (F.col("run") / F.col("total")).alias("cumulative_share"),
    )


def top_frequencies(rel: DataFrame, n_units: int, top_n: int, key: str = "term", rate_per: int = 1000) -> DataFrame:
    """The first ``top_n`` rows of ``frequencies``: only they are ordered, whatever the vocabulary."""
    counts = rel.groupBy(key).agg(F.count("*").alias("raw_count"), F.countDistinct("unit_id").alias("document_frequency"))
    counts = written(counts, "counts")  # read for the total and for the first rows
    total = counts.agg(F.sum("raw_count").alias("_total"))
    top = counts.orderBy(F.desc("raw_count"), key).limit(top_n)
    order = Window.orderBy(F.desc("raw_count"), key)
    share = F.col("raw_count") / F.col("_total")
    return top.crossJoin(F.broadcast(total)).select(
        key, "raw_count", share.alias("relative_frequency"), (share * rate_per).alias("rate"), "document_frequency",
        (F.col("document_frequency") / F.lit(n_units)).alias("document_prevalence"), F.row_number().over(order).alias("rank"),
        (F.sum("raw_count").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_total")).alias("cumulative_share"),
    )


def ngram_rel(prep: DataFrame, n: int) -> DataFrame:
    """(unit_id, term): the n-grams of each unit."""
    return prep.select("unit_id", F.explode(ngrams(F.col("tokens"), n)).alias("term"))


def group_totals(prep: DataFrame, group: str) -> DataFrame:
    """Units and tokens of each group; null groups are "unspecified"."""
    name = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unspecified"))
    return prep.groupBy(name.alias("group_key")).agg(F.count("*").alias("n_units"), F.sum(F.size("tokens")).alias("n_tokens"))


def trimmed(matrix: DataFrame, min_tf: int = 1, max_tf: int | None = None, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """The rows of the terms whose total and unit frequencies are within bounds."""
    stats = matrix.groupBy("term").agg(F.sum("count").alias("tf"), F.count("*").alias("df"))
    keep = (F.col("tf") >= min_tf) & (F.col("df") >= min_df)
    if max_tf is not None:
        keep &= F.col("tf") <= max_tf
    if max_df is not None:
        keep &= F.col("df") <= max_df
    return matrix.join(stats.where(keep).select("term"), "term", "left_semi")


def matrix_summary(matrix: DataFrame, n_units: int) -> DataFrame:
    """Dimensions, stored cells, density."""
    return matrix.agg(
        F.lit(n_units).cast("long").alias("n_units"), F.countDistinct("term").alias("n_features"), F.count("*").alias("nnz"),
    ).withColumn("density", ratio(F.col("nnz").cast("double"), F.col("n_units") * F.col("n_features")))


WEIGHTINGS = {
    "count": "the count", "binary": "1", "log_count": "ln(1 + count)", "tf": "count over the unit's tokens",
    "tfidf": "count times inverse unit frequency", "sublinear_tfidf": "(1 + ln count) times inverse unit frequency",
    "bm25": "saturating count times probabilistic inverse unit frequency, by unit length",
}


def weighted(matrix: DataFrame, scheme: str, n_units: int, smooth: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(unit_id, term, weight) under one of ``WEIGHTINGS``."""
    c = F.col("count")
    if scheme in ("count", "binary", "log_count"):
        weight = {"count": c.cast("double"), "binary": F.lit(1.0), "log_count": F.log1p(c)}[scheme]
        return matrix.select("unit_id", "term", weight.alias("weight"))
    matrix = written(matrix, "matrix")  # read by each of the sums below
    if scheme == "tf":
        length = matrix.groupBy("unit_id").agg(F.sum("count").alias("length"))
        return matrix.join(length, "unit_id").select("unit_id", "term", (c / F.col("length")).alias("weight"))
    frequency = matrix.groupBy("term").agg(F.count("*").alias("df"))
    n, df = F.lit(float(n_units)), F.col("df")
    joined = matrix.join(frequency, "term")
    if scheme in ("tfidf", "sublinear_tfidf"):
        idf = F.ln((n + 1) / (df + 1)) + 1 if smooth else F.ln(n / F.greatest(df, F.lit(1)))
        tf = c if scheme == "tfidf" else 1 + F.ln(c)
        return joined.select("unit_id", "term", (tf * idf).alias("weight"))
    if scheme == "bm25":
        length = matrix.groupBy("unit_id").agg(F.sum("count").alias("length"))
        mean = length.agg((F.sum("length") / F.lit(n_units)).alias("mean"))  # one row
        idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
        return joined.join(length.crossJoin(F.broadcast(mean)), "unit_id").select(
            "unit_id", "term", (idf * c * (k1 + 1) / (c + norm)).alias("weight")
        )
    raise ValueError(f"unknown weighting {scheme!r}")


def readability(units: DataFrame, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """ASCII words, sentences, syllables, Flesch reading ease and Flesch-Kincaid grade of each unit."""
    t = F.coalesce(F.col(text), F.lit(""))
    made = units.select(
        F.col(unit).alias("unit_id"),
        F.regexp_extract_all(t, F.lit("[A-Za-z']+"), F.lit(0)).alias("w"),
        F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c")) != "")).alias("s"),
    ).select(
        "unit_id",
        F.size("w").cast("long").alias("n_words"),
        F.greatest(F.col("s"), F.when(F.size("w") > 0, 1).otherwise(0)).cast("long").alias("n_sentences"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + syllables(w)).alias("n_syllables"),
    )
    per_sentence, per_word = ratio(F.col("n_words"), F.col("n_sentences")), ratio(F.col("n_syllables"), F.col("n_words"))
    some = F.col("n_words") > 0
    return made.select(
        "*",
        F.when(some, 206.835 - 1.015 * per_sentence - 84.6 * per_word).otherwise(0.0).alias("flesch"),
        F.when(some, 0.39 * per_sentence + 11.8 * per_word - 15.59).otherwise(0.0).alias("grade"),
    )


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within blank-padded words."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w: Column, n: int) -> Column:
        last = F.greatest(F.length(w) - n + 1, F.lit(1))
        return F.when(F.length(w) < n, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))
        )

    return F.flatten(F.transform(words, lambda w: F.concat(*[runs(w, n) for n in range(low, high + 1)])))
