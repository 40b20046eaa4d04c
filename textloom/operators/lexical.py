"""Keyness, collocation, concordance and dictionary matching."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.relations import ratio, running
from textloom.tables import written


# --- keyness ---------------------------------------------------------------------------------


def keyness_counts(rel_a: DataFrame, rel_b: DataFrame, key: str = "term") -> DataFrame:
    """(term, a, b, total_a, total_b) for every term of either side."""
    counts = rel_a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(rel_b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    by_term = counts.groupBy(key).agg(F.sum("x").alias("a"), F.sum("y").alias("b"))
    totals = by_term.agg(F.sum("a").alias("total_a"), F.sum("b").alias("total_b"))
    return by_term.crossJoin(F.broadcast(totals))  # one row


def _cells() -> tuple[tuple[Column, Column], ...]:
    """Observed and expected counts of the two-by-two table."""
    a, b, ta, tb = F.col("a"), F.col("b"), F.col("total_a"), F.col("total_b")
    n, row = ta + tb, a + b
    return ((a, ta * row / n), (b, tb * row / n), (ta - a, ta * (n - row) / n), (tb - b, tb * (n - row) / n))


def log_likelihood() -> Column:
    """Dunning's G²; where a margin is empty only the term's own cells count."""
    a, b, ta, tb = F.col("a"), F.col("b"), F.col("total_a"), F.col("total_b")
    terms = [F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in _cells()]
    own = terms[0] + terms[1]
    empty = (a + b == 0) | (ta + tb - a - b == 0) | (ta == 0) | (tb == 0)
    return F.when((ta + tb <= 0) | (a + b == 0), 0.0).when(empty, 2 * own).otherwise(2 * (own + terms[2] + terms[3]))


def chi_square() -> Column:
    """Pearson's χ² without continuity correction; 0 where a margin is empty."""
    a, b, ta, tb = F.col("a"), F.col("b"), F.col("total_a"), F.col("total_b")
    n = (ta + tb).cast("double")
    cross = a * (tb - b) - b * (ta - a)
    below = (a + b).cast("double") * (n - a - b) * ta * tb
    return F.when(below > 0, n * cross.cast("double") * cross / below).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series) -> pd.Series:
    """Upper tail of χ² with one degree of freedom."""
    return statistic.map(lambda x: erfc(sqrt(max(x, 0.0) / 2)))


def _fisher_p(a: int, b: int, ta: int, tb: int) -> float:
    """Two-sided exact p: the tables with these margins that are no likelier than the one seen.

    Their probabilities follow each other by ratios, and beyond 40 deviations from the mean none is above 1e-300; so the
    work goes with the deviation and not with the counts.
    """
    row, n = a + b, ta + tb
    first, last = max(0, row - tb), min(row, ta)
    mean = row * ta / n
    reach = 40 * sqrt(mean * tb / n * (n - row) / max(1, n - 1)) + 40
    low, high = max(first, int(mean - reach)), min(last, int(mean + reach))
    if not low <= a <= high:
        return 0.0
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log((ta - x) / (x + 1)) + np.log((row - x) / (tb - row + x + 1))
    p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(p - p.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
    return pd.Series([_fisher_p(*map(int, x)) if x[2] > 0 and x[3] > 0 else 1.0 for x in zip(a, b, ta, tb)])


def with_effects(counts: DataFrame) -> DataFrame:
    """Adds rates, smoothed log2 ratio, corrected odds ratio, direction and least expected count."""
    a, b, ta, tb = F.col("a"), F.col("b"), F.col("total_a"), F.col("total_b")
    rate_a, rate_b = ratio(a, ta), ratio(b, tb)
    return counts.withColumns(
        {
            "rate_a": rate_a,
            "rate_b": rate_b,
            "log_ratio": F.when((ta <= 0) | (tb <= 0), 0.0).otherwise(F.log2(((a + 0.5) / ta) / ((b + 0.5) / tb))),
            "odds_ratio": ((a + 0.5) / (ta - a + 0.5)) / ((b + 0.5) / (tb - b + 0.5)),
            "direction": F.when(rate_a > rate_b, "a").when(rate_b > rate_a, "b").otherwise("neutral"),
            "expected_min": F.least(*[e for _, e in _cells()]),
        }
    )


def benjamini_hochberg(tests: DataFrame, p: str = "p", out: str = "q", *tie: str) -> DataFrame:
    """Adds step-up adjusted p-values over all tests; null p-values stay null and don't count.

    Ranks and the running minimum are taken in ranges of the tests, so that no task holds all of them.
    """
    some = F.col(p).isNotNull()
    tests = written(tests, "tests")
    every = tests.where(some).agg(F.count("*").alias("_m"))  # one row
    made = (
        running(tests.where(some), [F.col(p).asc(), *[F.col(t) for t in tie]], {"_rank": F.lit(1)})
        .crossJoin(F.broadcast(every))
        .withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    )
    made = running(made, [F.desc("_rank")], {out: F.col("_raw")}, F.min).withColumn(out, F.least(F.lit(1.0), F.col(out))).drop("_m", "_rank", "_raw")
    return made.unionByName(tests.where(~some).withColumn(out, F.lit(None).cast("double")))


def keyness(rel_a: DataFrame, rel_b: DataFrame, method: str = "log_likelihood", min_frequency: int = 1, top_n: int | None = 50) -> DataFrame:
    """Terms that tell two groups apart: statistic, p, adjusted p, effects; by (-statistic, term)."""
    counts = keyness_counts(rel_a, rel_b).where(F.col("a") + F.col("b") >= min_frequency)
    made = with_effects(counts)
    if method == "fisher":
        p = fisher_p("a", "b", "total_a", "total_b")
        made = made.withColumn("p", p).withColumn("statistic", -F.log10(F.greatest(F.col("p"), F.lit(1e-300))))
    else:
        made = made.withColumn("statistic", log_likelihood() if method == "log_likelihood" else chi_square()).withColumn("p", chi_square_p("statistic"))
        if method == "chi_square":
            made = made.withColumn("phi", F.sqrt(F.col("statistic") / (F.col("total_a") + F.col("total_b"))))
    made = benjamini_hochberg(made, "p", "q", "term")
    return made.orderBy(F.desc("statistic"), "term").limit(top_n) if top_n else made


# --- collocation -----------------------------------------------------------------------------


def window_pairs(prep: DataFrame, window: int = 5, directional: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(term_a, term_b, ...): each token with the next ``window`` tokens; equal terms don't pair.

    Pairs are made within each unit's array, so that no position join is shuffled.
    """
    toks = F.col("tokens")
    ahead = F.transform(toks, lambda t, i: F.struct(t.alias("a"), F.slice(toks, i + 2, F.lit(window)).alias("next")))
    pairs = prep.select(*carry, F.explode(ahead).alias("x")).select(*carry, F.col("x.a").alias("a"), F.explode("x.next").alias("b")).where("a <> b")
    if directional:
        return pairs.select(F.col("a").alias("term_a"), F.col("b").alias("term_b"), *carry)
    return pairs.select(F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b"), *carry)


def pair_counts(prep: DataFrame, window: int = 5, directional: bool = False, each: int = 1 << 24) -> DataFrame:
    """(term_a, term_b, count): how often each of ``window_pairs`` comes. About ``each`` tokens of a task are counted together as numbers,
    so that what is shuffled are their different pairs and not all of them. The pairs are made in turn by ranges of one of their terms, a few
    million at once."""

    def counted(lists: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        lists = lists.combine_chunks()
        unit = np.repeat(np.arange(len(lists), dtype=np.int32), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        ids = np.append(place, -1)[pc.fill_null(coded.indices, -1).to_numpy()]
        turns = 1 + len(ids) // (1 << 21)
        for turn in range(turns):
            codes = [np.zeros(0, np.int64)]
            for k in range(1, window + 1):
                a, b = ids[:-k], ids[k:]
                first = a if directional else np.minimum(a, b)
                some = np.flatnonzero((first % turns == turn) & (unit[:-k] == unit[k:]) & (a != b) & (a >= 0) & (b >= 0))
                first = first[some]
                codes.append(first * len(names) + (b[some] if directional else a[some] + b[some] - first))
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            for s in range(0, len(code), 1 << 16):
                a, b = np.divmod(code[s : s + (1 << 16)], len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(count[s : s + (1 << 16)])], ["term_a", "term_b", "count"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch.column(0))
            many += len(batch.column(0).flatten())
            if many >= each:
                yield from counted(pa.chunked_array(held))
                held, many = [], 0
        if many:
            yield from counted(pa.chunked_array(held))

    made = prep.select("tokens").mapInArrow(parts, "term_a string, term_b string, count bigint")
    return made.groupBy("term_a", "term_b").agg(F.sum("count").alias("count"))


def collocations(
    prep: DataFrame, rel: DataFrame, window: int = 5, directional: bool = False, min_count: int = 1, min_frequency: int = 1,
    by: str = "pmi", top_n: int | None = 100,
) -> DataFrame:
    """Pair counts with PMI, NPMI, Dice, logDice and t-score; by (-score, -count, a, b)."""
    counts = pair_counts(prep, window, directional).where(F.col("count") >= min_count)
    terms = rel.groupBy("term").agg(F.count("*").alias("f"))
    total = terms.agg(F.sum("f").alias("n"))  # one row
    kept = terms.where(F.col("f") >= min_frequency)
    joined = (
        counts.join(kept.select(F.col("term").alias("term_a"), F.col("f").alias("freq_a")), "term_a")
        .join(kept.select(F.col("term").alias("term_b"), F.col("f").alias("freq_b")), "term_b")
        .crossJoin(F.broadcast(total))
    )
    c, fa, fb, n = (F.col(x).cast("double") for x in ("count", "freq_a", "freq_b", "n"))
    pmi, dice = F.ln((c / n) / ((fa / n) * (fb / n))), 2 * c / (fa + fb)
    made = joined.select(
        "term_a", "term_b", "count", "freq_a", "freq_b", pmi.alias("pmi"),
        F.when(c >= n, 0.0).otherwise(pmi / -F.ln(c / n)).alias("npmi"), dice.alias("dice"), (14 + F.log2(dice)).alias("log_dice"),
        ((c - fa * fb / n) / F.sqrt(c)).alias("t_score"),
    )
    return made.orderBy(F.desc(by), F.desc("count"), "term_a", "term_b").limit(top_n) if top_n else made


def network(pairs: DataFrame, weight: str = "pmi") -> DataFrame:
    """Nodes of a pair table: degree, sum of absolute weights, frequency."""
    ends = pairs.select(F.col("term_a").alias("term"), weight, F.col("freq_a").alias("f")).unionAll(
        pairs.select(F.col("term_b").alias("term"), weight, F.col("freq_b").alias("f"))
    )
    return ends.groupBy("term").agg(F.count("*").alias("degree"), F.sum(F.abs(F.col(weight))).alias("weighted_degree"), F.max("f").alias("frequency"))


# --- concordance -----------------------------------------------------------------------------

_EDGES = r"(?U)^\P{Alnum}+|\P{Alnum}+$"


def bare(token: Column, case_sensitive: bool = False) -> Column:
    """A token without punctuation at its ends, lower-cased unless asked otherwise."""
    stripped = F.regexp_replace(token, _EDGES, "")
    return stripped if case_sensitive else F.lower(stripped)


def wildcard(pattern: str) -> str:
    """A pattern of ``*`` and ``?`` as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def kwic(units: DataFrame, words: Sequence[str], window: int = 5, case_sensitive: bool = False, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place where the white-space tokens of a unit match the words in a row, in context.

    A word holding ``*`` or ``?`` is a wildcard. One word is a word query, more are a phrase.
    """
    toks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    made = units.select(F.col(unit).alias("unit_id"), toks.alias("t")).withColumn("k", F.transform("t", lambda t: bare(t, case_sensitive)))

    def fits(token: Column, word: str) -> Column:
        word = word if case_sensitive else word.lower()
        return F.coalesce(token.rlike(wildcard(word)) if set(word) & set("*?") else token == word, F.lit(False))

    def here(i: Column) -> Column:
        out = fits(F.get(F.col("k"), i), words[0])
        for j, w in enumerate(words[1:], 1):
            out &= fits(F.get(F.col("k"), i + j), w)
        return out

    places = F.filter(F.sequence(F.lit(0), F.size("t") - 1), here)
    found = made.where(F.size("t") > 0).select("unit_id", "t", F.explode(places).alias("token_start"))
    i, n = F.col("token_start"), len(words)
    left = F.greatest(i - window, F.lit(0))
    return found.select(
        "unit_id", "token_start", F.array_join(F.slice("t", left + 1, i - left), " ").alias("left_context"),
        F.array_join(F.slice("t", i + 1, F.lit(n)), " ").alias("node"), F.array_join(F.slice("t", i + 1 + n, F.lit(window)), " ").alias("right_context"),
    )


def kwic_spans(units: DataFrame, pattern: str, mode: str = "regex", case_sensitive: bool = False, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """(unit_id, start, end, node): non-empty matches of a Python pattern, or of a phrase as it stands.

    Offsets are code points of the original text. Python, since users' patterns follow its rules.
    """
    made = re.compile(re.escape(pattern) if mode == "phrase" else pattern, 0 if case_sensitive else re.IGNORECASE)

    @F.pandas_udf("array<struct<start:int,end:int,node:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "node": m[0]} for m in made.finditer(t or "") if m[0]])

    return units.select(F.col(unit).alias("unit_id"), F.explode(find(F.col(text))).alias("m")).select("unit_id", "m.start", "m.end", "m.node")


# --- dictionaries ----------------------------------------------------------------------------


def dictionary_entries(spec: Mapping) -> list[dict]:
    """Flattens {category: {subcategory: [expressions]} or [expressions]} with an "exclusions" list."""
    out: list[dict] = []

    def kind(e: str) -> str:
        return "regex" if e.startswith("re:") else "wildcard" if set(e) & set("*?") else "phrase" if " " in e else "token"

    def walk(node: Mapping | Sequence[str], path: list[str]) -> None:
        if isinstance(node, Mapping):
            for name, child in node.items():
                walk(child, [*path, name])
        else:
            out.extend({"expression": e, "match_type": kind(e), "category": path[0], "subcategory": path[1] if len(path) > 1 else None, "path": path} for e in node)

    walk({k: v for k, v in spec.items() if k != "exclusions"}, [])
    out += [{"expression": e, "match_type": kind(e), "category": None, "subcategory": None, "path": ["exclusions"]} for e in spec.get("exclusions", ())]
    return out


def parsed_entries(entries: DataFrame) -> DataFrame:
    """(expression, match_type, category, subcategory, path): ``entries`` (path, expression) as a dictionary's matching takes them.

    A path is names between slashes; the first is the category, the second the subcategory. Blank expressions are left out.
    """
    e, parts = F.btrim("expression"), F.split("path", "/")
    kind = F.when(e.startswith("re:"), "regex").when(e.contains("*") | e.contains("?"), "wildcard").when(e.contains(" "), "phrase").otherwise("token")
    return entries.where(e != "").select(e.alias("expression"), kind.alias("match_type"), F.get(parts, F.lit(0)).alias("category"), F.get(parts, F.lit(1)).alias("subcategory"), parts.alias("path"))


def dictionary_hits(prep: DataFrame, spec: Mapping) -> DataFrame:
    """(unit_id, start, end, expression, category, subcategory): matches not overlapping an exclusion.

    Tokens and phrases are found by key, wildcards token by token; the dictionary's own size bounds
    the plan, not the data. Exclusions are dropped within a unit's own spans.
    """
    entries = dictionary_entries(spec)
    toks = F.col("tokens")

    def at(entry: dict) -> Column:
        words = entry["expression"].removeprefix("re:").lower().split(" ")
        n = len(words)

        def fits(token: Column, word: str) -> Column:
            if entry["match_type"] == "regex":
                return token.rlike(word)
            return token.rlike(wildcard(word)) if set(word) & set("*?") else token == word

        def here(i: Column) -> Column:
            out = F.lit(True)
            for j, w in enumerate(words):
                out &= F.coalesce(fits(F.get(toks, i + j), w), F.lit(False))
            return out

        span = lambda i: F.struct(
            i.alias("start"), (i + n).alias("end"), F.lit(entry["expression"]).alias("expression"),
            F.lit(entry["category"]).cast("string").alias("category"), F.lit(entry["subcategory"]).cast("string").alias("subcategory"),
        )
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), here), span)

    wanted = F.concat(*[at(e) for e in entries if e["category"] is not None])
    barred = [at(e) for e in entries if e["category"] is None]
    some = prep.where(F.size("tokens") > 0).select("unit_id", wanted.alias("hits"), (F.concat(*barred) if barred else F.slice(wanted, 1, 0)).alias("barred"))
    clear = F.filter("hits", lambda h: ~F.exists("barred", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    return some.select("unit_id", F.explode(clear).alias("h")).select("unit_id", "h.*")


def dictionary_report(hits: DataFrame, prep: DataFrame, rate_per: float = 1000.0) -> DataFrame:
    """Totals, rate and prevalence by category, subcategory and expression, with subtotals."""
    size = prep.agg(F.count("*").alias("units"), F.sum(F.size("tokens")).alias("toks"))  # one row
    by = hits.cube("category", "subcategory", "expression").agg(
        F.count("*").alias("hits"), F.countDistinct("unit_id").alias("units_hit"), F.grouping_id().alias("level")
    ).where(F.col("level").isin(0, 1, 3, 7))
    return by.crossJoin(F.broadcast(size)).select(
        "category", "subcategory", "expression", "level", "hits", "units_hit",
        ratio(F.col("hits") * rate_per, F.col("toks")).alias("rate"), ratio(F.col("units_hit"), F.col("units")).alias("prevalence"),
    )


