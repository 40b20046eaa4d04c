"""Small rules that plans follow: spelling of filters and languages, modes, steps, retrieval plans, comparison of runs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages with a list of stop words.
STOPWORD_LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "tr")
CLEANING = ("dehyphenate", "whitespace", "edge_lines", "page_numbers", "bibliography", "tables", "custom")
_ALIASES = {"language": "lang", "yearfrom": "year_from", "yearto": "year_to", "documents": "doc_ids"}


def normalised_filters(filters: Mapping[str, object]) -> dict[str, str]:
    """Filters by their own names, without blank values; lists sorted and without repeats, as JSON."""
    out: dict[str, str] = {}
    for name, value in filters.items():
        key = _ALIASES.get(name.lower().replace("_", ""), name.lower())
        if isinstance(value, (list, tuple, set)) or key in ("lang", "source"):
            many = sorted({str(v).strip() for v in (value if isinstance(value, (list, tuple, set)) else [value])} - {"", "None"})
            if many:
                out[key] = json.dumps(many, separators=(",", ":"))
        elif value is not None and str(value).strip():
            out[key] = str(value).strip()
    return dict(sorted(out.items()))


def cleaning_steps(wanted: Mapping[str, bool]) -> list[str]:
    """The wanted steps in the order in which they run."""
    if set(wanted) - set(CLEANING):
        raise ValueError(f"unknown steps {sorted(set(wanted) - set(CLEANING))}")
    return [s for s in CLEANING if wanted.get(s)]


def normalised_list(values: Column) -> Column:
    """A filter's list of values in one spelling: trimmed, blanks and repeats gone, sorted, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.btrim(v)), lambda v: v != ""))))


def ordered_steps(wanted: Mapping[str, Column]) -> Column:
    """array<string>: the steps whose condition holds, in the order in which they run."""
    if set(wanted) - set(CLEANING):
        raise ValueError(f"unknown steps {sorted(set(wanted) - set(CLEANING))}")
    return F.array_compact(F.array(*[F.when(wanted[s], s) for s in CLEANING if s in wanted]))


def serialized(entries: DataFrame) -> DataFrame:
    """(path, expressions): a dictionary's ``entries`` (path, k, expression) by path, as JSON lists in order of k."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "expression"))), lambda x: x["expression"])  # a dictionary's own size
    return entries.groupBy("path").agg(F.to_json(ordered).alias("expressions"))


def language_code(tag: Column) -> Column:
    """The language of a tag such as "de_AT"."""
    return F.get(F.split(F.lower(F.replace(tag, F.lit("_"), F.lit("-"))), "-"), F.lit(0))


def capability(language: Column, full: Sequence[str] = STOPWORD_LANGUAGES) -> Column:
    return F.when(language.isin(*full), "full").otherwise("degraded")


def query_mode(query: Column) -> Column:
    """How a query without a stated mode is meant."""
    q = F.btrim(query)
    return F.when(F.contains(q, F.lit("*")) | F.contains(q, F.lit("?")), "wildcard").when(F.contains(q, F.lit(" ")), "phrase").otherwise("word")


def compared(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(parameter, run_a, run_b, changed): the fields of two runs' JSON settings; a missing one is null."""
    fields = lambda df, name: df.select(F.explode(F.from_json(column, "map<string,string>")).alias("parameter", name))
    both = fields(a, "run_a").join(fields(b, "run_b"), "parameter", "full_outer")
    return both.withColumn("changed", ~F.col("run_a").eqNullSafe(F.col("run_b")))


def retrieval_plan(intent: Column, top_k: int = 5, evidence_k: int = 12, candidates: int = 40) -> list[Column]:
    """How many chunks to return and to look at, and whether to spread them over documents, by what is asked."""
    narrow = intent.isin("define", "fact")
    return [
        F.when(narrow, min(top_k, 5)).otherwise(max(top_k, evidence_k)).alias("top_k"),
        F.when(narrow, min(candidates, top_k * 3)).otherwise(candidates).alias("candidates"),
        intent.isin("compare", "synthesis", "evidence", "contradiction").alias("diversify"),
    ]


# Openings of the variants that ask for and against.
SUPPORT = "Evidence supporting or agreeing with"
CONTRADICT = "Evidence contradicting, challenging, or presenting counter-arguments to"


def expanded(query: Column) -> Column:
    """array<struct<label, text>>: the query as it is, for support and for contradiction."""
    of = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    return F.array(of("neutral", query), of("support", F.concat(F.lit(SUPPORT + ": "), query)), of("contradict", F.concat(F.lit(CONTRADICT + ": "), query)))
