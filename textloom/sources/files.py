"""Reading documents from files, and writing units, annotations and matrices."""

from __future__ import annotations

import unicodedata

import pandas as pd
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.relations import running


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with or without a byte order mark, NFC, stripped; null if more than a tenth can't be decoded."""

    def one(raw: bytes) -> str | None:
        text = bytes(raw).decode("utf-8-sig", "replace")
        if text and text.count("�") / len(text) > 0.1:
            return None
        return unicodedata.normalize("NFC", text).strip()

    return content.map(one)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one document a file; empty ones are left out."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded("content").alias("text")).where("text <> ''")


_SECTION = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("body", T.StringType())]))


@F.pandas_udf(_SECTION)
def sections(texts: pd.Series) -> pd.Series:
    """Parts of a Markdown text; a line of # opens one and stays in its body."""

    def one(text: str) -> list[dict]:
        out: list[dict] = []
        heading, lines = None, []
        for line in [*text.split("\n"), None]:
            if line is None or line.startswith("#"):
                body = "\n".join(lines).strip()
                if body:
                    out.append({"heading": heading, "body": body})
                heading, lines = (line.lstrip("#").strip(), [line]) if line else (None, [])
            else:
                lines.append(line)
        return out

    return texts.map(one)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, heading, body): one row a section."""
    return read_text(spark, path).select("path", F.posexplode(sections("text")).alias("position", "s")).select("path", "position", "s.heading", "s.body")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV file with text: "header: value | header: value" of the cells that aren't blank."""
    rows = spark.read.csv(path, header=True, multiLine=True)
    cells = [F.when(F.btrim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.btrim(F.col(f"`{c}`")))) for c in rows.columns]
    return rows.withColumn("text", F.concat_ws(" | ", *cells)).where("text <> ''")


def read_indicators(spark: SparkSession, path: str, missing: tuple[str, ...] = ("", "NA", "N/A", "..", "-", "null")) -> DataFrame:
    """(country, year, indicator, value) from a wide CSV; marks of absence dropped, thousands commas stripped."""
    rows = spark.read.csv(path, header=True)
    fields = [c for c in rows.columns if c not in ("country", "year")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.btrim(F.col(f"`{c}`")).alias("raw")) for c in fields]))
    long = rows.select("country", F.col("year").cast("int").alias("year"), pairs.alias("p")).select("country", "year", "p.*")
    value = F.expr("try_cast(replace(raw, ',', '') AS double)")
    return long.where(~F.coalesce("raw", F.lit("")).isin(*missing)).select("country", "year", "indicator", value.alias("value")).where("value IS NOT NULL")


def write_units(units: DataFrame, path: str, kind: str = "parquet") -> None:
    """Units as Parquet, or as CSV or JSON lines."""
    out = units.write.mode("overwrite")
    out.option("header", True).option("escape", '"').csv(path) if kind == "csv" else out.format(kind).save(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A matrix (unit_id, term, count) as two tables: cells (i, j, value), and terms (j, term) by term."""
    terms = running(matrix.select("term").distinct(), [F.col("term")], {"j": F.lit(1)}).select((F.col("j") - 1).alias("j"), "term")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    named = matrix.sparkSession.read.parquet(f"{path}/terms")
    matrix.join(named, "term").select(F.col("unit_id").alias("i"), "j", F.col("count").alias("value")).write.mode("overwrite").parquet(f"{path}/cells")


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Predictions as flat text: labels joined by |, scores as JSON."""
    return predictions.withColumns({"labels": F.array_join("labels", "|"), "scores": F.to_json("scores")})


def manifest(docs: DataFrame, units: DataFrame) -> DataFrame:
    """One row of JSON that describes a corpus: counts, languages, a checksum that order doesn't change."""
    langs = docs.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))
    languages = langs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    counts = docs.agg(F.count("*").alias("documents"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("checksum"))
    made = counts.crossJoin(units.agg(F.count("*").alias("units"))).crossJoin(languages)  # one row each
    return made.select(F.to_json(F.struct("documents", "units", "checksum", "languages")).alias("manifest"))


def replication_script(docs: DataFrame, units_file: str, groups: Sequence[str], name: str = "corpus") -> DataFrame:
    """(line, text): an R script that reads the exported units into quanteda and counts them anew, by each of ``groups`` too; one row a line.

    The number of units to expect is in it, so that a short export stops the script.
    """
    lines = [
        f"# Replication of {name} from its exported units", "library(quanteda)", f'units <- readr::read_csv("{units_file}")', "stopifnot(nrow(units) == {n})",
        'texts <- corpus(units, docid_field = "unit_id", text_field = "text")', "words <- tokens(texts, remove_punct = TRUE)", "counts <- dfm_tolower(dfm(words))", "print(topfeatures(counts, 25))",
        *[f'print(topfeatures(dfm_group(counts, groups = docvars(texts, "{g}")), 10, groups = {g}))' for g in groups],
    ]
    text = F.array(*[F.lit(x) for x in lines])
    return docs.agg(F.count("*").cast("string").alias("n")).select(F.posexplode(F.transform(text, lambda x: F.replace(x, F.lit("{n}"), F.col("n")))).alias("line", "text"))
