"""Five stages from raw documents to token ids, each an operator over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, mixing, pii, sentencepieces, simhash
from textloom.llm.common import small_batches, written
from textloom.llm.queries import MIX, MIX_SHARE, piece_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose letters speak for no language by this mean probability is rejected. Set from held-out rows, see README.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language the network can't tell, go."""
    small_batches(spark)
    judged = langid.with_language(docs.select(*COLUMNS), langid.fit(docs))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (five-word shingles, likeness 0.8 or more) stays."""
    small_batches(spark)
    return simhash.without_near_copies(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows."""
    small_batches(spark)
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights."""
    return mixing.mixed(docs, MIX, MIX_SHARE).where("_sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    small_batches(spark)
    made = sentencepieces.encode_documents(docs, piece_vocabulary())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("pieces", encode),
]

#: The stages rest on trained weights, hashes and piece tables that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
