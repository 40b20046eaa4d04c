"""Toxicity learns from every word of every labelled row."""

import random

from pyspark.sql import functions as F

from test_llm_operators import docs
from textloom.llm import toxicity


def test_long_texts_are_learned_from(spark):
    r = random.Random(3)
    words = lambda n: [r.choice(("then", "oath", "ring", "tiny")) for _ in range(n)]
    rows = [(i, " ".join([*words(5100), "blorgh"] if i % 3 == 0 else words(30))) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    made = toxicity.scored(docs(spark, [(1, "then a blorgh"), (2, "then a ring")]), toxicity.fit(docs(spark, rows), labels))
    assert [x.predicted for x in made.orderBy(F.col("doc_id")).collect()] == [1, 0]


def test_texts_without_a_label_stay_out_of_the_join(spark):
    from textloom.llm import toxicity as tx

    texts = spark.range(20_000).selectExpr("id", "'t' AS text").unionAll(spark.createDataFrame([(None, "n")], "id long, text string"))
    known = spark.range(0, 20_000, 7).selectExpr("id", "1 AS label")
    kept = {r.id for r in tx.likely(texts, known).collect()}
    assert kept >= set(range(0, 20_000, 7)) and len(kept) < 2 * 2858
    assert tx.likely(texts, known.limit(0)).count() == 0
    words = texts.selectExpr("'x' || id AS id", "text")
    assert words.join(known.selectExpr("'x' || id AS id"), "id", "left_semi").exceptAll(tx.likely(words, known.selectExpr("'x' || id AS id"))).count() == 0
