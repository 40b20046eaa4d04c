"""Work on all weights in blocks gives what the rows of the matrix give."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import frequency as fr
from textloom.operators import lexical as lx
from textloom.operators import retrieval as rt
from textloom.operators import selection as sl
from textloom.operators import similarity as sm
from textloom.operators import weighed as wd
from textloom.operators.relations import dfm, token_rel


def _rows(spark, n=70):
    random.seed(5)
    rows = [(i, random.choices([f"w{int(random.paretovariate(0.7))}" for _ in range(40)], k=random.randint(0, 12)) + ["the"] * (i % 3)) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, rows[3][1]), (n + 3, ["only"]), (5, ["again", "the"])]  # a copy, and an id that repeats
    return spark.createDataFrame(rows, "unit_id int, tokens array<string>")


def test_tfidf_pairs_are_all_pairs(spark):
    rows = _rows(spark)
    w = sm.unit_tfidf(dfm(token_rel(rows)), rows.count()).collect()
    unit = {}
    for r in w:
        unit.setdefault(r.unit_id, {})[r.term] = r.weight
    want = {(i, j): sum(x * unit[j].get(t, 0) for t, x in unit[i].items()) for i in unit for j in unit if i < j}
    want = {p: s for p, s in want.items() if s >= 0.4}
    got = wd.tfidf_pairs(rows, 0.4, most=60)
    found = {(r.i, r.j): r.score for r in got.collect()}
    assert len(want) > 20 and found == pytest.approx(want)
    assert wd.tfidf_pairs(rows.where("unit_id < 0"), 0.4).count() == 0


def test_char_lengths_are_those_of_all_grams(spark):
    random.seed(6)
    texts = [" ".join("".join(random.choices("abAé\U0001f600\u4e00", k=random.randint(1, 5))) for _ in range(random.randint(0, 9))) for _ in range(40)]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 8000)))  # five of so large an alphabet don't fit a number
    rows = list(enumerate([*texts, None, "", " \t\n", "a", " b\x00 \x00 c\x00\x00 ", wide, wide[::-1], wide + " " + wide[5:900], texts[2]])) + [(5, "again aa")]
    df = spark.createDataFrame(rows, "unit_id int, text string")
    grams = df.select("unit_id", F.explode(fr.char_ngrams(F.col("text"))).alias("term"))
    m = grams.groupBy("unit_id", "term").agg(F.count("*").alias("count"))
    w = m.join(fr.weighted(m, "tfidf", df.count()), ["unit_id", "term"])
    want = {r.unit_id: (r.n, r.c, pytest.approx(r.l)) for r in w.groupBy("unit_id").agg(F.count("*").alias("n"), F.sum("count").alias("c"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l")).collect()}
    for each in (1 << 23, 100):
        made = wd.char_lengths(df, each=each)
        assert {r.unit_id: (r.n_features, r.n_grams, r.norm) for r in made.collect()} == want


def test_pair_counts_are_those_of_all_pairs(spark):
    rows = [(1, ["b", "a", "b", "é", None, "a", "z", "b"]), (2, None), (3, []), (4, ["a"]), (5, ["z", "a"] * 4), (6, ["\U0001f600", "\uffff", "a"])]
    df = spark.createDataFrame(rows, "unit_id int, tokens array<string>").repartition(2)
    for window, directional in ((5, False), (2, True), (1, False)):
        want = {(r.term_a, r.term_b): r["count"] for r in lx.window_pairs(df, window, directional).groupBy("term_a", "term_b").count().collect()}
        for each in (1, 1 << 22):
            assert {(r.term_a, r.term_b): r["count"] for r in lx.pair_counts(df, window, directional, each).collect()} == want


def test_totals_and_sizes_are_those_of_the_rows(spark):
    rows = _rows(spark)
    m = dfm(token_rel(rows))
    got = {r.scheme: (r.n, r.total) for r in wd.scheme_totals(rows).collect()}
    for scheme in fr.WEIGHTINGS:
        want = fr.weighted(m, scheme, rows.count()).agg(F.count("*"), F.sum(F.round("weight", 6))).first()
        assert got[scheme] == (want[0], pytest.approx(want[1], abs=2e-5))
    assert {tuple(r) for r in wd.scheme_totals(rows.where("unit_id < 0")).collect()} == {(s, 0, None) for s in fr.WEIGHTINGS}
    known = rows.where("tokens is not null")
    for some in (known, known.where("unit_id <> 5")):  # rows that share an id are one
        union = sl.feature_union({"words": fr.weighted(dfm(token_rel(some)), "tfidf", some.count()), "pairs": fr.weighted(dfm(fr.ngram_rel(some, 2)), "count", some.count())})
        want = {(r.unit_id, r.space): (r.n, pytest.approx(r.w)) for r in union.groupBy("unit_id", "space").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
        assert {(r.unit_id, r.space): (r.n_features, r.largest) for r in wd.feature_sizes(some, each=50).collect()} == want


def test_lexical_units_are_those_of_the_matrix(spark):
    units = _rows(spark).withColumnRenamed("unit_id", "chunk_id")
    terms = spark.createDataFrame([(1, "the"), (1, "w1"), (2, "w2"), (3, "none"), (3, "the"), (4, "again")], "query_id int, term string")
    m = token_rel(units.withColumnRenamed("chunk_id", "unit_id")).groupBy(F.col("unit_id").alias("chunk_id"), "term").agg(F.count("*").alias("count"))
    for every in (True, False):
        want = rt.lexical(m, terms, m.groupBy("chunk_id").agg(F.sum("count").alias("length")), 9, every=every)
        got = rt.lexical_units(units, terms, 9, every=every)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
