"""Operators whose rules SQL doesn't state: edge cases and brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import documents as dc
from textloom.operators import frequency as fr
from textloom.operators import lexical as lx
from textloom.operators import models as md
from textloom.operators import reliability as rl
from textloom.operators import retrieval as rt
from textloom.operators import similarity as sm
from textloom.operators.relations import dfm, prepared, token_rel
from textloom.sources import files


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_of_odd_texts(spark):
    rows = prepared(docs(spark, ["", "  ", None, "Don’t STOP 3.14", "Straße naïve"])).orderBy("unit_id").collect()
    assert [r.tokens for r in rows] == [[], [], [], ["don’t", "stop", "3", "14"], ["straße", "naïve"]]


def test_casefold_and_nfc(spark):
    df = docs(spark, ["Straße", "é", None])
    got = df.select(tx.casefold("text").alias("a"), tx.nfc("text").alias("b")).collect()
    assert [r.a for r in got] == ["strasse", "é", None]
    assert got[1].b == "é"


def test_mattr_against_windows(spark):
    random.seed(1)
    texts = [" ".join(random.choices("abcdefgh", k=n)) for n in (3, 10, 40)]
    got = {r.unit_id: r.mattr for r in fr.unit_mattr(prepared(docs(spark, texts)), 10).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        if len(w) < 10:
            assert i not in got
        else:
            assert got[i] == pytest.approx(sum(len(set(w[s : s + 10])) / 10 for s in range(len(w) - 9)) / (len(w) - 9))


def test_fisher_against_enumeration(spark):
    df = spark.createDataFrame([(3, 7, 20, 30), (0, 5, 10, 10), (8, 1, 12, 15)], "a int, b int, ta int, tb int")
    got = [r[0] for r in df.select(lx.fisher_p("a", "b", "ta", "tb")).collect()]
    for p, (a, b, ta, tb) in zip(got, [(3, 7, 20, 30), (0, 5, 10, 10), (8, 1, 12, 15)]):
        row, n = a + b, ta + tb
        prob = lambda x: math.comb(ta, x) * math.comb(tb, row - x) / math.comb(n, row)  # noqa: E731,B023
        want = sum(prob(x) for x in range(max(0, row - tb), min(row, ta) + 1) if prob(x) <= prob(a) * (1 + 1e-7))
        assert p == pytest.approx(want, rel=1e-6)


def test_kwic_phrase_wildcard_and_edges(spark):
    df = docs(spark, ["The cat, the CATS and cats.", "", None])
    got = lx.kwic(df, ["the", "cat*"], window=1).orderBy("token_start").collect()
    assert [(r.token_start, r.left_context, r.node, r.right_context) for r in got] == [(0, "", "The cat,", "the"), (2, "cat,", "the CATS", "and")]


def test_exclusions_drop_overlapping_hits(spark):
    p = prepared(docs(spark, ["new york is new", "york"]))
    got = lx.dictionary_hits(p, {"c": ["new", "york"], "exclusions": ["new york"]}).collect()
    assert sorted((r.unit_id, r.start, r.expression) for r in got) == [(0, 3, "new"), (1, 0, "york")]


def test_degenerate_agreement(spark):
    same = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert rl.cohen_kappa(same).first().kappa == 1.0
    none = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "unit_id int, coder_id int, value string")
    assert rl.krippendorff_alpha(none).first().alpha is None
    one = spark.createDataFrame([(1, 0, "x"), (1, 1, "x")], "unit_id int, coder_id int, value string")
    assert rl.krippendorff_alpha(one).first().alpha == 1.0


def test_bootstrap_covers_kappa(spark):
    random.seed(2)
    rows = [(v, v if random.random() < 0.8 else 1 - v) for v in (random.randint(0, 1) for _ in range(500))]
    pairs = spark.createDataFrame(rows, "a int, b int")
    k, ci = rl.cohen_kappa(pairs).first().kappa, rl.bootstrap_agreement(pairs).first()
    assert ci.low < k < ci.high and ci.high - ci.low < 0.3


@pytest.mark.parametrize("mode", ["proportional", "equal"])
def test_allocation_is_capped_and_full(mode):
    random.seed(3)
    for _ in range(200):
        sizes = {str(i): random.randint(0, 30) for i in range(random.randint(1, 6))}
        want = random.randint(0, 80)
        got = rl.allocate(sizes, want, mode)
        assert sum(got.values()) == min(want, sum(sizes.values()))
        assert all(got[k] <= sizes[k] for k in sizes)


def test_sample_repeats(spark):
    units = spark.range(200).select(F.col("id").alias("unit_id"), (F.col("id") % 7).alias("doc_id"), (F.col("id") % 3).cast("string").alias("s"))
    one, two = (sorted(r.unit_id for r in rl.stratified_sample(units.repartition(n), "s", 30, max_per_document=10).collect()) for n in (1, 5))
    assert one == two and len(one) == 30


def test_minhash_by_exact_arithmetic(spark):
    import hashlib

    text = "one two three four five six"
    got = docs(spark, [text, ""]).orderBy("doc_id").select(sm.minhash(8)("text")).collect()
    p = (1 << 61) - 1
    r = random.Random(1)
    pairs = [(r.randrange(1, p), r.randrange(0, p)) for _ in range(8)]
    w = text.split()
    h = [int(hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:8], 16) for i in range(4)]
    assert got[0][0] == [min(((a * x + b) % p) & 0xFFFFFFFF for x in h) for a, b in pairs]
    assert got[1][0] == [0xFFFFFFFF] * 8


def test_lexical_scores_against_all_pairs(spark):
    random.seed(4)
    base = ["".join(random.choices("abcd ", k=60)) for _ in range(6)]
    texts = base + [b[:-1] + "z" for b in base] + [b[:30] + "😀é" + b[31:] for b in base] + ["", "ab", "same text here", "Same  text here "]
    got = {(r.i, r.j): r.score for r in sm.lexical_pairs(docs(spark, texts)).collect()}
    norm = [" ".join(t.split()).lower() for t in texts]
    grams = [Counter(t[k : k + 5] for k in range(len(t) - 4)) if len(t) >= 5 else Counter([t] if t else []) for t in norm]
    want = {}
    firsts = [norm.index(t) for t in norm]  # equal normal forms are one unit
    for i, j in itertools.combinations(sorted(set(firsts)), 2):
        union = sum((grams[i] | grams[j]).values())
        if union and grams[i] and grams[j] and (s := sum((grams[i] & grams[j]).values()) / union) >= 0.85:
            want[i, j] = round(s, 4)
    assert got == want


def test_sentences_keep_abbreviations(spark):
    t = "Dr. Smith paid 3.14 dollars. He left! See e.g. this.  "
    got = dc.segment(docs(spark, [t, "", None]), "sentence").orderBy("position").collect()
    assert [r.text for r in got] == ["Dr. Smith paid 3.14 dollars.", "He left!", "See e.g. this."]
    assert all(t[r.start : r.end] == r.text for r in got)


def test_sentences_follow_the_language(spark):
    df = spark.createDataFrame([(1, "Siehe Abs. zwei vgl. drei. Ende.", "de"), (2, "Siehe Abs. zwei.", "en"), (3, "See dept. two.", None)], "doc_id int, text string, lang string")
    got = [(r.doc_id, r.text) for r in dc.segment(df, "sentence").orderBy("doc_id", "position").collect()]
    assert got == [(1, "Siehe Abs. zwei vgl. drei."), (1, "Ende."), (2, "Siehe Abs."), (2, "zwei."), (3, "See dept. two.")]


def test_cleaning(spark):
    df = docs(spark, ["a\n12\nb\n- 4 -\npage 3", "x|\n| a | b |\ny", "l1\nl2\nl3\nReferences\nz"])
    got = df.select(tx.clean_page_numbers("text"), tx.clean_tables("text"), tx.clean_bibliography("text")).collect()
    assert got[0][0] == "a\nb" and got[1][1] == "x|\ny" and got[2][2] == "l1\nl2\nl3"


def test_groups_never_leak(spark):
    rows = spark.range(400).select((F.col("id") % 23).alias("g"))
    by = md.grouped_split(rows, "g").groupBy("g").agg(F.countDistinct("split").alias("n"))
    assert by.where("n > 1").count() == 0


def test_drift_of_equal_and_disjoint(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "label string"), spark.createDataFrame([("z",)], "label string")
    assert md.label_drift(a, a).first().tvd == 0
    assert md.label_drift(a, b).first().tvd == 1


def test_learning_beats_chance(spark):
    random.seed(5)
    rows = [(i, [random.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) for _ in range(5)], float(i % 2), i // 4) for i in range(200)]
    df = md.grouped_split(spark.createDataFrame(rows, "unit_id int, tokens array<string>, label double, g int"), "g")
    made = md.scored(md.fit(df, size=64), df.where("split = 'test'"))
    assert md.binary_metrics(made, "label", "predicted").first().accuracy > 0.95


def test_empty_inputs(spark):
    none = docs(spark, [])
    p = prepared(none)
    assert fr.corpus_stats(p).first().n_units == 0
    assert fr.frequencies(token_rel(p), 0).count() == 0
    assert sm.checksum_groups(none).count() == 0
    assert dfm(token_rel(p)).count() == 0
    assert lx.kwic(none, ["a"]).count() == 0


def test_budget_cuts_the_last_chunk(spark):
    rows = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 10)], "query_id long, chunk_id string, rank int, n_tokens long")
    assert [r.kept_tokens for r in rt.packed(rows, 600, 512).orderBy("rank").collect()] == [50, 38, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# One\ntext\n## Two\nmore".encode())
    (tmp_path / "b.md").write_bytes(b"   ")
    got = files.read_markdown(spark, str(tmp_path / "*.md")).orderBy("position").collect()
    assert [(r.heading, r.body) for r in got] == [("One", "# One\ntext"), ("Two", "## Two\nmore")]
    (tmp_path / "c.csv").write_text('country,year,gdp\nA,2001,"1,234"\nB,2002,NA\n')
    assert [(r.country, r.value) for r in files.read_indicators(spark, str(tmp_path / "c.csv")).collect()] == [("A", 1234.0)]
    assert files.read_csv(spark, str(tmp_path / "c.csv")).first().text == "country: A | year: 2001 | gdp: 1,234"


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.92])
def test_lexical_pairs_are_complete_and_make_no_row_a_gram(spark, threshold, monkeypatch):
    r = random.Random(int(threshold * 100))
    texts = [" ".join(r.choice(("alpha", "beta", "gamma", "delta", "épée", "𝔘x", "zz")) for _ in range(r.choice((1, 2, 5, 12, 60, 200)))) for _ in range(40)]
    for t in list(texts):  # near copies on both sides of the threshold, and copies that only differ in case
        for share in (0.01, 0.03, 0.06, 0.1):
            texts.append("".join(c if r.random() > share / 4 else r.choice("qxé𝔘") for c in t))
        texts.append(t.upper().lower() + " ")
    texts += ["abcd", "abcde", "abce", "", " ", None, "a" * 3000, "a" * 3100]

    def fail(*_):
        raise AssertionError("grams as rows")

    monkeypatch.setattr(sm, "gram_counts", fail)
    got = {(x.i, x.j): x.score for x in sm.lexical_pairs(docs(spark, texts), threshold).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join((t or "").split()).lower(), i)
    grams = {i: Counter(t[k : k + 5] for k in range(max(1, len(t) - 4))) for t, i in first.items() if t}
    want = {}
    for i in grams:
        for j in grams:
            if i < j:
                both = (grams[i] & grams[j]).total()
                score = both / (grams[i].total() + grams[j].total() - both)
                if score >= threshold:
                    want[i, j] = round(score, 4)
    assert len(want) > 20 and set(got) == set(want) and all(abs(got[p] - want[p]) < 1.1e-4 for p in want)
