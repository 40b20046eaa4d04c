"""Interval joins, approximate search, postings, retrieval in one call, kept streams and resampled coefficients against plain versions."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ann, postings, spans
from textloom.operators import reliability as rl
from textloom.operators import retrieval as rt
from textloom.streaming.counts import stream_term_counts
from textloom.streaming.tables import LatestCounts, kept_up
from textloom.tables import new_path


def test_overlaps_against_all_pairs(spark):
    random.seed(1)
    make = lambda n: [(random.choice("ab"), s, s + random.randint(0, 9)) for s in random.choices(range(60), k=n)]
    hits, bars = make(200) + [("c", 1, 2)], make(25)
    one = lambda rows: spark.createDataFrame(rows, "unit_id string, start long, end long")
    got = sorted((r.unit_id, r.start, r.end, r.bar_start, r.bar_end) for r in spans.overlaps(one(hits), one(bars)).na.fill(-1).collect())
    want = []
    for u, s, e in hits:
        met = [(y, -x) for v, x, y in bars if v == u and x < e and s < y and x < y and s < e]
        best = max(met, default=(-1, 1))
        want.append((u, s, e, -best[1], best[0]))
    assert got == sorted(want)
    assert spans.overlaps(one([]), one(bars)).count() == 0 and spans.overlaps(one(hits), one([])).where("bar_end IS NULL").count() == len(hits)


def plain_representatives(rows, least):
    """Each chunk against all kept ones of its key."""
    out, kept = {}, {}
    for key, name, s, e, digest, score, rank in sorted(rows, key=lambda r: (r[0], -r[5], r[6] if r[6] is not None else 1 << 40, r[1])):
        for n, (ks, ke, kd) in kept.get(key, {}).items():
            both = min(e, ke) - max(s, ks) if None not in (s, e, ks, ke) else 0
            if (digest is not None and digest == kd) or (both > 0 and both >= least * (max(e, ke) - min(s, ks)) - 1e-9):
                out[name] = n
                break
        else:
            kept.setdefault(key, {})[name] = (s, e, digest)
            out[name] = name
    return out


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_representatives_against_all_kept(spark, least):
    random.seed(2)
    rows = []
    for i in range(600):
        s = random.randint(0, 200)
        rows.append((random.choice([1, 2, None]) or 3, f"c{i:03}", s, s + random.choice((0, 1, 5, 10, 11, 12, 60)), random.choice([None] * 5 + ["x", "y"]), random.choice((1.0, 2.0, 3.0)), random.choice((None, 1, 2))))
    rows.append((9, "odd", None, None, None, 1.0, None))
    df = spark.createDataFrame(rows, "doc long, chunk_id string, start long, end long, content_hash string, score double, rank int")
    got = {r.chunk_id: r.representative for r in spans.representatives(df, ["doc"], least).collect()}
    assert got == plain_representatives(rows, least)


def test_representatives_of_a_long_document_take_linear_time(spark):
    """100,000 spans of one document: ten times the spans take about ten times as long, not a hundred times."""
    took = []
    for n in (10_000, 100_000):
        df = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("chunk_id"), (F.col("id") * 7 % n).alias("start"), (F.col("id") * 7 % n + 40).alias("end"), F.lit(None).cast("string").alias("content_hash"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
        spans.representatives(df.limit(10), ["doc"]).count()
        began = time.time()
        kept = spans.representatives(df, ["doc"]).where("chunk_id = representative").count()
        took.append(time.time() - began)
        assert n / 10 < kept < n
    assert took[1] < 40 * took[0] + 5


def test_approximate_search(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(30, 24))
    rows = [(i, [float(x) for x in centers[i % 30] + r.normal(size=24) * 0.5]) for i in range(3000)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, []), (5003, [1.0, None] + [0.0] * 22)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    index = ann.build(df, block=64)
    assert index.probe < len(index.centroids)
    for allowed in (None, df.where("chunk_id % 3 = 1").select("chunk_id")):
        exact = rt.dense(df if allowed is None else df.join(allowed, "chunk_id"), asked, 10, -1.0).where("query_id < 5000")
        found = ann.search(index, asked, 10, allowed=allowed)
        by = [x.recall for x in ann.recall(found, exact).collect()]
        assert len(by) == 60 and np.mean(by) >= 0.9
        got = {(x.query_id, x.chunk_id): x.score for x in found.collect()}
        true = {(x.query_id, x.chunk_id): x.score for x in exact.collect()}
        assert all(got[k] == pytest.approx(true[k], abs=1e-8) for k in set(got) & set(true))
        assert allowed is None or all(c % 3 == 1 for _, c in got)
    every = ann.search(index, asked, 10, probe=len(index.centroids), wide=8)
    assert ann.recall(every, rt.dense(df, asked, 10, -1.0)).where("recall < 1 AND query_id < 5000").count() == 0
    none = df.limit(0)
    assert ann.search(ann.build(none), asked, 10).count() == 0 and ann.search(index, asked.limit(0), 10).count() == 0
    assert ann.search(index, asked, 10, allowed=none.select("chunk_id")).count() == 0


@pytest.mark.parametrize("every", [True, False])
def test_postings_against_a_full_scan(spark, every):
    random.seed(4)
    words = [f"w{i}" for i in range(40)]
    rel = [(d, t, c) for d in range(900) for t, c in {random.choices(words, [1 / (k + 1) for k in range(40)])[0]: random.randint(1, 5) for _ in range(12)}.items()]
    rel += [(1000 + i, "w3", 30) for i in range(3)]
    df = spark.createDataFrame(rel, "chunk_id long, term string, count long")
    lengths = df.groupBy("chunk_id").agg(F.sum("count").alias("length"))
    terms = spark.createDataFrame([(q, t) for q in range(25) for t in set(random.sample(words[:15], random.randint(1, 3)))] + [(99, "none")], "query_id long, term string")
    want = sorted(map(tuple, rt.lexical(df, terms, lengths, 5, every=every).select("query_id", "chunk_id", "score", "rank").collect()))
    found, looked = postings.search(postings.build(df, lengths, each=16), terms, 5, every, first=2)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == want
    sums = looked.agg(F.sum("blocks"), F.sum("scored")).first()
    assert sums[1] < sums[0], "no block was skipped"


def test_postings_of_units_move_units_alone(spark):
    random.seed(8)
    units = [(d % 280, random.choices("abcdefgh", k=random.randint(0, 9))) for d in range(300)] + [(400, None)]
    df = spark.createDataFrame(units, "chunk_id long, tokens array<string>")
    rel = df.select("chunk_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("count"))
    terms = spark.createDataFrame([(q, t) for q in range(9) for t in random.sample("abcdefgh", 2)] + [(9, "none")], "query_id long, term string")
    want = rt.lexical(rel, terms, rel.groupBy("chunk_id").agg(F.sum("count").alias("length")), 7)
    index = postings.of_units(df, each=16)
    found, _ = postings.search(index, terms, 7)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "score", "rank").collect()))
    assert index.lists.groupBy("term", "block").count().where("count > 1").count() == 0
    none = postings.search(postings.of_units(df.limit(0)), terms, 7)[0]
    assert none.count() == 0


def test_budget(spark):
    rows = [(1, "a", 1, 10), (1, "b", 2, 5), (1, "c", 3, 7), (2, "d", 1, 100), (2, "e", 2, 1)]
    got = rt.packed(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, n_tokens long"), 530, 512)
    assert {r.chunk_id: r.kept_tokens for r in got.collect()} == {"a": 10, "b": 5, "c": 3, "d": 18, "e": 0}


def test_a_stream_that_stops_and_goes_on(spark):
    source, table, state = (new_path(spark, n) for n in ("source", "counts", "state"))
    texts = [["a b a", "c"], ["a c", None], ["b b b d", ""], ["a", "e e"], ["d"]]
    counts = LatestCounts(spark, table, merge_every=3)

    def add(k):
        spark.createDataFrame([(t,) for t in texts[k]], "text string").coalesce(1).write.mode("append").parquet(source)

    def want(n):
        out = {}
        for t in itertools.chain(*texts[:n]):
            for w in (t or "").split():
                out[w] = out.get(w, 0) + 1
        return out

    have = lambda: {r.term: r["count"] for r in counts.read().collect()}
    assert have() == {}
    for k in range(len(texts)):
        add(k)
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source)
        kept_up(stream_term_counts(stream), counts, state)  # from where it stopped
        assert have() == want(k + 1)
    assert counts._folders()[0] >= 0, "nothing was merged"
    # a batch that comes again counts once
    last = spark.createDataFrame([("e", 2), ("d", 2)], "term string, count long")
    base, later = counts._folders()
    counts.put(last, later[-1] if later else base)
    assert have() == want(len(texts))


def plain_alpha(units):
    pairs = [[v for v in u if v is not None] for u in units]
    some = [u for u in pairs if len(u) >= 2]
    if not some:
        return None
    kinds = {v for u in pairs for v in u}
    n = sum(map(len, some))
    total = {v: sum(u.count(v) for u in some) for v in kinds}
    squares = sum(c * c for c in total.values())
    if len(kinds) < 2 or n * n == squares:
        return 1.0
    apart = sum(u.count(v) * (len(u) - u.count(v)) / (len(u) - 1) for u in some for v in set(u))
    return 1 - (n - 1) * apart / (n * n - squares)


def test_resampled_coefficients(spark):
    random.seed(5)
    units = []
    for _ in range(80):
        v = random.choice("xyz")
        units.append([None if random.random() < 0.15 else v if random.random() < 0.7 else random.choice("xyz") for _ in range(3)])
    rows = [(i, c, v) for i, u in enumerate(units) for c, v in enumerate(u)]
    df = spark.createDataFrame(rows, "unit_id long, coder_id int, value string")
    got = {r.coefficient: r for r in rl.bootstrap_coefficients(df, 600).collect()}
    assert got["krippendorff_alpha"].estimate == pytest.approx(rl.krippendorff_alpha(df).first()[0]) == pytest.approx(plain_alpha(units))
    assert got["fleiss_kappa"].estimate == pytest.approx(rl.fleiss_kappa(df).first()[0])
    pairs = df.where("coder_id = 0").join(df.where("coder_id = 1").select("unit_id", F.col("value").alias("b")), "unit_id").select(F.col("value").alias("a"), "b").dropna()
    assert got["cohen_kappa"].estimate == pytest.approx(rl.cohen_kappa(pairs).first()["kappa"])
    # units drawn one by one give about the same interval
    r = random.Random(6)
    drawn = sorted(plain_alpha([units[r.randrange(80)] for _ in range(80)]) for _ in range(600))
    low, high = drawn[math.floor(0.025 * 599)], drawn[math.ceil(0.975 * 599)]
    assert got["krippendorff_alpha"].low == pytest.approx(low, abs=0.05) and got["krippendorff_alpha"].high == pytest.approx(high, abs=0.05)
    assert rl.bootstrap_coefficients(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rl.bootstrap_coefficients(df, most_patterns=2)


def test_reliability_metadata(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 1, None), (3, 2, 1)], "unit_id int, coder_id int, value int")
    assert tuple(rl.metadata(df).first()) == (3, 3, 1, 5)
