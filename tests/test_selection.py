"""Running sums, nearest vectors, selection, calibration, resampling, factors and chunk rules against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import chunks as ch
from textloom.operators import memory as mm
from textloom.operators import reliability as rl
from textloom.operators import retrieval as rt
from textloom.operators import factors as fc
from textloom.operators import selection as sl
from textloom.operators import settings as st
from textloom.operators import similarity as sm
from textloom.operators.relations import running


def test_running_sums_and_minima_over_ranges(spark):
    random.seed(1)
    rows = [(i, random.randint(0, 20), random.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    by = [F.desc("k"), F.col("id").asc()]
    got = {r.id: (r.total, r.rank) for r in running(df, by, {"total": F.coalesce("v", F.lit(0)), "rank": F.lit(1)}).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v or 0
        assert got[i] == (total, n)
    low = {r.id: r.low for r in running(df, [F.col("id")], {"low": F.col("k")}, F.min).collect()}
    assert low == {i: min(r[1] for r in rows[: i + 1]) for i, _, _ in rows}
    assert running(df.limit(0), by, {"total": F.col("v")}).count() == 0


def test_nearest_vectors_by_blocks(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(90, 5))
    chunks = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (201, [0.0] * 5), (202, [1.0])]
    queries = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(7, 5)))] + [(50, None)]
    got = rt.dense(spark.createDataFrame(chunks, "chunk_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, q array<double>"), 4, 0.1, block=3).collect()
    want = set()
    for q, v in queries[:-1]:
        scores = sorted(((round(float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)), 9), i) for i, c in chunks[:90]), key=lambda x: (-x[0], x[1]))
        want |= {(q, i, n) for n, (s, i) in enumerate(scores[:4], 1) if s >= 0.1}
    assert {(x.query_id, x.chunk_id, x["rank"]) for x in got} == want


@pytest.mark.parametrize("counted", [False, True])
def test_jaccard_pairs_against_all_pairs(spark, counted):
    random.seed(3)
    base = [random.choices("abcdefghijklmnop", k=12) for _ in range(12)]
    units = base + [b[:-2] + random.choices("abcxyz", k=2) for b in base] + [["z"], ["z"]]
    rows = [(i, t, u.count(t)) for i, u in enumerate(units) for t in set(u)]
    got = {(r.i, r.j): round(r.score, 9) for r in sm.jaccard_pairs(spark.createDataFrame(rows, "unit_id int, term string, count int"), 0.6, counted).collect()}
    want = {}
    for i, j in itertools.combinations(range(len(units)), 2):
        a, b = ({t: (u.count(t) if counted else 1) for t in set(u)} for u in (units[i], units[j]))
        both, every = sum(min(a.get(t, 0), b.get(t, 0)) for t in a), sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
        if both / every >= 0.6:
            want[i, j] = round(both / every, 9)
    assert got == want


def test_cosine_pairs_against_all_pairs(spark):
    random.seed(4)
    rows = []
    for i in range(25):
        w = {t: random.random() ** 2 for t in random.sample("abcdefghij", random.randint(1, 6))}
        n = sum(x * x for x in w.values()) ** 0.5
        rows += [(i, t, x / n) for t, x in w.items()]
    vectors = [{t: x for k, t, x in rows if k == i} for i in range(25)]
    dots = {(i, j): sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) for i, j in itertools.combinations(range(25), 2)}
    got = {(r.i, r.j) for r in sm.pairwise(spark.createDataFrame(rows, "unit_id int, term string, weight double"), 0.55).collect()}
    assert got == {p for p, d in dots.items() if d >= 0.55}


def test_calibration(spark):
    rows = [(i, 0.1 + 0.2 * (i % 5), int(i % 7 < i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, score double, truth int")
    for method in ("sigmoid", "isotonic"):
        made = sorted((r.score, r.calibrated) for r in sl.calibrated(df, df, method).select("score", "calibrated").distinct().collect())
        assert all(0 <= c <= 1 for _, c in made) and [c for _, c in made] == sorted(c for _, c in made)
    share = {s: np.mean([t for _, x, t in rows if x == s]) for s in {x for _, x, _ in rows}}
    assert dict(made) == pytest.approx(share, abs=1e-6)  # the shares rise, so the steps are the shares
    with pytest.raises(ValueError):
        sl.calibrated(df, df, "none")


def test_kappa_interval_holds_the_estimate_and_narrows(spark):
    r = np.random.default_rng(5)
    widths = []
    for n in (60, 2000):
        a = r.integers(0, 2, n)
        b = np.where(r.random(n) < 0.8, a, 1 - a)
        low, high = rl.bootstrap_agreement(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")).first()
        po, pe = (a == b).mean(), sum((a == v).mean() * (b == v).mean() for v in (0, 1))
        assert low <= (po - pe) / (1 - pe) <= high
        widths.append(high - low)
    assert widths[1] < widths[0] / 3
    assert tuple(rl.bootstrap_agreement(spark.createDataFrame([], "a int, b int")).first()) == (None, None)


def test_factors_find_planted_topics(spark):
    random.seed(6)
    groups = [["ant", "bee", "fly"], ["oak", "elm", "ash"]]
    rows = [(i, random.choices(groups[i % 2], k=20)) for i in range(60)]
    terms, shares, errors = fc.nmf(spark.createDataFrame(rows, "unit_id int, tokens array<string>"), 2, 12, top_n=3)
    by = {}
    for r in terms.collect():
        by.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups))
    assert all(max(r.shares) > 0.9 for r in shares.collect())
    assert errors == sorted(errors, reverse=True)


def test_matching_against_all_permutations():
    random.seed(11)
    assert sl.matched([{"a", "b"}, {"c"}], [{"c"}, {"a", "b"}]) == 1.0 and sl.matched([], []) == 1.0
    for _ in range(40):
        a, b = ([set(random.sample("abcdefgh", random.randint(0, 5))) for _ in range(random.randint(1, 5))] for _ in range(2))
        small, large = sorted((a, b), key=len)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want = max(sum(near(x, y) for x, y in zip(small, p)) / len(small) for p in itertools.permutations(large, len(small)))
        assert sl.matched(a, b) == pytest.approx(want)


def dense(rows):
    """The matrix of (unit_id, term, weight) rows, by sorted units and terms."""
    units, terms = sorted({r.unit_id for r in rows}), sorted({r.term for r in rows})
    row, column = ({x: i for i, x in enumerate(names)} for names in (units, terms))
    m = np.zeros((len(units), len(terms)))
    for r in rows:
        m[row[r.unit_id], column[r.term]] = r.weight
    return m, units, terms


def test_singular_vectors_against_numpy(spark):
    random.seed(7)
    df = spark.createDataFrame([(i, random.choices("abcdefgh", [8, 7, 6, 5, 4, 3, 2, 1], k=12)) for i in range(40)] + [(40, [])], "unit_id int, tokens array<string>")
    m, _, _ = dense(fc.weights_of(df).collect())
    v = np.linalg.svd(m)[2][:2].T
    v *= np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
    got = np.array([r.components for r in sorted(fc.svd(df, 2).collect(), key=lambda r: r.unit_id)])
    assert got == pytest.approx(np.r_[m @ v, np.zeros((1, 2))], abs=1e-9)


def test_principal_components_against_numpy(spark):
    random.seed(9)
    df = spark.createDataFrame([(i, random.choices("abcdefgh", [8, 7, 6, 5, 4, 3, 2, 1], k=12)) for i in range(40)] + [(40, []), (41, [])], "unit_id int, tokens array<string>")
    m, _, _ = dense(fc.weights_of(df).collect())
    m = np.r_[m, np.zeros((2, m.shape[1]))]
    m -= m.mean(axis=0)
    v = np.linalg.svd(m)[2][:2].T
    got = np.array([r.components for r in sorted(fc.principal(df, 2, steps=8).collect(), key=lambda r: r.unit_id)])
    want = m @ v
    assert got * np.sign((got * want).sum(axis=0)) == pytest.approx(want, abs=1e-6)


def test_singular_values_of_the_whole_vocabulary(spark):
    from textloom.plans.frequency import prep

    weights = fc.weights_of(prep(spark, "/root/testdata/sf0.01"))
    m, _, terms = dense(weights.collect())
    assert len(terms) > 20_000
    got = fc.singular(weights, 4)
    want = np.sqrt(np.linalg.eigvalsh(m @ m.T)[::-1][:4])
    assert got.values == pytest.approx(want, rel=1e-3)


def plain_nmf(m, k, rounds, tolerance):
    u, s, v = np.linalg.svd(m, full_matrices=False)
    w, h = np.zeros((len(m), k)), np.zeros((k, m.shape[1]))
    for i in range(k):
        if i == 0:
            w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(v[0])
            continue
        parts = [(np.maximum(sign * u[:, i], 0), np.maximum(sign * v[i], 0)) for sign in (1, -1)]
        x, y = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        a, b = np.linalg.norm(x), np.linalg.norm(y)
        w[:, i], h[i] = np.sqrt(s[i] * a * b) * x / a, np.sqrt(s[i] * a * b) * y / b
    w[w < 1e-6], h[h < 1e-6] = m.mean(), m.mean()
    errors = []
    for _ in range(rounds):
        w = w * (m @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        errors.append(np.linalg.norm(m - w @ h))
        if len(errors) > 10 and errors[-11] - errors[-1] < tolerance * errors[0]:
            break
        h = h * (w.T @ m) / np.maximum((w.T @ w) @ h, 1e-12)
    return w, h, errors


def test_nonnegative_factors_against_numpy(spark):
    from textloom.plans.frequency import prep

    p = prep(spark, "/root/testdata/sf0.001")
    m, units, terms = dense(fc.weights_of(p).collect())
    got, shares, errors = fc.nmf(p, 3, 4)
    w, h, want = plain_nmf(m, 3, 4, 1e-4)
    assert errors == pytest.approx(want, rel=1e-4)
    for t in range(3):
        order = sorted(range(len(terms)), key=lambda i: (-round(h[t, i], 9), terms[i]))[:10]
        assert [r.weight for r in sorted(got.where(f"topic = {t}").collect(), key=lambda r: r.rank)] == pytest.approx([h[t, i] for i in order], rel=1e-2)
    want_shares = dict(zip(units, w / w.sum(axis=1, keepdims=True)))
    assert all(r.shares == pytest.approx(want_shares[r.unit_id], abs=0.01) for r in shares.collect())


def test_chunk_rules(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    text = "Head line\nbody a\n\nHead line\nbody b\n\nHead line\nbody c\n\nother\nbody d"
    assert one(ch.without_edge_lines, text) == "body a\n\nbody b\n\nbody c\n\nother\nbody d"
    assert one(ch.without_edge_lines, "Head line\n\nHead line\n\nHead line") == "Head line\n\nHead line\n\nHead line"
    assert one(ch.heading_of, "## A title") == "A title" and one(ch.heading_of, "Title\n====\ntext") == "Title" and one(ch.heading_of, "#nothing") is None
    pair = spark.createDataFrame([("x" * 50 + "y" * 40, "y" * 40 + "z"), ("abc", "abc"), ("", None)], "a string, b string")
    assert [r[0] for r in pair.select(ch.overlap_chars(F.col("a"), F.col("b"))).collect()] == [40, 0, 0]


def test_memory_rules(spark):
    turns = spark.createDataFrame([(1, "I prefer short answers. I prefer SHORT answers.\nNever mind the project plan. password: x for the project"), (2, None)], "turn int, text string")
    assert [(r.turn, r.content) for r in mm.extracted(turns, ["turn"]).collect()] == [(1, "I prefer short answers.")]
    pair = spark.createDataFrame([("Do not like tea", "like tea"), ("I like tea", "it rains")], "a string, b string")
    assert [r[0] for r in pair.select(mm.contradicts(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_settings():
    assert st.normalised_filters({"Lang": ["b", "a", "a"], "x": "", "year_to": 3}) == {"lang": '["a","b"]', "year_to": "3"}
    with pytest.raises(ValueError):
        st.cleaning_steps({"nothing": True})
