"""Importance resampling, toxicity and spelling variants against plain versions, gradients and SQL, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm_operators import ODD, SF, docs
from test_queries import connected, plain
from textloom.llm import crc, queries, resample, toxicity, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_spelling_variants"])
@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, name, folder):
    df = queries.queries()[name](spark, folder)
    got = sorted("|".join(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = connected(folder).execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    at = [names.index(c) for c in sorted(df.columns)]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in cur.fetchall())


# --- 11 ------------------------------------------------------------------------------------------


def test_crc_of_many_ranges():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(r.choice((0, 1, 2, 7, 63, 64, 65, 300)))) for _ in range(200)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    got = crc.crc32(data, start, end)
    assert got.tolist() == [zlib.crc32(p) for p in parts]
    both = crc.appended(got[:-1], got[1:], (end - start)[1:])
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]
    assert crc.with_byte(got, 32).tolist() == [zlib.crc32(p + b" ") for p in parts]


def plain_sample(rows, target, percent=25, least=20):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall

    def feats(t):
        w = find((t or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    made = {i: feats(t) for i, t in rows}
    s, t = Counter(b for _, f in made.values() for b in f), Counter(b for x in target for b in feats(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out = {}
    for i, (words, f) in made.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    drawn = sorted((-v[3], i) for i, v in out.items() if v[0] >= least)
    rank = {i: k + 1 for k, (_, i) in enumerate(drawn[: percent * len(drawn) // 100])}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


def test_importance_sample_against_a_plain_one(spark):
    r = random.Random(4)
    texts = [None, "", "--", "Ab", "É é-ab AB", "x" * 700 + " y"] + [" ".join(r.choice(("ab", "cd.", "Éf", "9x", "the", "of")) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts))
    target = ["ab cd ab", "the of", None, ""]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = {x.doc_id: (x.n_features, x.weight, x.score, x.rank) for x in resample.importance_sample(docs(spark, rows, extra=True), wanted).collect()}
    assert got == plain_sample(rows, target)
    assert sorted(v[3] for v in got.values() if v[3]) == list(range(1, sum(v[3] is not None for v in got.values()) + 1))


def test_importance_sample_of_odd_rows(spark):
    none = docs(spark, [])
    wanted = none.select("text")
    assert resample.importance_sample(none, wanted).count() == 0
    assert resample.importance_sample(docs(spark, ODD, extra=True), wanted).count() == len(ODD)
    # rows that share an id or have none are ranked each for itself, and equal scores by id
    many = [(None, "word " * 25)] * 30 + [(5, "word " * 25)] * 10
    got = resample.importance_sample(docs(spark, many), wanted).collect()
    assert len(got) == 40 and sorted(x.rank for x in got if x.rank) == list(range(1, 11))


# --- 12 ------------------------------------------------------------------------------------------


def small_network(seed=1):
    r = np.random.default_rng(seed)
    net = toxicity.fresh(np.arange(0, 40, 2, dtype=np.int32), r.normal(size=20), seed)
    for w in toxicity._parts(net).values():
        w += r.normal(0, 0.3, w.shape).astype(np.float32)
    net.E[0] = 0
    return net


def plain_activations(net, words):
    """Loops over places, filters, parts of a word and numbers of its embedding."""
    rows = [[int(np.searchsorted(net.known, b)) + 1 if b in net.known else 0 for b in w] for w in words] or [[0] * len(toxicity.STEMS)]
    n = len(rows)
    rows = rows + [[0] * len(toxicity.STEMS)] * (max(toxicity.SIZES) - 1)
    out = []
    for s in toxicity.SIZES:
        for f in range(toxicity.FILTERS):
            best = -math.inf
            for t in range(n):
                total = 0.0
                for k in range(s):
                    for row in rows[t + k]:
                        for d in range(toxicity.WIDTH):
                            total += float(net.E[row, d]) * float(net.F[s][k, d, f])
                best = max(best, total)
            out.append(max(0.0, best + float(net.b[s][f])))
    return out


def test_convolution_against_loops():
    net, r = small_network(), np.random.default_rng(2)
    texts = [r.integers(0, 40, (n, len(toxicity.STEMS))).astype(np.int32) for n in (0, 1, 2, 5, 30)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    line, begin = toxicity.padded(net.rows_of(np.concatenate(texts)), offsets)
    got, _ = toxicity.pooled(net, line, begin)
    assert np.allclose(got, [plain_activations(net, t.tolist()) for t in texts], atol=1e-4)


def test_gradients_by_differences():
    net, r = small_network(3), np.random.default_rng(4)
    for name, w in toxicity._parts(net).items():
        pass
    net.E, net.v, net.c = (x.astype(np.float64) for x in (net.E, net.v, net.c))
    net.F, net.b = {s: x.astype(np.float64) for s, x in net.F.items()}, {s: x.astype(np.float64) for s, x in net.b.items()}
    texts = [r.integers(0, 40, (n, len(toxicity.STEMS))).astype(np.int32) for n in (3, 6, 9)]
    line, begin = toxicity.padded(net.rows_of(np.concatenate(texts)), np.r_[0, np.cumsum([len(t) for t in texts])])
    y = np.array([1.0, 0.0, 1.0])
    _, g = toxicity._gradients(net, line, begin, y)
    for name, w in toxicity._parts(net).items():
        flat, grad = w.reshape(-1), g[name].reshape(-1)
        for at in r.choice(len(flat), min(8, len(flat)), replace=False):
            if name == "E" and at < toxicity.WIDTH:
                continue  # the row of padding and unknown words stays
            was, steps = flat[at], []
            for d in (1e-4, -1e-4):
                flat[at] = was + d
                steps.append(toxicity._gradients(net, line, begin, y)[0])
            flat[at] = was
            assert grad[at] == pytest.approx((steps[0] - steps[1]) / 2e-4, abs=2e-3)  # activations are kept in 32 bits


def planted(n, seed):
    r = random.Random(seed)
    syllables = ["an", "the", "ing", "or", "es", "ti", "ha", "re", "on", "ly"]
    rows = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(1, 3) * toxic):
            words.insert(r.randint(0, len(words)), r.choice(("blorgh", "SNARF", "zzwick")))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_planted_toxic_words_are_learned(spark):
    rows = planted(600, 5)
    base = docs(spark, [(i, t) for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net = toxicity.fit(base, labels)
    got = {x.doc_id: x for x in toxicity.scored(base, net).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    # labels of held-out rows, and lang, source and ids of what is scored, change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.scored(base.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), toxicity.fit(base, flipped))
    assert {x.doc_id: x.score for x in other.collect()} == {i: x.score for i, x in got.items()}
    # a word far into a long text counts, and a text's score doesn't depend on its neighbours
    long = " ".join(["then"] * 50_000)
    few = toxicity.scored(docs(spark, [(1, long), (2, f"{long} blorgh"), (3, f"snarf {long}"), (4, ""), (5, None)]), net)
    assert [x.predicted for x in few.orderBy("doc_id").collect()] == [0, 1, 1, 0, 0]


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (6, None), (None, 1), (8, 3)], "doc_id long, toxic int")
    assert toxicity.scored(docs(spark, ODD, extra=True), toxicity.fit(docs(spark, ODD), labels)).count() == len(ODD)
    none = toxicity.fit(docs(spark, []), labels)
    assert {x.score for x in toxicity.scored(docs(spark, ODD), none).collect()} == {0.0}
    assert toxicity.scored(docs(spark, []), none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    assert {x.score for x in toxicity.scored(docs(spark, ODD), toxicity.fit(docs(spark, ODD), ones)).collect()} == {1.0}


def test_held_out_labels_of_the_tables(spark):
    base, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(base, toxicity.fit(base, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(x.predicted == x.toxic for x in got) >= 0.9 * len(got)


# --- 13 ------------------------------------------------------------------------------------------


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        other = sorted((-n[v], v) for v in n if v != w and near(w, v))
        form = other[0][1] if other and -other[0][0] >= 5 * n[w] else None
        out[w] = [n[w], len(other), form, n[form] if form else None]
    for w, v in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        v.append(root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("bits", [64, 6])  # six bits make nearly all keys collide
def test_variants_against_all_pairs(spark, bits):
    r = random.Random(6)
    stems = ["".join(r.choice("abÉéÀñ") for _ in range(r.randint(5, 8))) for _ in range(12)]
    words = stems + ["aaabbb", "aabbbb", "aaaabbb", "aaaaaa", "aaaaaaa", "nächste", "nachste", "nächster"]
    for s in stems:
        for _ in range(8):
            k = r.randint(0, len(s) - 1)
            words.append(r.choice((s[:k] + r.choice("abé") + s[k:], s[:k] + s[k + 1 :], s[:k] + r.choice("abé") + s[k + 1 :])))
    weights = [r.choice((1, 1, 5, 40)) for _ in words]
    rows = [(i, " 1".join(r.choices(words, weights, k=60)) + "Ā.") for i in range(120)] + [(None, "aaaaaaa " * 9), (7, None), (7, ""), (9, "x" * 5000 + " " + "y" * 40)] + [(8, "nächste " * 6)] * 3
    rows += [(200 + k, f"chainaa {'chainab ' * 7}{'chainbb ' * 50}") for k in range(7)]
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in variants.spelling_variants(docs(spark, rows, extra=True), bits=bits).collect()}
    want = plain_variants(rows)
    assert got == want
    assert any(v[4] != (v[2] or w) for w, v in want.items()), "no chain of forms in the fixture"


def test_variants_of_odd_rows(spark):
    assert variants.spelling_variants(docs(spark, [])).count() == 0
    assert variants.spelling_variants(docs(spark, ODD, extra=True)).count() == 0
    long = [(1, "x" * 100_000), (2, "x" * 100_000), (3, "x" * 100_000), (4, "x" * 100_000), (5, "x" * 100_000)] + [(10 + i, "x" * 99_999) for i in range(5)]
    got = variants.spelling_variants(docs(spark, long)).collect()
    assert {(len(x.word), x.n_near) for x in got} in ({(100_000, 1), (99_999, 1)}, {(99_999, 0)}, {(100_000, 0)})
