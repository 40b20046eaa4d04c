"""The training-data operators against brute force, round trips and held-out accuracy, with edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import LEAST_SCORE
from textloom.llm import components, embeddings, fingerprints, langid, materialize, mixing, pii, queries, sentencepieces, simhash, substrings, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=False):
    """(doc_id, text, lang, source) with, if asked, columns whose names clash with inner ones."""
    full = [(i, t, "en" if i is None or i % 2 else "de", f"s{(i or 0) % 3}") for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    names = ("id", "key", "fp", "node", "tag", "words", "_text", "_id", "n", "label", "begin", "slot", "row", "rep", "doc", "_tokens", "_weight", "_source", "_sampled")
    return df.select("*", *[F.lit("x").alias(n) for n in names]) if extra else df


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 30_000), (None, "no id"), (7, "é中😀 x\x00y")]


def test_odd_rows_and_empty_tables(spark):
    """Null, empty, blank, very long, repeated and null-id rows, with clashing extra columns; and no rows."""
    v = queries.piece_vocabulary()
    for f in (
        fingerprints.document_fingerprints, simhash.simhash_components, substrings.without_repeats,
        lambda d: sentencepieces.encode_documents(d, v), pii.personal_data, mixing.mixed,
        lambda d: langid.predict(d, langid.fit(d)),
    ):
        assert f(docs(spark, ODD, extra=True)).count() == len(ODD)
        assert f(docs(spark, [])).count() == 0


# --- 1 -------------------------------------------------------------------------------------------


def test_edited_texts_and_fingerprints(spark):
    random.seed(1)
    rows = [(i * 3, " ".join(random.choices("abcdefghij", k=random.randint(0, 40)))) for i in range(60)] + [(500, ""), (501, "é中" * 9)]
    base = docs(spark, rows)
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(base).collect()}
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    order = sorted(rows, reverse=True)
    pairs = list(zip(order, order[1:] + order[:1]))
    known = {x for (_, t), (_, n) in pairs for y in (t, n, t[: len(t) - len(t) // 3] + n[: len(t) // 3]) for x in shingles(y) if len(x) == 5}
    table = spark.createDataFrame([(list(x),) for x in known], "x array<string>")
    hashed = {tuple(r[0]): r[1] for r in table.select("x", F.xxhash64(*[F.get("x", k) for k in range(5)])).collect()}
    for (i, t), (j, n) in pairs:
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        changed = t[: len(t) - k] + n[:k]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for near, other in ((got[i].near_next, n), (got[i].near_edited, changed)):
            a, b = shingles(t), shingles(other)
            assert 0 <= near <= 1 and (near == 1 if a == b else near < 1 or len(a & b) > 0)
            if all(x in hashed for x in a | b):  # the estimate is the likeness of what lies below the threshold
                low = [{x for x in y if hashed[x] < -(2**63) + 2**64 // fingerprints.SCALED} for y in (a, b)]
                assert near == pytest.approx(len(low[0] & low[1]) / len(low[0] | low[1]) if low[0] | low[1] else float(a == b))
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    # many small ranges give what one range gives
    numbers = base.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("id"), F.lit(1).alias("tie"), F.length("text").alias("n"))
    many, one = fingerprints.in_order(numbers, rows_each=7), fingerprints.in_order(numbers)
    want = sorted((i, j, len(t)) for (i, _), (j, t) in zip(order[1:] + order[:1], order))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) == want


def test_sketch_estimates_and_merges(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(20_000)]
    a, b = " ".join(words[:16_000]), " ".join(words[8_000:])
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    s = df.select(*[fingerprints.sketched(F.col(c)).alias(c) for c in "ab"])
    x, y = F.col("a.hashes"), F.col("b.hashes")
    r = s.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(x, y), fingerprints.merged(x, y)).first()
    assert r[0] == pytest.approx(8 / 20, abs=0.04) and r[1] == pytest.approx(0.5, abs=0.05)
    union = df.select(fingerprints.sketch(F.col("c"))).first()[0]
    assert len(set(union) ^ set(r[2])) <= 4  # only shingles across the join differ


def test_short_texts_are_contained_in_long_ones(spark):
    words = [f"w{i}" for i in range(4000)]
    spans = [(" ".join(words[i : i + 9]), " ".join(words)) for i in range(0, 3900, 60)]
    df = spark.createDataFrame(spans, "a string, b string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "ab"])
    got = [r[0] for r in df.select(fingerprints.containment(F.col("a"), F.col("b"))).collect()]
    assert set(got) <= {1.0, None} and got.count(1.0) > len(got) / 2


# --- 2 -------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(20, 16))
    rows = []
    for i in range(400):
        v = base[i % 20] + r.normal(size=16) * 0.06
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 20 % 3)))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 16, 1), (1005, [float("nan")] * 16, 1), (1006, [], 1), (1007, [1.0, None], 1), (1008, [1e300] * 16, 1), (1009, [1e-300] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1000, 16):  # also with buckets cut in blocks
        got = {x.vec_id: x for x in embeddings.vector_components(df, block=block).collect()}
        links = Counter()
        parent = {x[0]: x[0] for x in rows}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        def usable(v):
            return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

        unit = {i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, _ in rows if usable(v)}
        for (i, _, a), (j, _, b) in itertools.combinations(rows, 2):
            if a is not None and a == b and i in unit and j in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
        assert {i: x.n_links for i, x in got.items()} == {i: links[i] for i, _, _ in rows}
        assert {i: x.component_id for i, x in got.items()} == {i: root(i) for i, _, _ in rows}
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_planted_links_are_recalled(spark):
    """Pairs of 64 components just over the threshold, among vectors of one label that have no partner."""
    r = np.random.default_rng(15)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=(1500, 64))
    side -= (side * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.9805 * x[:1500] + math.sqrt(1 - 0.9805**2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", F.lit("x").alias("id"), F.lit(1).alias("rep"), F.lit(2).alias("keys"))
    got = {g.vec_id: g.component_id for g in embeddings.vector_components(df).collect()}
    found = sum(got[3000 + i] == i for i in range(1500))
    assert found >= 1500 * 0.999 - 1 and sum(k != v for k, v in got.items()) == found
    assert embeddings.vector_components(df.limit(0)).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


# --- 3 -------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, None, "", "", None, None), (3, "no scheme", "", "", None, None),
        (4, "http://example.net", "example.net", "", None, None), (5, "http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (6, "http://h?x/y", "h", "", None, None), (7, "a://b://c/d", "b:", "//c/d", None, None), (8, "https://evilexample.com/de/1", "evilexample.com", "/de/1", None, None),
        (9, "https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"), (10, "http://q.net/#en", "q.net", "/", "net/", "block"),
        (11, "", "", "", None, None), (1, "http://É.net/x", "É.net", "/x", "net/", "block"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in urls.judged(df).collect()), key=str)
    assert got == sorted(((r[0], *r[2:5]) for r in rows), key=str)
    for r in urls.judged(df).collect():
        want = [x[5] for x in rows if x[0] == r.page_id and x[2] == r.host][0]
        assert r.verdict == (want or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judged(df.limit(0)).count() == 0


def test_url_model_on_held_out_words(tmp_path):
    """Hosts of a fifth of the words, and the paths alone, are held out in turn."""
    table = [(urls.split_url(u), v) for u, v in urls.labelled_urls()]
    hit = total = 0
    for k in range(5):
        gone = {w for words in (urls.BLOCKED_WORDS, urls.ALLOWED_WORDS) for i, w in enumerate(words) if i % 5 == k}
        held = [(t, v) for t, v in table if any(w in t.partition("/")[0] for w in gone)]
        model = urls.train([x for x in table if x not in held])
        hit += sum((p >= 0.5) == v for p, (_, v) in zip(model.score([t for t, _ in held]), held))
        total += len(held)
    assert hit / total >= 0.75
    model = urls.fitted()
    assert sum((p >= 0.5) == v for p, (_, v) in zip(model.score([t for t, _ in table]), table)) >= 0.98 * len(table)
    path = tmp_path / "table.csv"
    path.write_text("http://a.bad/x,1\nhttp://b.good/y,0\n")
    assert urls.labelled_urls(str(path)) == [("http://a.bad/x", 1), ("http://b.good/y", 0)]
    assert urls.fitted(str(path)).score(["a.bad/x"])[0] > urls.fitted(str(path)).score(["b.good/y"])[0]


def test_url_verdicts_against_a_plain_score(spark):
    """The model's probability, n-gram by n-gram."""
    model, rows = urls.fitted(), ["casino.example/bonus", "library.org/books", "", "é.fr/ü"]
    for text, got in zip(rows, model.score(rows)):
        raw, total, n = text.encode(), 0.0, 0
        for size in urls.SIZES:
            for i in range(len(raw) - size + 1):
                h = 1469598103934665603 + size
                for b in raw[i : i + size]:
                    h = (h ^ b) * 1099511628211 % 2**64
                total, n = total + float(model.weights[(h ^ h >> 32) % urls.BUCKETS]), n + 1
        assert got == pytest.approx(1 / (1 + math.exp(-(total / math.sqrt(max(1, n)) + model.bias))))


# --- 4 -------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    random.seed(6)
    rows = [(i, "word " * random.randint(5, 60), random.choice(["en"] * 6 + ["de", "fr"]), random.choice(["hot"] * 5 + ["a", "b"]), random.choice("xy")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    made = mixing.mixed(df, {"_lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "_source": {"hot": 0.4, "a": 0.3, "b": 0.3}}, 0.3, topic=F.col("topic"))
    total = made.agg(F.sum("_tokens")).first()[0]
    for column, shares in (("_lang", {"en": 0.5, "de": 0.3, "fr": 0.2}), ("_source", {"hot": 0.4, "a": 0.3, "b": 0.3})):
        for r in made.groupBy(column).agg(F.sum(F.col("_tokens") * F.col("_weight")).alias("want"), F.sum(F.when(F.col("_sampled"), F.col("_tokens"))).alias("got")).collect():
            assert r.want / total == pytest.approx(0.3 * shares[r[column]], rel=0.02)
            assert r.got / total == pytest.approx(0.3 * shares[r[column]], rel=0.2)
    assert made.where("_weight < 0 OR _weight > 1").count() == 0
    again = mixing.mixed(df.repartition(7), {"_lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "_source": {"hot": 0.4, "a": 0.3, "b": 0.3}}, 0.3, topic=F.col("topic"))
    assert sorted(r[0] for r in again.where("_sampled").select("doc_id").collect()) == sorted(r[0] for r in made.where("_sampled").select("doc_id").collect())


def test_raking_against_a_plain_loop(spark):
    r = np.random.default_rng(16)
    have = r.integers(1, 1000, (4, 3, 2)).astype(float)
    have[0, 1, 1] = 0
    aims = {"_source": [0.1, 0.2, 0.3, 0.4], "_lang": [0.5, 0.3, 0.2], "_topic": [0.6, 0.4]}
    targets = {m: {str(i): a for i, a in enumerate(v)} for m, v in aims.items()}
    cells = spark.createDataFrame([(str(i), str(j), str(k), float(have[i, j, k])) for i, j, k in np.ndindex(4, 3, 2) if have[i, j, k]], "_source string, _lang string, _topic string, have double")
    got = np.zeros(have.shape)
    for x in mixing.raked(cells, targets, 0.05, tolerance=1e-6).collect():
        got[int(x._source), int(x._lang), int(x._topic)] = x.want
    want, budget = have * 0.05, 0.05 * have.sum()
    for _ in range(500):
        for axis, m in enumerate(mixing.MARGINS):
            rest = tuple(a for a in range(3) if a != axis)
            want *= np.expand_dims(np.array(aims[m]) * budget / want.sum(axis=rest), rest)
    assert (want <= have).all() and got == pytest.approx(want, rel=1e-2, abs=0.1)


def test_targets_that_cannot_hold_are_warned_of(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10.0), ("b", "de", "x", 90.0)], "_source string, _lang string, _topic string, have double")
    with pytest.warns(UserWarning, match="can't all hold"):
        got = mixing.raked(cells, {"_source": {"a": 0.5, "b": 0.5}, "_lang": {"en": 0.1, "de": 0.9}}, 0.2).collect()
    assert all(0 <= x.want <= x.have for x in got)


def test_scarce_values_give_all_they_have(spark):
    cells = spark.createDataFrame([("a", "en", "x", 5.0), ("b", "en", "x", 60.0), ("c", "en", "x", 35.0)], "_source string, _lang string, _topic string, have double")
    got = {x._source: x.want for x in mixing.raked(cells, {"_source": {"a": 0.4, "b": 0.3, "c": 0.3}}, 0.5).collect()}
    assert got == pytest.approx({"a": 5.0, "b": 22.5, "c": 22.5}, rel=1e-3)


def test_topics(spark):
    texts = ["The court gave copyright to all. " * 3, "plain words only " * 60, "brief", "12 34 56 78", None, "prix vente " + "mot " * 30, "one court " * 70]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(mixing.topic_of(F.col("t")), mixing.form_of(F.col("t")))).collect()]
    assert got == ["law", "prose", "brief", "numeric", None, "commerce", "prose"]


# --- 5 -------------------------------------------------------------------------------------------


def test_every_near_pair_shares_an_anchor(spark):
    r = np.random.default_rng(7)
    fps = []
    for _ in range(40):
        x = int(r.integers(0, 2**64, dtype=np.uint64))
        fps.append(x)
        for flips in ((0,), (63,), (5, 63), (1, 2), (62, 63)):
            fps.append(x ^ sum(1 << b for b in flips))
    fps = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    got = components.connected_components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    root = {r.node: r.root for r in got.collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert {f: root.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_simhash_bits(spark):
    import xxhash

    random.seed(8)
    rows = [(i, " ".join(random.choices(["A", "b", "C\tD", "é"], k=n))) for i, n in enumerate((0, 1, 2, 3, 9, 40))]
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_components(docs(spark, rows)).collect()}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert got[i] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


# --- 6 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "kmer", "bits"), [(6, 3, 64), (35, 12, 64), (6, 3, 3), (6, 3, 5)])
def test_substrings_against_all_windows(spark, window, kmer, bits):
    """With few bits to a word's hash, words collide all the time, and only their comparison can tell."""
    random.seed(9)
    alphabet = [f"w{i}" for i in range(200)]
    shared = [random.choices(alphabet, k=random.randint(window, 3 * window)) for _ in range(5)]
    rows = []
    for i in range(60):
        w = random.choices(alphabet, k=random.randint(0, 4 * window))
        for _ in range(random.randint(0, 2)):
            p = random.choice(shared)
            a = random.randint(0, len(p) - 1)
            k = random.randint(0, len(w))
            w[k:k] = p[a:]
        rows.append((i, random.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(100, rows[3][1]), (101, "a " * 90), (102, "a b " * 60), (103, None), (104, " ".join(alphabet[:window])), (104, " ".join(alphabet[:window]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs(spark, rows), window=window, kmer=kmer, bits=bits).collect())
    seen, texts = Counter(), [(i, WORD.findall(t or "")) for i, t in rows]
    for _, w in texts:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = []
    for i, w in texts:
        gone = {q for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for q in range(k, k + window)}
        want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    assert got == sorted(want)


def test_paths_are_compacted(spark):
    """Units in line, at a fork, and on a circle; to begin on a path is no branch."""
    lines = {1: "abcdefgh", 2: "abcdefgh", 3: "cdexyz", 4: "cdexyz", 5: "pqrpqr", 6: "m"}
    rows = [(row, 3 * i, 3, ord(c)) for row, line in lines.items() for i, c in enumerate(line)]
    got = {chr(r.unit): (chr(r.path), r.at) for r in substrings.compacted(spark.createDataFrame(rows, "row long, begin int, n int, unit long")).collect()}
    want = {c: (line[0], 3 * i) for line in ("abcde", "fgh", "xyz", "m", "p", "q", "r") for i, c in enumerate(line)}
    assert got == want


# --- 7 -------------------------------------------------------------------------------------------


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Encoder(queries.piece_vocabulary())
    random.seed(10)
    signs = "ab thein \n\t▁▁  éö😀中文梦ﬁ\x00<s></s>0123.,-ENDingtionAZ​　"
    texts = ["".join(random.choices(signs, k=random.randint(0, 50))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["a" * 3000, "▁" * 200, " " * 500, "", "\n"]
    ids = sentencepieces.encoder_of(queries.piece_vocabulary()).encode_all(texts)
    assert ids.to_pylist() == lib.encode(texts, add_eos=True)
    assert mine.decode_all(ids).to_pylist() == lib.decode(ids.to_pylist())
    some = [[random.choice([0, 1, 2, 236, 172, 198, 259, 264, 28705, random.randint(3, 31999)]) for _ in range(random.randint(0, 10))] for _ in range(3000)]
    assert sentencepieces.encoder_of(queries.piece_vocabulary()).decode_all(pa.array(some, pa.list_(pa.int32()))).to_pylist() == lib.decode(some)


# --- 8 -------------------------------------------------------------------------------------------


def test_shards_round_trip(spark, tmp_path):
    import tiktoken  # noqa: F401

    for n in (1, 2, 3, 17, 1000):
        assert sorted(materialize.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    base = spark.read.parquet(f"{SF}/documents.parquet")
    bpe = queries.byte_pairs()
    rows = materialize.materialize(base, bpe, length=64, per_shard=50, folder=str(tmp_path / "s")).collect()
    order = {r.slot: r.sequence for r in rows}
    assert sorted(order) == list(range(len(order))) and sorted(order.values()) == sorted(order)
    made = list(materialize.read_sequences(str(tmp_path / "s"), 0, len(order), 64, 50))
    for r in rows:
        assert hashlib.sha256(made[r.slot].tobytes()).hexdigest() == r.sha256
    flat = np.concatenate([made[s] for s in sorted(order, key=order.get)])
    want = np.concatenate([np.frombuffer(b, "<u2") for b in bpe.encode_all([r.text for r in base.orderBy("doc_id").collect()], "<u2")])
    assert (flat[: len(want)] == want).all() and (flat[len(want) :] == bpe.end_id).all() and len(flat) - len(want) < 64
    assert list(materialize.read_sequences(str(tmp_path / "s"), 77, 2, 64, 50))[1].tolist() == made[78].tolist()
    # the slots don't depend on how the rows come
    again = materialize.materialize(base.repartition(7), bpe, length=64, per_shard=50, folder=str(tmp_path / "t"), rows_each=9).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    assert materialize.materialize(base.limit(0), bpe, folder=str(tmp_path / "e")).count() == 0
    odd = docs(spark, ODD, extra=True).coalesce(1)
    assert sum(r.n_tokens for r in materialize.materialize(odd, bpe, length=64, folder=str(tmp_path / "o")).collect()) > len(ODD)


# --- 9 -------------------------------------------------------------------------------------------


def brute(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_plain_identifiers_as_the_patterns_find_them():
    random.seed(11)
    for signs in ("a.@-b1 ", "0123456789.+- ()a", "19.25@a+"):
        for _ in range(5000):
            t = "".join(random.choices(signs, k=random.randint(0, 40)))
            assert pii.plain(t) == brute(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write to jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("call plus four four two oh seven nine four six zero nine five eight ok", "phone", "plus four four two oh seven nine four six zero nine five eight"),
        ("ip 192 dot 168 dot 0 dot 1 x", "ip", "192 dot 168 dot 0 dot 1"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises(text, kind, found):
    spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b], added) for k, a, b, added in spans] == [(kind, found, True)]
    assert found not in pii.mask(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john@example[.]com now", "email", "john@example[.]com"),
        ("host 192[.]168[.]0[.]1 is down", "ip", "192[.]168[.]0[.]1"),
        ("ring plus 49 170 1234567.", "phone", "plus 49 170 1234567"),
        ("ring plus four nine 170 1234567.", "phone", "plus four nine 170 1234567"),
        ("ring plus one oh zero one zero oh one zero.", "phone", "plus one oh zero one zero oh one zero"),
        ("card 4111 1111 one 111 1111", "card", "4111 1111 one 111 1111"),
        ("ring plus ſeven 170 12345678.", "phone", "plus ſeven 170 12345678"),
    ],
)
def test_disguises_are_found_whatever_else_the_text_holds(text, kind, found):
    spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b], added) for k, a, b, added in spans] == [(kind, found, True)]
    assert [x[0] for x in pii.find(text + " An anecdote.")] == [x[0] for x in spans]


def test_whatever_is_rewritten_passes_the_gate():
    random.seed(13)
    signs = ["[", "]", "(", ".", " ", "-", "at", "dot", "plus", "one", "oh", "two", "ſix", "a", "7", "в", "о", "\u200b", "\n"]
    for _ in range(20000):
        t = "".join(random.choices(signs, k=random.randint(1, 8)))
        assert pii._may_hide(t) or not pii._REWRITE.search(t), t


def test_disguised_rest_of_a_plain_identifier():
    text = "mail john@mail.example [dot] com now"
    spans = pii.find(text)
    assert [(text[a:b], added) for _, a, b, added in spans] == [("john@mail.example", False), ("john@mail.example [dot] com", True)]
    assert pii.mask(text) == "mail <email> now"
    assert [added for *_, added in pii.find("one.two@example.com")] == [False]


def test_clean_texts_have_no_spans():
    prose = (
        "he is at home, one or two dots", "see section 1.2.3 at page 4", "zero one two three", "", None, "Привет мир, всё хорошо",
        "we look at polka dot dresses", "stay at home dot com", "Meet me at noon dot we leave", "They looked at dot matrix printers and dot plots.",
        "A dot at the end; at a dot stop", "one at a time, dot by dot", "the ball at dot net level", "We arrive at seven plus two others",
    )
    for t in prose:
        assert pii.find(t) == [], t
    assert pii.mask("mail x@y.com dot we go") == "mail <email> dot we go"


# --- 10 ------------------------------------------------------------------------------------------


def test_gradients_by_differences():
    r = np.random.default_rng(12)
    net = langid.Network.fresh(["a", "b", "c"], 4, 1)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = r.integers(65, 90, (7, 5)).astype(np.uint8), r.integers(0, 3, 5)
    loss, g = langid._gradients(net.weights, x, y)
    for k in w:
        i = tuple(r.integers(0, s) for s in w[k].shape) if k[0] != "E" else (1, int(x[2, 1]))
        e = 1e-2
        moved = []
        for sign in (1, -1):
            other = {n: v.astype(np.float32) for n, v in w.items()}
            other[k][i] += np.float32(sign * e)
            moved.append(other)
        up, down = moved
        slope = (langid._gradients(up, x, y)[0] - langid._gradients(down, x, y)[0]) / (2 * e)
        assert g[k][i] == pytest.approx(slope, abs=3e-3), k
    assert loss > 0


def test_held_out_accuracy(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.predict(base, langid.fit(base)).join(base.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    right, low, high = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right >= 0.95 and 0 <= low and high <= 1


def test_und(spark):
    base = spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour la", "fr"), (3, "123 !?", "en"), (4, None, "en"), (5, "", None), (6, "½ ² 12 Ⅷ ³", "en"), (7, "é", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(base, langid.fit(base)).collect()}
    assert got[3] == got[4] == got[5] == got[6] == "und" and got[7] != "und"


def test_texts_in_no_known_language_score_low(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(base)
    known = [r.text for r in base.where(langid.held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("text").collect()]
    random.seed(14)

    def shuffled(text):
        letters = random.sample(found := [c for c in text if c.isalpha()], len(found))
        return "".join(letters.pop() if c.isalpha() else c for c in text)

    foreign = [
        "Il consiglio comunale ha approvato ieri sera il nuovo piano per la mobilità urbana e una zona pedonale nel centro storico.",
        "De gemeenteraad heeft gisteravond het nieuwe plan voor het stadsverkeer goedgekeurd, met fietspaden en nieuwe bushaltes.",
        "Kaupunginvaltuusto hyväksyi eilen illalla uuden liikennesuunnitelman, joka sisältää pyöräteitä ja uusia bussipysäkkejä.",
        "Городской совет вчера вечером утвердил новый план движения, который предусматривает велосипедные дорожки.",
        "市議会は昨夜、自転車道、新しいバス停、旧市街の歩行者区域を含む新しい交通計画を承認した。",
        "qwfk zzxjq wpvk jhgfd kjqxz mnbv lkjhg poiu trewq xcvb gfdsa ytrq plmk wsxz edcv rfvb tgbn yhnm",
    ]
    scores = lambda texts: np.array(langid.pooled(net, pa.array(texts))[1])
    assert (scores(foreign) < LEAST_SCORE).all()
    assert (scores([shuffled(t) for t in known if len(t) > 200]) < LEAST_SCORE).mean() >= 0.9
    assert (scores(known) >= LEAST_SCORE).mean() >= 0.98


# --- the pipeline's near copies, and draws by id and text ------------------------------------------


def five_word_sets(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def alike_groups(sets):
    """Groups of rows joined by likeness 0.8 or more, and the pairs themselves."""
    holders, pairs = {}, set()
    for i, s in sets.items():
        for g in s or {()}:
            holders.setdefault(g, []).append(i)
    for members in holders.values():
        pairs.update(itertools.combinations(members, 2))
    pairs = {(a, b) for a, b in pairs if (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in sets}, pairs


@pytest.mark.parametrize("verify_block", [256, 4])  # also with candidate groups cut in blocks
def test_near_copies_against_exact_likeness(spark, verify_block):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    random.seed(8)
    base = rows[3][1].split()
    base = (base * 3)[:300]
    for k in range(60):  # a group of near copies of one text
        words = list(base)
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = f"w{random.randint(0, 99)}"
        rows.append((100_000 + k, " ".join(words)))
    got = {r.row: r.root for r in simhash.near_copies(spark.createDataFrame(rows, "row long, text string"), verify_block=verify_block).collect()}
    group, pairs = alike_groups(five_word_sets(rows))
    found = sum(a in got and got[a] == got.get(b) for a, b in pairs)
    assert found >= 0.95 * len(pairs)
    by_root = {}
    for i, r in got.items():
        by_root.setdefault(r, set()).add(i)
    assert all(len({group[i] for i in members}) == 1 and len(members) > 1 for members in by_root.values())  # nothing else is grouped


def test_without_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d e f g"), (4, "A b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (1, None), (2, ""), (3, " \n"), (9, "other words are here now"), (8, long), (7, f"{long} end"), (None, "quite another text of words")]
    got = simhash.without_near_copies(docs(spark, rows, extra=True)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    assert ids == [(False, 1), (False, 4), (False, 7), (False, 9), (True, 0)]
    assert simhash.without_near_copies(docs(spark, [])).count() == 0


def test_likeness_of_sets():
    a, b = np.array([1, 5, 9], np.uint64), np.array([5, 9, 11, 12], np.uint64)
    assert simhash.likeness(a, b) == 2 / 5 and simhash.likeness(a, a) == 1 and simhash.likeness(a[:0], b) == 0 and simhash.likeness(a[:0], b[:0]) == 1
    assert simhash.plan_anchors(1000)[0] == 0 and simhash.plan_anchors(10**9)[0] > 8


def test_mixing_draws_by_id_and_text(spark):
    """Rows that share an id, or have none, are drawn each for itself."""
    for ident in (None, 7):
        rows = [(ident, f"word number {k} of a text") for k in range(3000)]
        got = mixing.mixed(docs(spark, rows), share=0.5).select("_sampled", "_weight").collect()
        weight = got[0]["_weight"]
        deviation = (weight * (1 - weight) * len(got)) ** 0.5
        assert 0 < weight < 1 and abs(sum(r["_sampled"] for r in got) - weight * len(got)) <= 3 * deviation
    twice = [(3, "the same text")] * 50
    assert len({r["_sampled"] for r in mixing.mixed(docs(spark, twice), share=0.5).collect()}) == 1


def test_language_columns_give_way(spark):
    base = docs(spark, [(1, "one two"), (2, None)]).withColumns({"lang_pred": F.lit("x"), "score": F.lit(9.0)})
    got = langid.with_language(base, langid.Network.fresh([], 4, 1))
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"] and {r.lang_pred for r in got.collect()} == {"und"}
