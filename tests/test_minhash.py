"""MinHash of many texts at once against exact arithmetic."""

import hashlib
import random
import time

import pandas as pd

from textloom.operators import similarity as sm

P = (1 << 61) - 1


def test_permutations_are_exact_at_the_ends():
    import numpy as np

    r = random.Random(5)
    x = [0, 1, (1 << 32) - 1, 1 << 31, *(r.randrange(1 << 32) for _ in range(500))]
    for a, b in [(1, 0), (P - 1, P - 1), (P - 1, 0), (1, P - 1), (1 << 60, 7), ((1 << 30) - 1, 3), (1 << 30, P - 1), *((r.randrange(1, P), r.randrange(P)) for _ in range(50))]:
        assert sm._permuted(a, b, np.array(x, np.uint64)).tolist() == [(a * v + b) % P & 0xFFFFFFFF for v in x]


def test_texts_of_a_batch_keep_apart_and_take_little_time():
    r = random.Random(6)
    texts = [" ".join(str(r.randrange(99)) for _ in range(r.choice((0, 1, 2, 3, 40)))) for _ in range(3000)] + [None, " ".join(str(k) for k in range(20_000)), "", "one"]
    made = sm.minhash(64, most=1000).func
    made(pd.Series(texts[:10]))
    began = time.process_time()
    got = made(pd.Series(texts))
    assert time.process_time() - began < 3  # each text by itself took 10 and more
    a, b = sm._coefficients(64, 1)
    for k in [*range(0, 3000, 100), 3000, 3002, 3003]:
        w = (texts[k] or "").split()
        grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
        x = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
        assert list(got[k]) == [min(((p * v + q) % P & 0xFFFFFFFF for v in x), default=0xFFFFFFFF) for p, q in zip(a, b)]
    assert len(got) == len(texts) and sm.minhash().func(pd.Series([], dtype=object)).tolist() == []


def test_links_hold_units_of_one_signature_and_all_pairs_at_the_threshold(spark):
    r = random.Random(7)
    one = [r.randrange(1 << 32) for _ in range(64)]
    other = [x + 1 if k % 5 == 0 and k < 60 else x for k, x in enumerate(one)]  # 12 places apart, in twelve bands
    low = [x + 1 if k < 32 else x for k, x in enumerate(one)]
    df = spark.createDataFrame([(1, one), (2, one), (3, other), (4, other), (5, [1] * 64), (6, low)], "unit_id long, signature array<long>")
    got = lambda t: sorted((x.i, x.j, x.score) for x in sm.estimated_links(df, t).collect())
    assert got(0.8) == [(1, 2, 1.0), (1, 3, 52 / 64), (3, 4, 1.0)]
    assert (1, 6, 0.5) in got(0.5)
