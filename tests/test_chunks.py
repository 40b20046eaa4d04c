"""Overlap of neighbouring chunks against a plain version."""

import random
import time

from textloom.operators import chunks as ch
from textloom.operators import documents as dc


def plain(a, b, least=32, most=4000):
    if a is None or b is None:
        return 0
    return next((n for n in range(min(len(a), len(b), most), least - 1, -1) if a[-n:] == b[:n]), 0)


def test_overlap_of_odd_texts(spark):
    r = random.Random(3)
    rows = [("a" * 90, "a" * 70), ("ab" * 40, "ba" * 40), ("é𝔘" * 30, "é𝔘" * 20), ("x" * 31, "x" * 31), ("", "a"), (None, "a" * 40), ("a" * 40, None), ("a" * 5000, "a" * 5000)]
    for _ in range(60):
        a = "".join(r.choice("aab") for _ in range(r.randrange(20, 200)))
        rows.append((a, a[-r.randrange(1, len(a)) :] + "".join(r.choice("ab") for _ in range(r.randrange(50)))))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, a string, b string")
    got = {x.k: x.n for x in df.select("k", ch.overlap_chars(df.a, df.b).alias("n")).collect()}
    assert got == {k: plain(*x) for k, x in enumerate(rows)} and min(got.values()) == 0 and max(got.values()) == 4000


def test_overlap_takes_time_by_length(spark):
    """All sizes tried in turn took minutes for this."""
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(4000))
    df = spark.range(2000).selectExpr("id", f"concat('{text[:2000]}', id, '{text[2000:]}') AS a", f"concat('{text[2000:]}', id, '{text[:2000]}') AS b")
    began = time.time()
    assert df.select(ch.overlap_chars(df.a, df.b).alias("n")).where("n <> 2000").count() == 0
    assert time.time() - began < 20


def test_neighbours_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, [str(k) for k in range(450)]), (2, ["a"] * 200), (3, [])], "unit_id int, tokens array<string>")
    made = dc.chunk_neighbours(df, 200, 30)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    got = sorted((x.unit_id, x.chunk_index, x.content.split()[0], x.next.split()[0], x.next.split()[-1]) for x in made.collect())
    assert got == [(1, 0, "0", "170", "369"), (1, 1, "170", "340", "449")]
