"""A matrix in blocks: its products are those of the whole, and its entries are dealt once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import factors as fc


def test_products_of_blocks_do_not_move_entries(spark):
    random.seed(3)
    rows = [(i, random.choices("abcdefghij", k=random.randint(0, 9))) for i in range(60)] + [(60, None), (61, ["only", None, "only"])]
    df = spark.createDataFrame(rows, "unit_id int, tokens array<string>")
    m = fc.matrix_of(df, each=40)
    assert m.blocks > 4 and m.units.count() == 62
    terms = {r.id: r for r in m.terms.collect()}
    want = {(r.unit_id, r.term): r.weight for r in fc.weights_of(df).collect()}
    factor = {i: float(n + 1) for n, i in enumerate(sorted(terms))}
    z = spark.createDataFrame([(i, [f]) for i, f in factor.items()], "id bigint, f array<double>")
    of = {t.term: factor[i] for i, t in terms.items()}
    y = {u: sum(w * of[t] for (v, t), w in want.items() if v == u) for u in range(62)}
    assert {r.unit_id: r.f[0] for r in fc._over(m, z, 1, [0.0]).collect()} == pytest.approx(y)
    back = fc._and_back(m, z, 1, [0.5], True)
    got = {r.id: r.f for r in back.collect()}
    assert got.pop(-1)[0] == pytest.approx(sum(y.values()) - 31)
    for i, t in terms.items():
        assert got[i] == pytest.approx([sum(w * (y[u] - 0.5) for (u, x), w in want.items() if x == t.term), sum(w for (_, x), w in want.items() if x == t.term)])
    plan = back._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    blocks = [x for x in plan.split("\n") if "Exchange hashpartitioning(block" in x]
    assert len(blocks) == 1  # the rows of the factor; the units stay where they are


def test_no_units(spark):
    df = spark.createDataFrame([(1, [])], "unit_id int, tokens array<string>")
    assert len(fc.singular(fc.matrix_of(df), 2).values) == 0 and fc.nmf(df, 2, 2)[0].count() == 0
    assert np.isclose(fc.matrix_of(df).units.select(F.sum(F.size("ids"))).first()[0], 0)
