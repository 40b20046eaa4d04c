"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from textloom import catalog

SF = "/root/testdata/sf0.001"
NEXT = "/root/testdata/sf0.01"
#: Queries whose plans or roundings only show with more rows.
AT_NEXT = ("agg_mattr", "agg_term_freq", "dup_lexical", "emb_hash", "join_inverted_index", "join_span_overlap", "key_bh", "rel_service", "rt_ann_recall", "rt_context_dedup", "rt_exact_topk", "rt_service_context", "wt_catalog", "qa_near_dups", "gold_snapshot", "join_page_lookup", "ml_select", "rt_dense", "rt_rerank", "sim_jaccard_pairwise", "smp_plan", "win_bh")


def connected(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger_duck():
    return connected(NEXT)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, Decimal)):
        return f"{round(float(v), 4) + 0.0:.4f}".rstrip("0").rstrip(".")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


#: One name for each function: some serve several entries of the catalogue.
NAMES = sorted({f: n for n, f in sorted(catalog.queries().items(), reverse=True) if n in catalog.oracle_sql()}.values())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    compare(spark, duck, name, SF)


@pytest.mark.parametrize("name", AT_NEXT)
def test_same_rows_at_the_next_scale(spark, larger_duck, name):
    compare(spark, larger_duck, name, NEXT)


def compare(spark, duck, name, folder):
    df = catalog.queries()[name](spark, folder)
    got = sorted("|".join(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns) and len(set(names)) == len(names)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
