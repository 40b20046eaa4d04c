"""Topic engines, reducers and feature pipelines by name, on planted groups; and the replication script."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import engines as eg
from textloom.operators import models as md
from textloom.sources import files

GROUPS = [["ant", "bee", "fly", "gnat"], ["oak", "elm", "ash", "fir"]]


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(12)
    made = [(i, random.choices(GROUPS[i % 2], k=15)) for i in range(40)]
    return spark.createDataFrame(made, "unit_id int, tokens array<string>").cache()


@pytest.mark.parametrize("name", sorted(eg.ENGINES))
def test_engines_tell_planted_groups_apart(spark, rows, name):
    made = eg.fitted(name, rows, 2, iterations=10)
    more = spark.createDataFrame([(100, ["ant", "bee", "new"]), (101, ["elm", "fir", "oak"]), (102, ["bee", "fly"])], "unit_id int, tokens array<string>")
    top = {r.unit_id: max(range(2), key=lambda i: r.shares[i]) for r in made.transform(more).collect()}
    assert top[100] == top[102] != top[101]
    assert all(sum(r.shares) == pytest.approx(1) for r in made.transform(rows).collect())
    assert made.terms.groupBy("topic").count().count() == 2
    with pytest.raises(ValueError):
        eg.fitted("none", rows, 2)


@pytest.mark.parametrize("name", sorted(eg.REDUCERS))
def test_stages_cluster_planted_groups(rows, name):
    got = {r.unit_id: r.cluster for r in eg.staged(rows, name, 2, 2).collect()}
    assert len(got) == 40 and len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    with pytest.raises(ValueError):
        eg.staged(rows, "none", 2, 2)


def test_features_and_selection_are_one_object(rows):
    labelled = rows.withColumn("label", (F.col("unit_id") % 2).cast("double"))
    made = md.feature_pipeline(top=3).fit(labelled).transform(labelled)
    assert made.first()["selected"].size == 3
    assert "selected" not in md.feature_pipeline().fit(labelled).transform(labelled).columns


def test_grouped_split_of_a_stated_size(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(70)], "id int, g string")
    got = md.simple_group_split(df, "g", 0.25).collect()
    by = {r.g: r.split for r in got}
    assert len(got) == 70 and list(by.values()).count("test") == 2 and all(by[r.g] == r.split for r in got)
    with pytest.raises(ValueError):
        md.simple_group_split(df.where("g = 'g1'"), "g")


def test_replication_script(spark):
    lines = [r.text for r in files.replication_script(spark.range(7), "u.csv", ["a"]).orderBy("line").collect()]
    assert "stopifnot(nrow(units) == 7)" in lines and any("u.csv" in x for x in lines) and any('docvars(texts, "a")' in x for x in lines)
