"""Similarity joins: units that only share a common term are not rows of a shuffle."""

from textloom.operators import similarity as sm


def _records(spark):
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_jaccard_pairs_that_share_one_term_are_not_shuffled(spark):
    rows = [(i, t, 1) for i in range(800) for t in ("all", f"t{i // 2}")]
    before = _records(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    got = {(r.i, r.j): r.score for r in sm.jaccard_pairs(spark.createDataFrame(rows, "unit_id int, term string, count int"), 0.4).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i, i + 1): 1.0 for i in range(0, 800, 2)}
    assert _records(spark) - before < 20 * len(rows)
