"""Queries on agreement, gold labels, sampling, joins of label layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import reliability as rl
from textloom.operators import retrieval as rt
from textloom.plans.frequency import docs, rounded
from textloom.plans.registry import query, table


def annotations(spark, d) -> DataFrame:
    """Three coders' labels, derived from the labels table by arithmetic on ids."""
    coder = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("coder_id")
    flip = (F.col("doc_id") * 31 + F.col("coder_id") * 17) % 10 < 2
    return (
        table(spark, d, "labels").select("doc_id", "quality", coder).where((F.col("doc_id") + F.col("coder_id")) % 7 != 0)
        .select(F.col("doc_id").alias("unit_id"), "coder_id", F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("value"))
    )


def two_coders(spark, d) -> DataFrame:
    return rl.coder_pairs(annotations(spark, d)).where("coder_a = 0 AND coder_b = 1")


_P = ", p AS (SELECT a.unit_id, a.value AS a, b.value AS b FROM ann a JOIN ann b USING (unit_id) WHERE a.coder_id = 0 AND b.coder_id = 1)"


@query(_P + " SELECT round(avg((a = b)::INT), 8) AS agreement, count(*) AS n FROM p", uses="ann")
def rel_raw(spark, d):
    return rounded(rl.raw_agreement(two_coders(spark, d)), 8)


@query(
    _P + """, o AS (SELECT avg((a = b)::INT) AS po, count(*) AS n FROM p),
    e AS (SELECT sum(x.c * y.c) AS s FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY a) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY b) y USING (v))
    SELECT round(po, 8) AS observed, round(s / (n * n), 8) AS expected, round((po - s / (n * n)) / (1 - s / (n * n)), 8) AS kappa, n FROM o, e""",
    uses="ann",
)
def rel_cohen(spark, d):
    return rounded(rl.cohen_kappa(two_coders(spark, d)), 8)


_U = ", c AS (SELECT unit_id, value, count(*) AS c, sum(count(*)) OVER (PARTITION BY unit_id) AS m FROM ann GROUP BY unit_id, value)"


@query(
    _U + """, q AS (SELECT * FROM c WHERE m >= 2), t AS (SELECT value, sum(c) AS n FROM q GROUP BY value), o AS (SELECT sum(c * (m - c) / (m - 1)) AS o FROM q)
    SELECT round(1 - ((SELECT sum(n) FROM t) - 1) * (SELECT o FROM o) / ((SELECT sum(n) FROM t) * (SELECT sum(n) FROM t) - (SELECT sum(n * n) FROM t)), 8) AS alpha, (SELECT sum(n) FROM t)::BIGINT AS n_values""",
    uses="ann",
)
def rel_alpha(spark, d):
    return rounded(rl.krippendorff_alpha(annotations(spark, d)), 8)


@query(
    _U + """, q AS (SELECT * FROM c WHERE m = 3), pi AS (SELECT unit_id, (sum(c * c) - 3) / 6 AS p FROM q GROUP BY unit_id), n AS (SELECT count(*) AS n FROM pi),
    pj AS (SELECT value, sum(c) / (3 * any_value(n)) AS p FROM q, n GROUP BY value), e AS (SELECT sum(p * p) AS e FROM pj)
    SELECT round((avg(p) - any_value(e)) / (1 - any_value(e)), 8) AS kappa, 3::BIGINT AS n_raters, count(*) AS n_units FROM pi, e""",
    uses="ann",
)
def rel_fleiss(spark, d):
    return rounded(rl.fleiss_kappa(annotations(spark, d)), 8)


@query(
    """ SELECT a.coder_id AS coder_a, b.coder_id AS coder_b, round(avg((a.value = b.value)::INT), 8) AS agreement, count(*) AS n_common
    FROM ann a JOIN ann b ON a.unit_id = b.unit_id AND a.coder_id < b.coder_id GROUP BY 1, 2""",
    uses="ann",
)
def rel_pair_matrix(spark, d):
    return rounded(rl.pair_matrix(annotations(spark, d)), 8)


@query(
    """ SELECT a.coder_id AS coder_a, b.coder_id AS coder_b, a.unit_id, a.value AS a, b.value AS b FROM ann a JOIN ann b ON a.unit_id = b.unit_id AND a.coder_id < b.coder_id""",
    uses="ann",
)
def join_pair_overlap(spark, d):
    return rl.coder_pairs(annotations(spark, d)).select("coder_a", "coder_b", "unit_id", "a", "b")


@query(
    """WITH l AS (SELECT doc_id, 'quality' AS label, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
    a AS (SELECT doc_id, label, c AS coder_id, CASE WHEN (doc_id * 31 + c * 17) % 10 < 2 THEN 1 - v ELSE v END AS value FROM l, (SELECT unnest([0, 1]) AS c) WHERE (doc_id + c) % 7 <> 0)
    SELECT x.label, round(avg((x.value = y.value)::INT), 8) AS agreement, count(*) AS n FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.label = y.label AND x.coder_id = 0 AND y.coder_id = 1 GROUP BY 1"""
)
def rel_by_label(spark, d):
    long = table(spark, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "v"))
    value = lambda c: F.when((F.col("doc_id") * 31 + c * 17) % 10 < 2, 1 - F.col("v")).otherwise(F.col("v"))
    both = long.where((F.col("doc_id") % 7 != 0) & ((F.col("doc_id") + 1) % 7 != 0)).select("label", value(0).alias("a"), value(1).alias("b"))
    return rounded(both.groupBy("label").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), F.count("*").alias("n")), 8)


@query(" SELECT unit_id, count(DISTINCT value) AS n_values, count(DISTINCT coder_id) AS n_coders FROM ann GROUP BY 1 HAVING count(DISTINCT value) > 1 AND count(DISTINCT coder_id) >= 2", uses="ann")
def rel_disagree(spark, d):
    return rl.disagreements(annotations(spark, d))


@query(" SELECT unit_id, count(DISTINCT value) AS n_values, count(DISTINCT coder_id) AS n_coders FROM ann GROUP BY 1 HAVING count(DISTINCT value) > 1 AND count(DISTINCT coder_id) >= 2", uses="ann")
def adj_disagreements(spark, d):
    return rl.disagreements(annotations(spark, d))


@query()
def rel_bootstrap(spark, d):
    """Intervals of kappa, alpha and Fleiss' kappa from 2,000 resamples of units."""
    return rl.bootstrap_coefficients(annotations(spark, d))


@query(" SELECT count(DISTINCT coder_id) AS n_coders, count(DISTINCT unit_id) AS n_units, (SELECT count(*) FROM (SELECT unit_id FROM ann GROUP BY unit_id HAVING count(value) >= 2)) AS pairable_units, count(DISTINCT coder_id) * count(DISTINCT unit_id) - count(value) AS missing_values FROM ann", uses="ann")
def rel_meta(spark, d):
    return rl.metadata(annotations(spark, d))


_M = """, b AS (SELECT unit_id, value, count(*) AS c, min(coder_id) AS f FROM ann GROUP BY 1, 2),
  r AS (SELECT *, sum(c) OVER (PARTITION BY unit_id) AS m, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, f) AS k FROM b)"""


@query(_M + " SELECT unit_id, value, round(c / m, 8) AS share FROM r WHERE k = 1", uses="ann")
def win_majority(spark, d):
    return rounded(rl.majority(annotations(spark, d)), 8)


@query(_M + " SELECT unit_id, value, round(c / m, 8) AS share FROM r WHERE k = 1 AND c / m >= 0.75", uses="ann")
def gold_majority(spark, d):
    return rounded(rl.majority(annotations(spark, d), 0.75), 8)


def _decisions(spark, d):
    split = rl.disagreements(annotations(spark, d)).where("unit_id % 2 = 0")
    return split.select("unit_id", (F.col("unit_id") % 4 / 2).cast("int").alias("final_value"))


@query(
    """, k AS (SELECT unit_id, count(DISTINCT value) AS k, count(DISTINCT coder_id) AS n, min(value) AS v FROM ann GROUP BY 1),
    s AS (SELECT unit_id, ((unit_id % 4) // 2)::INT AS final_value FROM k WHERE k > 1 AND n >= 2 AND unit_id % 2 = 0)
    SELECT unit_id, coalesce(final_value, v) AS value, CASE WHEN final_value IS NULL THEN 'unanimous' ELSE 'adjudicated' END AS origin
    FROM k LEFT JOIN s USING (unit_id) WHERE final_value IS NOT NULL OR k = 1""",
    uses="ann",
)
def gold_adjudicated(spark, d):
    return rl.adjudicated(annotations(spark, d), _decisions(spark, d))


@query(" SELECT unit_id, value FROM ann WHERE coder_id = 1", uses="ann")
def gold_selected(spark, d):
    return annotations(spark, d).where("coder_id = 1").select("unit_id", "value")


@query(
    _M + """, bd AS (SELECT unit_id // 1000 AS k, count(*) AS n, sha256(string_agg(unit_id || ':' || value, ',' ORDER BY unit_id)) AS h FROM r WHERE k = 1 GROUP BY unit_id // 1000)
    SELECT sum(n)::BIGINT AS n_units, sha256(string_agg(h, ',' ORDER BY k)) AS checksum FROM bd""", uses="ann"
)
def gold_snapshot(spark, d):
    """Checksum of the frozen labels, from checksums of runs of them."""
    gold = rl.majority(annotations(spark, d)).withColumn("all", F.lit(0))
    line = F.concat_ws(":", F.col("unit_id").cast("string"), F.col("value").cast("string"))
    return gold.agg(F.count("*").alias("n_units")).crossJoin(rt.digests(gold, "all", "unit_id", line, "checksum").select("checksum"))  # one row each


@query(
    """SELECT coalesce(nullif(source, ''), 'unspecified') AS group_key, count(*) AS n, sum(quality)::BIGINT AS n_yes, round(avg(quality), 8) AS prevalence
    FROM labels JOIN documents USING (doc_id) GROUP BY 1"""
)
def agg_prevalence(spark, d):
    both = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "source"), "doc_id").withColumnRenamed("quality", "value")
    return rounded(rl.prevalence(both, "source"), 8)


@query("SELECT 'quality' AS label, quality AS value, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY 2")
def agg_class_dist(spark, d):
    long = table(spark, d, "labels").select(F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "value"))
    return long.groupBy("label", "value").agg(F.count("*").alias("n"))


@query(" SELECT coder_id, value, count(*) AS n, count(DISTINCT unit_id) AS n_units FROM ann GROUP BY 1, 2", uses="ann")
def agg_annotation_progress(spark, d):
    return annotations(spark, d).groupBy("coder_id", "value").agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("n_units"))


@query(
    _M + """ SELECT d.doc_id AS unit_id, coalesce(r.value, (d.doc_id * 7919 % 2)::INT) AS value, CASE WHEN r.unit_id IS NULL THEN 'model' ELSE 'human' END AS provenance
    FROM documents d LEFT JOIN r ON r.unit_id = d.doc_id AND r.k = 1""",
    uses="ann",
)
def join_label_layers(spark, d):
    units = docs(spark, d).select(F.col("doc_id").alias("unit_id"))
    model = units.select("unit_id", (F.col("unit_id") * 7919 % 2).cast("int").alias("value"))
    return rl.label_layers(units, rl.majority(annotations(spark, d)), model)


@query("SELECT DISTINCT unit_id FROM ann", uses="ann")
def project_unit_ids(spark, d):
    return annotations(spark, d).select("unit_id").distinct()


@query(" SELECT doc_id AS unit_id FROM documents WHERE doc_id NOT IN (SELECT unit_id FROM ann)", uses="ann")
def set_minus_annotated(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id")).join(annotations(spark, d), "unit_id", "left_anti")


@query(" SELECT unit_id FROM ann GROUP BY 1 HAVING count(DISTINCT coder_id) = 3", uses="ann")
def set_intersect_labels(spark, d):
    return annotations(spark, d).groupBy("unit_id").agg(F.countDistinct("coder_id").alias("n")).where("n = 3").select("unit_id")


@query(
    """, l AS (SELECT count(*) FILTER (WHERE c < 3) AS x FROM (SELECT unit_id, count(*) AS c FROM ann GROUP BY 1))
    SELECT count(DISTINCT unit_id) AS n_units, count(*) AS n_values, count(DISTINCT coder_id) AS n_coders, round(1 - count(*) / (count(DISTINCT unit_id) * 3), 8) AS missingness, any_value(l.x) AS n_partial FROM ann, l""",
    uses="ann",
)
def rel_diagnostics(spark, d):
    by = annotations(spark, d).groupBy("unit_id").agg(F.count("*").alias("c"))
    ann = annotations(spark, d).agg(F.countDistinct("unit_id").alias("n_units"), F.count("*").alias("n_values"), F.countDistinct("coder_id").alias("n_coders"))
    made = ann.withColumn("missingness", F.round(1 - F.col("n_values") / (F.col("n_units") * 3), 8))
    return made.crossJoin(by.agg(F.count_if(F.col("c") < 3).alias("n_partial")))  # one row each


@query(
    """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT sum(size) AS t FROM s), q AS (SELECT source, size, 200 * size / t AS exact, floor(200 * size / t) AS low FROM s, t),
    r AS (SELECT *, row_number() OVER (ORDER BY exact - low DESC, source) AS k, 200 - sum(low) OVER () AS spare FROM q)
    SELECT source, size, least(size, low + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM r"""
)
def smp_allocate(spark, d):
    """200 units dealt to the sources in proportion, the largest remainders first."""
    sizes = docs(spark, d).groupBy("source").agg(F.count("*").alias("size"))
    dealt = rl.allocate({r["source"]: r["size"] for r in sizes.collect()}, 200, "proportional")  # one number a source
    return sizes.select("source", "size", F.element_at(F.create_map(*[F.lit(x) for k, v in dealt.items() for x in (k, v)]), F.col("source")).cast("long").alias("allocated"))


_SAMPLE = """s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT sum(size) AS t FROM s), q AS (SELECT source, size, {n} * size / t AS exact, floor({n} * size / t) AS low FROM s, t),
    al AS (SELECT source, least(size, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, source) <= {n} - sum(low) OVER () THEN 1 ELSE 0 END) AS many FROM q),
    p AS (SELECT doc_id, source, ('0x' || left(md5('42:' || doc_id), 8))::BIGINT AS h FROM documents),
    sm AS (SELECT doc_id, p.source, h FROM p JOIN al USING (source) QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY h, doc_id) <= any_value(many) OVER (PARTITION BY p.source))"""


@query("WITH " + _SAMPLE.format(n=100) + " SELECT doc_id AS unit_id, doc_id, source FROM sm")
def smp_plan(spark, d):
    units = docs(spark, d).select(F.col("doc_id").alias("unit_id"), "doc_id", "source")
    return rl.stratified_sample(units, "source", 100)


@query("WITH " + _SAMPLE.format(n=60) + """, k AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS k FROM sm)
    SELECT doc_id AS unit_id, unnest(CASE WHEN k < 15 THEN ['ann', 'bea', 'cem'] ELSE [['ann', 'bea', 'cem'][k % 3 + 1]] END) AS annotator FROM k""")
def asg_plan(spark, d):
    units = docs(spark, d).select(F.col("doc_id").alias("unit_id"), "doc_id", "source")
    return rl.assignment(rl.stratified_sample(units, "source", 60), ["ann", "bea", "cem"], "overlap", 15)


@query("SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def win_count_subquery(spark, d):
    return table(spark, d, "labels").where("toxic = 1").join(docs(spark, d).select("doc_id"), "doc_id").agg(F.count("*").alias("n"))
