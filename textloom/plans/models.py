"""Queries on splits, evaluation, learning, clusters, topics, regression and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import factors as fc
from textloom.operators import models as md
from textloom.operators.relations import dfm, token_rel
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import ORACLE, QUERIES, query, table
from textloom.tables import written


def predictions(spark, d) -> DataFrame:
    """Scores of two models from arithmetic on ids, and the truth where it is labelled."""
    x = F.col("doc_id")
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select(
        x.alias("unit_id"), "lang", "source", ((x * 7919 + 13) % 1000 / 1000.0).alias("score"), ((x * 6007 + 101) % 1000 / 1000.0).alias("score_b"), F.col("quality").alias("truth")
    )


def judged(spark, d) -> DataFrame:
    return predictions(spark, d).where("truth IS NOT NULL").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query(" SELECT unit_id, score, truth FROM pred WHERE score BETWEEN 0.4 AND 0.6 ORDER BY abs(score - 0.5), unit_id LIMIT 50", uses="pred")
def pred_browse(spark, d):
    return predictions(spark, d).where("score BETWEEN 0.4 AND 0.6").orderBy(F.abs(F.col("score") - 0.5), "unit_id").limit(50).select("unit_id", "score", "truth")


@query(" SELECT unit_id, round(1 - 2 * abs(score - 0.5), 6)::DOUBLE AS uncertainty FROM pred ORDER BY 1 - 2 * abs(score - 0.5) DESC, unit_id LIMIT 20", uses="pred")
def win_al_queue(spark, d):
    made = predictions(spark, d).select("unit_id", F.round(md.uncertainty(F.col("score")), 6).alias("uncertainty"))
    return made.orderBy(F.desc_nulls_last("uncertainty"), "unit_id").limit(20)


@query(" SELECT unit_id, round(1 - 2 * abs(score - 0.5), 6)::DOUBLE AS uncertainty FROM pred", uses="pred")
def ev_uncertainty(spark, d):
    return predictions(spark, d).select("unit_id", F.round(md.uncertainty(F.col("score")), 6).alias("uncertainty"))


@query(" SELECT unit_id, CASE WHEN greatest(score, 1 - score) < 0.7 THEN 'review' WHEN score >= 0.5 THEN 'yes' ELSE 'no' END AS decision FROM pred", uses="pred")
def ev_abstain(spark, d):
    top = F.greatest(F.col("score"), 1 - F.col("score"))
    return predictions(spark, d).select("unit_id", F.when(top < 0.7, "review").when(F.col("score") >= 0.5, "yes").otherwise("no").alias("decision"))


@query(" SELECT unit_id, (score >= 0.3)::INT AS predicted FROM pred", uses="pred")
def ev_apply_threshold(spark, d):
    return predictions(spark, d).select("unit_id", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(" SELECT truth, (score >= 0.5)::INT AS predicted, count(*) AS n FROM pred WHERE truth IS NOT NULL GROUP BY 1, 2", uses="pred")
def ev_confusion(spark, d):
    return md.confusion(judged(spark, d))


@query(
    """, c AS (SELECT count(*) FILTER (WHERE truth = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE truth = 0 AND score >= 0.5)::DOUBLE AS fp,
      count(*) FILTER (WHERE truth = 1 AND score < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE truth = 0 AND score < 0.5)::DOUBLE AS tn FROM pred WHERE truth IS NOT NULL)
    SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
      round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""",
    uses="pred",
)
def ev_metrics(spark, d):
    return rounded(md.binary_metrics(judged(spark, d)))


@query(
    """, x AS (SELECT truth, score::DOUBLE AS score FROM pred WHERE truth IS NOT NULL), a AS (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x p, x n WHERE p.truth = 1 AND n.truth = 0)
    SELECT round(any_value(auc), 6)::DOUBLE AS roc_auc, round(avg(-(truth * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - truth) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 6) AS log_loss,
      round(avg((score - truth) * (score - truth)), 6) AS brier FROM x, a""",
    uses="pred",
)
def ev_probability(spark, d):
    return rounded(md.probability_metrics(judged(spark, d)))


_BINS = ", b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS c, avg(truth) AS a FROM pred WHERE truth IS NOT NULL GROUP BY 1)"


@query(_BINS + " SELECT bin, n, round(c, 6)::DOUBLE AS mean_confidence, round(a, 6) AS accuracy FROM b", uses="pred")
def ev_calibration(spark, d):
    return rounded(md.calibration(judged(spark, d)))


@query(_BINS + " SELECT round(sum(n * abs(c - a)) / sum(n), 6)::DOUBLE AS ece FROM b", uses="pred")
def win_ece_bins(spark, d):
    return rounded(md.calibration_error(md.calibration(judged(spark, d))))


@query(
    """, t AS (SELECT k / 20 AS threshold FROM (SELECT unnest(range(1, 20)) AS k)), c AS (SELECT threshold, count(*) FILTER (WHERE truth = 1 AND score >= threshold)::DOUBLE AS tp, count(*) FILTER (WHERE truth = 0 AND score >= threshold)::DOUBLE AS fp,
      count(*) FILTER (WHERE truth = 1)::DOUBLE AS pos, count(*) FILTER (WHERE truth = 0)::DOUBLE AS neg FROM pred, t WHERE truth IS NOT NULL GROUP BY 1)
    SELECT round(threshold, 6) AS threshold, round(2 * tp / (tp + fp + pos), 6) AS f1, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / pos, 6) AS recall, round(tp / pos - fp / neg, 6) AS youden FROM c""",
    uses="pred",
)
def ev_threshold(spark, d):
    return rounded(md.threshold_grid(judged(spark, d)))


@query(
    " SELECT lang, count(*) FILTER (WHERE truth = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE truth = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE (truth = 1) <> (score >= 0.5) AND greatest(score, 1 - score) >= 0.75) AS confident FROM pred WHERE truth IS NOT NULL GROUP BY lang",
    uses="pred",
)
def ev_error_report(spark, d):
    wrong = F.col("truth") != F.col("predicted")
    sure = F.greatest(F.col("score"), 1 - F.col("score")) >= 0.75
    return judged(spark, d).groupBy("lang").agg(
        F.count_if(wrong & (F.col("predicted") == 1)).alias("fp"), F.count_if(wrong & (F.col("predicted") == 0)).alias("fn"), F.count_if(wrong & sure).alias("confident")
    )


@query(
    """, l AS (SELECT lang AS label, 'a' AS s FROM pred WHERE unit_id % 2 = 0 UNION ALL SELECT lang, 'b' FROM pred WHERE unit_id % 2 = 1 AND source <> 'src1'),
    c AS (SELECT label, count(*) FILTER (WHERE s = 'a')::DOUBLE AS a, count(*) FILTER (WHERE s = 'b')::DOUBLE AS b FROM l GROUP BY label), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c)
    SELECT round(sum(abs(a / ta - b / tb)) / 2, 8) AS tvd, round(sum((b / tb - a / ta) * ln((b / tb) / (a / ta))), 8) AS psi FROM c, t""",
    uses="pred",
)
def dr_labels(spark, d):
    rows = predictions(spark, d).withColumnRenamed("lang", "label")
    return rounded(md.label_drift(rows.where("unit_id % 2 = 0"), rows.where("unit_id % 2 = 1 AND source <> 'src1'")), 8)


@query(
    """, v AS (SELECT DISTINCT s FROM (SELECT score AS s FROM pred UNION ALL SELECT score_b * score_b FROM pred)), n AS (SELECT count(*)::DOUBLE AS n FROM pred)
    SELECT round(max(abs((SELECT count(*) FROM pred WHERE score <= v.s) / n - (SELECT count(*) FROM pred WHERE score_b * score_b <= v.s) / n)), 6) AS ks, any_value(n)::BIGINT AS n_baseline, any_value(n)::BIGINT AS n_current FROM v, n""",
    uses="pred",
)
def dr_scores(spark, d):
    p = predictions(spark, d)
    return rounded(md.score_drift(p.select("score"), p.select((F.col("score_b").cast("decimal(10,6)") * F.col("score_b").cast("decimal(10,6)")).cast("double").alias("score"))))


_LANG = ", {n} AS (SELECT DISTINCT term FROM tok WHERE lang = '{v}')"


@query(
    _LANG.format(n="x", v="en") + _LANG.format(n="y", v="de") + """, c AS (SELECT coalesce(x.term, y.term) AS term, CASE WHEN x.term IS NULL THEN 'added' WHEN y.term IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM x FULL JOIN y ON x.term = y.term)
    SELECT round(count(*) FILTER (WHERE change = 'kept') / count(*), 8) AS jaccard, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed FROM c""",
    uses="tk tok",
)
def dr_terms(spark, d):
    """The vocabularies of two languages."""
    return rounded(md.term_drift(*_vocabularies(spark, d)), 8)


@query(
    _LANG.format(n="x", v="en") + _LANG.format(n="y", v="de") + """ SELECT coalesce(x.term, y.term) AS term, CASE WHEN x.term IS NULL THEN 'added' WHEN y.term IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM x FULL JOIN y ON x.term = y.term""",
    uses="tk tok",
)
def set_added_removed(spark, d):
    return md.term_changes(*_vocabularies(spark, d))


def _vocabularies(spark, d):
    rel = token_rel(prep(spark, d, "lang"), "lang")
    return [rel.where(F.col("lang") == v).select("term").distinct() for v in ("en", "de")]


@query(
    """, l AS (SELECT lang AS label, unit_id % 2 AS s FROM pred), c AS (SELECT label, count(*) FILTER (WHERE s = 0)::DOUBLE AS a, count(*) FILTER (WHERE s = 1)::DOUBLE AS b FROM l GROUP BY label), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c),
    m AS (SELECT sum(abs(a / ta - b / tb)) / 2 AS tvd, sum((b / tb - a / ta) * ln((b / tb) / (a / ta))) AS psi FROM c, t)
    SELECT round(tvd, 8) AS tvd, round(psi, 8) AS psi, CASE WHEN tvd >= 0.2 OR psi >= 0.25 THEN 'investigate' WHEN tvd >= 0.1 OR psi >= 0.1 THEN 'watch' ELSE 'ok' END AS level FROM m""",
    uses="pred",
)
def dr_level(spark, d):
    rows = predictions(spark, d).withColumnRenamed("lang", "label")
    made = md.label_drift(rows.where("unit_id % 2 = 0"), rows.where("unit_id % 2 = 1"))
    return rounded(made.withColumn("level", md.drift_level({"tvd": (0.1, 0.2), "psi": (0.1, 0.25)})), 8)


@query(" SELECT lang AS label, count(*) AS n FROM pred GROUP BY lang", uses="pred")
def agg_label_counts(spark, d):
    return predictions(spark, d).groupBy(F.coalesce("lang", F.lit("__unlabeled__")).alias("label")).agg(F.count("*").alias("n"))


@query(" SELECT round(corr(score::DOUBLE, score_b::DOUBLE), 8) AS r, count(*) AS n FROM pred", uses="pred")
def agg_pearson(spark, d):
    return rounded(predictions(spark, d).agg(F.corr("score", "score_b").alias("r"), F.count("*").alias("n")), 8)


@query(
    "SELECT n.n_regionkey AS group_key, round(avg(o_totalprice), 4) AS indicator, round(corr(o_totalprice, c_acctbal), 6) AS r, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey GROUP BY 1"
)
def ctx_link(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_regionkey").alias("group_key")).agg(F.round(F.avg("o_totalprice"), 4).alias("indicator"), F.round(F.corr("o_totalprice", "c_acctbal"), 6).alias("r"), F.count("*").alias("n"))


@query(" SELECT lang AS subgroup, round(avg((truth = (score >= 0.5)::INT)::INT), 8) AS agreement, count(*) AS n FROM pred WHERE truth IS NOT NULL GROUP BY lang", uses="pred")
def ms_compare(spark, d):
    return rounded(judged(spark, d).groupBy(F.col("lang").alias("subgroup")).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("agreement"), F.count("*").alias("n")), 8)


@query(" SELECT lang AS category, round(count(*) / (SELECT count(*) FROM pred), 8) AS share FROM pred GROUP BY lang", uses="pred")
def ms_prevalence(spark, d):
    p = predictions(spark, d)
    n = p.agg(F.count("*").alias("n"))
    return rounded(p.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("category", (F.col("c") / F.col("n")).alias("share")), 8)  # one row


@query("""SELECT doc_id, source, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT doc_id, source, (('0x' || left(md5('42:' || source), 8))::BIGINT % 1048576) / 1048576 AS u FROM documents)""")
def split_group_holdout(spark, d):
    """Sources never straddle a split; tested for leaks."""
    return md.grouped_split(docs(spark, d).select("doc_id", "source"), "source")


@query("""SELECT doc_id, source, CASE WHEN r <= ceil(0.25 * n) THEN 'test' ELSE 'train' END AS split, n AS n_groups, ceil(0.25 * n)::BIGINT AS n_test_groups FROM documents JOIN
    (SELECT source, row_number() OVER (ORDER BY ('0x' || left(md5('42:' || source), 8))::BIGINT, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) USING (source)""")
def split_group_simple(spark, d):
    """A quarter of the sources, rounded up, is the test part."""
    return md.simple_group_split(docs(spark, d).select("doc_id", "source"), "source", 0.25)


@query("SELECT d.doc_id, d.source, f.fold, CASE WHEN d.source = f.fold THEN 'test' ELSE 'train' END AS split FROM documents d, (SELECT DISTINCT source AS fold FROM documents) f")
def split_logo(spark, d):
    return md.leave_one_out(docs(spark, d).select("doc_id", "source"), "source")


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM documents WHERE lang IN ('en', 'de')")
def split_transfer(spark, d):
    return md.transfer_split(docs(spark, d).select("doc_id", "lang"), "lang", ["en"], ["de"])


_ORD = "o AS (SELECT o_orderkey, year(o_orderdate) AS period FROM orders)"


def _periods(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("period"))


@query(f"""WITH {_ORD}, p AS (SELECT period, row_number() OVER (ORDER BY period) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM o)), c AS (SELECT period AS cutoff FROM p WHERE r = greatest(n // 2, 1))
    SELECT o_orderkey, period, cutoff, CASE WHEN period <= cutoff THEN 'train' ELSE 'test' END AS split FROM o, c""")
def split_temporal(spark, d):
    return md.temporal_split(_periods(spark, d), "period")


for _name, _width in (("split_expanding", None), ("split_rolling", 2)):

    def _windows(spark, d, width=_width):
        return md.window_splits(_periods(spark, d), "period", width)

    query(
        f"""WITH {_ORD}, p AS (SELECT period, row_number() OVER (ORDER BY period) AS r FROM (SELECT DISTINCT period FROM o))
        SELECT o_orderkey, period, f.r::INT AS fold, CASE WHEN p.r = f.r THEN 'test' ELSE 'train' END AS split FROM o JOIN p USING (period) JOIN p f ON f.r >= 3 AND p.r <= f.r {'' if _width is None else f'AND p.r >= f.r - {_width}'} SEMI JOIN o x ON true""".replace(" JOIN p f ON", " JOIN (SELECT r FROM p) f ON").replace(" SEMI JOIN o x ON true", ""),
        name=_name,
    )(_windows)


@query("SELECT lang AS label, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 8) AS weight FROM documents GROUP BY lang")
def ml_sample_weight(spark, d):
    rows = md.balanced_weights(docs(spark, d).select(F.col("lang").alias("label")))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("weight")), 8)


@query("SELECT CASE WHEN count(DISTINCT lang) = 2 THEN 'binary' ELSE 'multiclass' END AS task_type, count(DISTINCT lang) AS n_classes FROM documents")
def ml_task_type(spark, d):
    made = docs(spark, d).agg(F.countDistinct("lang").alias("n_classes"))
    return made.select(F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass").alias("task_type"), "n_classes")


def _labelled(spark, d, label="quality"):
    rows = prep(spark, d, "source").join(table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), F.col(label).cast("double").alias("label")), "unit_id")
    return md.grouped_split(rows, "source")


for _name, _learner in {"ml_logreg": "logistic_regression", "ml_svm": "linear_svm", "ml_mnb": "multinomial_nb", "ml_cnb": "complement_nb", "ml_sgd": "sgd_log"}.items():

    def _learned(spark, d, learner=_learner):
        rows = _labelled(spark, d)
        made = md.scored(md.fit(rows, learner), rows.where("split = 'test'"))
        return md.binary_metrics(made, "label", "predicted")

    query(name=_name)(_learned)


@query()
def ml_fit_eval(spark, d):
    rows = _labelled(spark, d)
    made = md.scored(md.fit(rows), rows.where("split <> 'train'"))
    return made.select("unit_id", "split", "label", "predicted", "confidence", "uncertainty")


@query()
def clu_kmeans(spark, d):
    return md.clustered(prep(spark, d), 5).select("unit_id", "cluster")


@query()
def clu_sizes(spark, d):
    return md.clustered(prep(spark, d), 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def clu_terms(spark, d):
    p = prep(spark, d)
    return md.cluster_terms(token_rel(p), md.clustered(p, 5).select("unit_id", "cluster"))


@query(
    """, c AS (SELECT lang AS cluster, term, count(*) AS tf FROM tok GROUP BY ALL), k AS (SELECT count(DISTINCT lang)::DOUBLE AS k FROM documents), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    w AS (SELECT cluster, term, tf * (ln((k + 1) / (df + 1)) + 1) AS weight FROM c JOIN df USING (term), k), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM w)
    SELECT cluster, term, round(weight, 6) AS weight, rank FROM r WHERE rank <= 10""",
    uses="tk tok",
)
def top_ctfidf(spark, d):
    p = prep(spark, d, "lang")
    return rounded(md.cluster_terms(token_rel(p), p.select("unit_id", F.col("lang").alias("cluster"))))


@query()
def top_lda(spark, d):
    return md.topics(prep(spark, d), 4, 8)[0]


@query()
def top_transform(spark, d):
    return md.topics(prep(spark, d), 4, 8)[1]


_TSQL = f"tp AS (SELECT cluster AS topic, term FROM ({ORACLE['top_ctfidf']}))"


def _topic_terms(spark, d):
    """The terms that stand out in each language, as topics."""
    return written(QUERIES["top_ctfidf"](spark, d).select(F.col("cluster").alias("topic"), "term"), "topics")


@query(
    f""", {_TSQL}, h AS (SELECT DISTINCT doc_id, term FROM tok WHERE term IN (SELECT term FROM tp)), n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT a.term AS x, b.term AS y, count(*) AS c FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2),
    p AS (SELECT l.topic, CASE WHEN c IS NULL THEN -1.0 ELSE ln(c * n / (dx.df * dy.df)) / -ln(c / n) END AS v FROM tp l JOIN tp r ON l.topic = r.topic AND l.term < r.term JOIN df dx ON dx.term = l.term JOIN df dy ON dy.term = r.term LEFT JOIN b ON b.x = l.term AND b.y = r.term, n)
    SELECT topic, round(avg(v), 6) AS coherence FROM p GROUP BY topic""",
    uses="tk tok",
)
def top_npmi(spark, d):
    p = prep(spark, d)
    return rounded(md.npmi_coherence(dfm(token_rel(p)), _topic_terms(spark, d), p.count()))


@query(f"WITH {_TSQL} SELECT round(count(DISTINCT term) / count(*), 8) AS diversity FROM tp")
def top_diversity(spark, d):
    return rounded(md.topic_diversity(_topic_terms(spark, d)), 8)


@query("SELECT lang AS topic, source AS value, count(*) AS n FROM documents GROUP BY ALL")
def top_breakdown(spark, d):
    return docs(spark, d).groupBy(F.col("lang").alias("topic"), F.col("source").alias("value")).agg(F.count("*").alias("n"))


@query()
def dim_pca(spark, d):
    return fc.principal(prep(spark, d), 2)


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
    SELECT 'l_quantity' AS term, round(b, 2) AS coefficient, round(r2, 5) AS r2 FROM f UNION ALL SELECT 'intercept', round(a, 2), round(r2, 5) FROM f""")
def st_ols(spark, d):
    made = md.ols(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", ["l_quantity"])
    return made.select("term", F.round("coefficient", 2).alias("coefficient"), F.round("r2", 5).alias("r2"))


@query()
def st_logit(spark, d):
    rows = table(spark, d, "labels").join(docs(spark, d).select("doc_id", (F.col("n_chars") / 1000).alias("k")), "doc_id")
    return md.logit(rows.withColumn("quality", F.col("quality").cast("double")), "quality", ["k"])


