"""Splits, features, classifiers, evaluation, clusters, topics, regression and drift."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, Normalizer, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.relations import drawn, ratio, running
from textloom.tables import written

# --- splits ----------------------------------------------------------------------------------


def grouped_split(rows: DataFrame, group: str, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: whole groups go to test, validation or train by a seeded hash, so nothing leaks."""
    u = drawn(seed, F.coalesce(F.col(group).cast("string"), F.lit(""))) % (1 << 20) / (1 << 20)
    return rows.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def simple_group_split(rows: DataFrame, group: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """``rows`` with split (train or test), n_groups and n_test_groups: the stated part of all groups, rounded up, is tested on.

    Groups are taken in order of a hash. No group is in both parts; with fewer than two groups it's an error.
    """
    groups = written(rows.select(group).distinct(), "groups")
    n = groups.count()
    if n < 2:
        raise ValueError("a grouped split needs two groups at least")
    tested = math.ceil(test_size * n)
    placed = running(groups, (drawn(seed, F.col(group)), F.col(group)), {"_place": F.lit(1)})
    part = placed.select(group, F.when(F.col("_place") <= tested, "test").otherwise("train").alias("split"))
    return rows.join(part, group).select(*rows.columns, "split", F.lit(n).cast("long").alias("n_groups"), F.lit(tested).cast("long").alias("n_test_groups"))


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """(group, fold, split): every row once for each group, which is that fold's test set."""
    folds = rows.select(F.col(group).alias("fold")).distinct()
    return rows.crossJoin(F.broadcast(folds)).withColumn("split", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))  # one row a group


def transfer_split(rows: DataFrame, field: str, train: Sequence, test: Sequence) -> DataFrame:
    """Rows of the train and test values of a field; the two lists must not share a value."""
    if set(train) & set(test):
        raise ValueError("train and test values overlap")
    return rows.withColumn("split", F.when(F.col(field).isin(*train), "train").when(F.col(field).isin(*test), "test")).where("split IS NOT NULL")


def temporal_split(rows: DataFrame, period: str) -> DataFrame:
    """Train up to the lower median of the distinct periods, test after it."""
    distinct = rows.select(period).distinct()
    order = Window.orderBy(period)  # one row a period
    ranked = distinct.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    cutoff = ranked.where(F.col("r") == F.greatest(F.floor(F.col("n") / 2), F.lit(1))).select(F.col(period).alias("cutoff"))
    return rows.crossJoin(F.broadcast(cutoff)).withColumn("split", F.when(F.col(period) <= F.col("cutoff"), "train").otherwise("test"))


def window_splits(rows: DataFrame, period: str, width: int | None = None, least: int = 3) -> DataFrame:
    """(…, fold, split): each later period tested on all earlier ones, or on the last ``width``."""
    ranked = rows.select(period).distinct().withColumn("r", F.row_number().over(Window.orderBy(period)))  # one row a period
    tests = ranked.where(F.col("r") >= least).select(F.col("r").alias("fold"))
    joined = rows.join(F.broadcast(ranked), period).crossJoin(F.broadcast(tests))
    used = (F.col("r") == F.col("fold")) | (F.col("r") < F.col("fold"))
    if width is not None:
        used &= F.col("r") >= F.col("fold") - width
    return joined.where(used).withColumn("split", F.when(F.col("r") == F.col("fold"), "test").otherwise("train")).drop("r")


# --- features and classifiers ----------------------------------------------------------------


def feature_stages(ngrams: Sequence[int] = (1,), min_df: float = 1.0, size: int = 1 << 18, hashed: bool = False) -> list:
    """From a tokens column to a features column: counts or hashes, inverse frequencies, unit length.

    ``size`` bounds what the driver holds of a vocabulary; ``hashed`` features need none.
    """
    stages: list = []
    made = "tokens"
    if tuple(ngrams) != (1,):
        stages.append(NGram(n=max(ngrams), inputCol="tokens", outputCol="grams"))
        made = "grams"
    counter = HashingTF(inputCol=made, outputCol="counts", numFeatures=size) if hashed else CountVectorizer(inputCol=made, outputCol="counts", minDF=min_df, vocabSize=size)
    return [*stages, counter, IDF(inputCol="counts", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features")]


def feature_pipeline(top: int | None = None, label: str = "label", **features) -> Pipeline:  # noqa: ANN003
    """Features and, with ``top``, the selection of so many by the F test of their means by class, as one object to fit; the result is in ``selected``."""
    stages = feature_stages(**features)
    if top:
        chosen = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="selected", selectionMode="numTopFeatures")
        stages.append(chosen.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top))
    return Pipeline(stages=stages)


def classifier(name: str, c: float = 1.0, rows: int = 1, weight: str | None = None, classes: int = 2):  # noqa: ANN201
    """A learner by name; C as in margin terms becomes a penalty over the rows."""
    extra = {"weightCol": weight} if weight else {}

    def margin(penalty: float):  # noqa: ANN202
        one = LinearSVC(regParam=penalty, maxIter=20, aggregationDepth=2)
        return one if classes == 2 else OneVsRest(classifier=one)

    return {
        "logistic_regression": lambda: LogisticRegression(regParam=1.0 / (c * max(1, rows)), maxIter=50, **extra),
        "sgd_log": lambda: LogisticRegression(regParam=1e-4, maxIter=50, **extra),
        "linear_svm": lambda: margin(1.0 / (c * max(1, rows))),
        "sgd_hinge": lambda: margin(1e-4),
        "multinomial_nb": lambda: NaiveBayes(modelType="multinomial", **extra),
        "complement_nb": lambda: NaiveBayes(modelType="complement", **extra),
    }[name]()


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: n over classes times class size."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return rows.join(sizes.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")  # one row


def fit(rows: DataFrame, name: str = "logistic_regression", c: float = 1.0, **features) -> PipelineModel:  # noqa: ANN003
    """Features fitted on the train rows alone, then a classifier. ``rows``: tokens, label, split."""
    train = rows.where("split = 'train'")
    return Pipeline(stages=[*feature_stages(**features), classifier(name, c, train.count())]).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds probabilities where the learner has them, predicted, confidence and uncertainty."""
    made = model.transform(rows).withColumn("predicted", F.col("prediction").cast("int"))
    if "probability" not in made.columns:
        return made.drop("counts", "idf", "features")
    p = vector_to_array("probability")
    top = F.sort_array(p, asc=False)
    return made.withColumns({"confidence": F.array_max(p), "uncertainty": 1 - (F.get(top, F.lit(0)) - F.get(top, F.lit(1)))}).drop("counts", "idf", "features")


# --- evaluation ------------------------------------------------------------------------------


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall, F1, balanced accuracy and MCC of 0/1 labels."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = rows.agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), ratio(tp * tn - fp * fn, below).alias("mcc"),
    )


def probability_metrics(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row: ROC AUC by average ranks, log loss, Brier score. The ranks come from counts by score."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    by = running(by, [F.col("s")], {"upto": F.col("neg")})
    below = F.col("upto") - F.col("neg")
    auc = by.select(((F.col("pos") * (below + F.col("neg") / 2))).alias("w"), "pos", "neg").agg(ratio(F.sum("w"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(truth).cast("double")
    loss = rows.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))
    return auc.crossJoin(loss)  # one row each


def calibration(rows: DataFrame, confidence: str = "score", correct: str = "truth", bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of equal-width bins, the last closed."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct).alias("accuracy"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """One row: expected calibration error of a curve."""
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return curve.agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def threshold_grid(rows: DataFrame, truth: str = "truth", score: str = "score", steps: int = 19) -> DataFrame:
    """(threshold, f1, precision, recall, youden) at equal steps: counts by step, then running sums."""
    step = F.least(F.floor(F.col(score) * (steps + 1)), F.lit(steps)).cast("int")
    by = rows.groupBy(step.alias("k")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(by, "k", "left").na.fill(0)
    over = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # a row a step
    every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = grid.select("k", F.sum("p").over(over).alias("tp"), F.sum("n").over(over).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg")).where("k > 0")
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    return made.select(
        (F.col("k") / (steps + 1)).alias("threshold"), ratio(2.0 * tp, tp + fp + pos).alias("f1"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, pos).alias("recall"), (ratio(tp, pos) - ratio(fp, neg)).alias("youden"),
    )


def ranked_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) at k; recall is 0 where nothing is relevant."""
    hit = ranked.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1))
    by = hit.groupBy("query_id").agg(F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = by.join(wanted, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(
        "query_id", ratio(F.col("hits").cast("double"), F.col("n")).alias("recall"), (F.col("hits") / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def uncertainty(p: Column) -> Column:
    """Of a binary probability: 1 at a half, 0 at certainty."""
    return 1 - 2 * F.abs(p - 0.5)


# --- clusters and topics ---------------------------------------------------------------------


def clustered(rows: DataFrame, k: int = 5, seed: int = 42, size: int = 1 << 18) -> DataFrame:
    """``rows`` with cluster, by k-means on unit-length TF-IDF vectors."""
    made = Pipeline(stages=feature_stages(size=size)).fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(made).transform(made).drop("counts", "idf")


def cluster_terms(rel: DataFrame, clusters: DataFrame, top_n: int = 10) -> DataFrame:
    """(cluster, term, weight, rank): terms by TF-IDF over clusters taken as single documents."""
    counts = rel.join(clusters, "unit_id").groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    k = clusters.select("cluster").distinct().count()
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.ln((F.lit(k) + 1.0) / (F.col("df") + 1)) + 1)
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return counts.join(df, "term").select("cluster", "term", weight.alias("weight")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def topics(rows: DataFrame, k: int = 5, iterations: int = 15, seed: int = 42, size: int = 1 << 18, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Topic terms (topic, term, weight, rank), and documents with their topic shares."""
    counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=size).fit(rows)
    counted = counter.transform(rows)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(counted)
    top = [
        (r["topic"], counter.vocabulary[i], float(w), n + 1)
        for r in model.describeTopics(top_n).collect()  # ``top_n`` terms a topic
        for n, (i, w) in enumerate(zip(r["termIndices"], r["termWeights"]))
    ]
    described = rows.sparkSession.createDataFrame(top, "topic int, term string, weight double, rank int")
    shares = model.transform(counted).select("unit_id", vector_to_array("topicDistribution").alias("shares"))
    return described, shares


def npmi_coherence(matrix: DataFrame, terms: DataFrame, n_units: int) -> DataFrame:
    """(topic, coherence): mean NPMI of each topic's term pairs over units; -1 for pairs that never meet."""
    wanted = terms.select("term").distinct()
    held = matrix.join(wanted, "term").select("unit_id", "term")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    a, b = held.withColumnRenamed("term", "x"), held.withColumnRenamed("term", "y")
    both = a.join(b, "unit_id").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))
    left, right = terms.select("topic", F.col("term").alias("x")), terms.select("topic", F.col("term").alias("y"))
    pairs = left.join(right, "topic").where("x < y").join(both, ["x", "y"], "left")
    pairs = pairs.join(df.select(F.col("term").alias("x"), F.col("df").alias("dx")), "x").join(df.select(F.col("term").alias("y"), F.col("df").alias("dy")), "y")
    n = F.lit(float(n_units))
    value = F.when(F.col("n").isNull(), -1.0).when(F.col("n") >= n, 1.0).otherwise(F.ln(F.col("n") * n / (F.col("dx") * F.col("dy"))) / -F.ln(F.col("n") / n))
    return pairs.groupBy("topic").agg(F.avg(value).alias("coherence"))


def topic_diversity(terms: DataFrame) -> DataFrame:
    """One row: share of distinct terms among all topics' top terms."""
    return terms.agg((F.countDistinct("term") / F.count("*")).alias("diversity"))


# --- regression ------------------------------------------------------------------------------


def ols(rows: DataFrame, dependent: str, independent: Sequence[str]) -> DataFrame:
    """(term, coefficient, std_error, t, p, r2, adj_r2) of a least-squares fit with intercept."""
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=list(independent), outputCol="x", handleInvalid="skip").transform(rows.where(F.col(dependent).isNotNull()))
    fitted = LinearRegression(featuresCol="x", labelCol=dependent, solver="normal").fit(made)
    s, names = fitted.summary, [*independent, "intercept"]
    out = [(n, float(c), float(e), float(t), float(p), float(s.r2), float(s.r2adj)) for n, c, e, t, p in zip(names, [*fitted.coefficients, fitted.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, t double, p double, r2 double, adj_r2 double")


def logit(rows: DataFrame, dependent: str, independent: Sequence[str]) -> DataFrame:
    """(term, coefficient, std_error, z, p, aic) of a maximum-likelihood logistic fit with intercept."""
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=list(independent), outputCol="x", handleInvalid="skip").transform(rows.where(F.col(dependent).isNotNull()))
    fitted = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="x", labelCol=dependent).fit(made)
    s, names = fitted.summary, [*independent, "intercept"]
    out = [(n, float(c), float(e), float(t), float(p), float(s.aic)) for n, c, e, t, p in zip(names, [*fitted.coefficients, fitted.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, z double, p double, aic double")


# --- drift -----------------------------------------------------------------------------------


def label_drift(baseline: DataFrame, current: DataFrame, label: str = "label") -> DataFrame:
    """One row: total variation distance and population stability index of two label distributions."""
    count = lambda df, n: df.groupBy(label).agg(F.count("*").alias(n))
    both = count(baseline, "a").join(count(current, "b"), label, "full_outer").na.fill(0, ["a", "b"])
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    p, q = ratio(F.col("a").cast("double"), F.col("ta")), ratio(F.col("b").cast("double"), F.col("tb"))
    lifted = (p <= 0) | (q <= 0)
    pp, qq = F.when(lifted, F.greatest(p, F.lit(1e-6))).otherwise(p), F.when(lifted, F.greatest(q, F.lit(1e-6))).otherwise(q)
    psi = F.when((p <= 0) & (q <= 0), 0.0).otherwise((qq - pp) * F.ln(qq / pp))
    return both.crossJoin(F.broadcast(total)).agg((F.sum(F.abs(p - q)) / 2).alias("tvd"), F.sum(psi).alias("psi"))


def score_drift(baseline: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """One row: two-sample Kolmogorov-Smirnov statistic and sizes. Scores are first counted by value."""
    tagged = baseline.select(F.col(score).alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(current.select(F.col(score).alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    by = tagged.groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = running(by, [F.col("s")], {"ra": F.col("a"), "rb": F.col("b")})
    total = by.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    gap = F.abs(F.col("ra") / F.col("ta") - F.col("rb") / F.col("tb"))
    return by.crossJoin(F.broadcast(total)).withColumn("gap", gap).agg(F.max("gap").alias("ks"), F.first("ta").alias("n_baseline"), F.first("tb").alias("n_current"))


def term_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(term, change): which terms of two lists stay, were added or removed, one row each."""
    both = baseline.select("term", F.lit(1).alias("a")).join(current.select("term", F.lit(1).alias("b")), "term", "full_outer")
    return both.select("term", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change"))


def term_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: Jaccard index of two term lists, and how many terms were added and removed (``term_changes`` has them)."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    return term_changes(baseline, current).agg(ratio(count("kept").cast("double"), F.count("*")).alias("jaccard"), count("added").alias("added"), count("removed").alias("removed"))


def drift_level(bands: Mapping[str, tuple[float, float]]) -> Column:
    """ok, watch or investigate: the worst band that any column reaches."""
    level = lambda c, low, high: F.when(F.col(c) >= high, 2).when(F.col(c) >= low, 1).otherwise(0)
    worst = F.greatest(*[level(c, *b) for c, b in bands.items()], F.lit(0))
    return F.get(F.array(F.lit("ok"), F.lit("watch"), F.lit("investigate")), worst)
