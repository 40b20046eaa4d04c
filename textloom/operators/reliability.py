"""Agreement between coders, gold labels, sampling and assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.relations import drawn


def raw_agreement(pairs: DataFrame) -> DataFrame:
    """One row of a pair table (a, b): share of equal labels, and how many pairs."""
    return pairs.agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), F.count("*").alias("n"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row: observed and expected agreement, kappa, n. Chance agreement of 1 gives 1 or 0."""
    observed = pairs.agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"), F.count("*").alias("n"))
    a = pairs.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("na"))
    b = pairs.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("nb"))
    both = a.join(b, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    joined = observed.crossJoin(both)  # one row each
    pe = F.coalesce(F.col("cross") / (F.col("n") * F.col("n")), F.lit(0.0))
    flat = F.abs(F.col("pe") - 1) <= 1e-12
    kappa = F.when(flat, F.when(F.abs(F.col("po") - 1) <= 1e-12, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return joined.withColumn("pe", pe).select(F.col("po").alias("observed"), F.col("pe").alias("expected"), kappa.alias("kappa"), "n")


def coder_pairs(ann: DataFrame) -> DataFrame:
    """(coder_a, coder_b, unit_id, a, b): every unit that two coders share."""
    one = ann.select("unit_id", F.col("coder_id").alias("coder_a"), F.col("value").alias("a"))
    two = ann.select("unit_id", F.col("coder_id").alias("coder_b"), F.col("value").alias("b"))
    return one.join(two, "unit_id").where("coder_a < coder_b")


def pair_matrix(ann: DataFrame) -> DataFrame:
    """Agreement of each two coders, with their common units."""
    return coder_pairs(ann).groupBy("coder_a", "coder_b").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), F.count("*").alias("n_common"))


def unit_counts(ann: DataFrame) -> DataFrame:
    """(unit_id, value, c, m): how often a unit got each value, and how many values it got."""
    by = ann.where(F.col("value").isNotNull()).groupBy("unit_id", "value").agg(F.count("*").alias("c"))
    return by.withColumn("m", F.sum("c").over(Window.partitionBy("unit_id")))


def krippendorff_alpha(ann: DataFrame) -> DataFrame:
    """One row: nominal alpha over units with two or more values; null with none, 1 with one category."""
    counts = unit_counts(ann)
    paired = counts.where("m >= 2")
    marginal = paired.groupBy("value").agg(F.sum("c").cast("double").alias("n_c"))
    expected = marginal.agg(F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("squares"))
    observed = paired.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("apart"))
    kinds = counts.agg(F.countDistinct("value").alias("kinds"))
    n, apart = F.col("n"), F.col("apart")
    alpha = F.when(n.isNull(), None).when(F.col("kinds") < 2, 1.0).when(n * n == F.col("squares"), 1.0).otherwise(1 - (n - 1) * apart / (n * n - F.col("squares")))
    return expected.crossJoin(observed).crossJoin(kinds).select(alpha.alias("alpha"), F.coalesce(n, F.lit(0.0)).cast("long").alias("n_values"))  # one row each


def fleiss_kappa(ann: DataFrame) -> DataFrame:
    """One row: kappa over the units with the commonest number of raters (the larger of equals), if it is 3 or more."""
    counts = unit_counts(ann)
    sizes = counts.where("m >= 2").select("unit_id", "m").distinct().groupBy("m").agg(F.count("*").alias("units"))
    modal = sizes.agg(F.max(F.struct("units", "m")).alias("x")).select(F.col("x.m").alias("n_raters"), F.col("x.units").alias("n_units"))
    kept = counts.join(F.broadcast(modal), F.col("m") == F.col("n_raters"))  # one row
    r, k = F.col("n_raters"), F.col("n_units")
    within = kept.groupBy("unit_id", "n_raters", "n_units").agg(((F.sum(F.col("c") * F.col("c")) - F.first("m")) / (F.first("m") * (F.first("m") - 1))).alias("p"))
    mean = within.groupBy("n_raters", "n_units").agg(F.avg("p").alias("p_bar"))
    chance = kept.groupBy("value").agg((F.sum("c") / (F.first("n_units") * F.first("n_raters"))).alias("p_j")).agg(F.sum(F.col("p_j") * F.col("p_j")).alias("p_e"))
    kappa = F.when((r < 3) | (k < 2), None).when(F.col("p_e") >= 1, 1.0).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))
    return mean.crossJoin(chance).select(kappa.alias("kappa"), r.cast("long").alias("n_raters"), k.alias("n_units"))  # one row each


def disagreements(ann: DataFrame) -> DataFrame:
    """Units with two or more coders and more than one value."""
    by = ann.groupBy("unit_id").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("coder_id").alias("n_coders"))
    return by.where("n_values > 1 AND n_coders >= 2")


def majority(ann: DataFrame, min_agreement: float = 0.0) -> DataFrame:
    """(unit_id, value, share): the commonest value; of equals the one given by the first coder."""
    by = ann.groupBy("unit_id", "value").agg(F.count("*").alias("c"), F.min("coder_id").alias("first"))
    w = Window.partitionBy("unit_id")
    top = by.withColumn("m", F.sum("c").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("c"), "first")))
    return top.where("k = 1").select("unit_id", "value", (F.col("c") / F.col("m")).alias("share")).where(F.col("share") >= min_agreement)


def adjudicated(ann: DataFrame, decisions: DataFrame) -> DataFrame:
    """(unit_id, value, origin): the adjudication, else the value all coders gave; others are left out."""
    by = ann.groupBy("unit_id").agg(F.countDistinct("value").alias("kinds"), F.min("value").alias("value"))
    joined = by.join(decisions.select("unit_id", "final_value"), "unit_id", "full_outer")
    value = F.coalesce("final_value", F.when(F.col("kinds") == 1, F.col("value")))
    origin = F.when(F.col("final_value").isNotNull(), "adjudicated").otherwise("unanimous")
    return joined.select("unit_id", value.alias("value"), origin.alias("origin")).where(F.col("value").isNotNull())


def prevalence(values: DataFrame, group: str) -> DataFrame:
    """(group_key, n, n_yes, prevalence) of 0/1 values."""
    name = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unspecified"))
    return values.groupBy(name.alias("group_key")).agg(F.count("*").alias("n"), F.sum("value").alias("n_yes"), F.avg("value").alias("prevalence"))


def label_layers(units: DataFrame, gold: DataFrame, model: DataFrame) -> DataFrame:
    """(unit_id, value, provenance): gold where there is one, else the model's value."""
    return (
        units.select("unit_id")
        .join(gold.select("unit_id", F.col("value").alias("g")), "unit_id", "left")
        .join(model.select("unit_id", F.col("value").alias("m")), "unit_id", "left")
        .select("unit_id", F.coalesce("g", "m").alias("value"), F.when(F.col("g").isNotNull(), "human").when(F.col("m").isNotNull(), "model").alias("provenance"))
    )


def allocate(sizes: dict[str, int], total: int, mode: str = "proportional") -> dict[str, int]:
    """How many to draw from each stratum: largest remainders or equal parts, capped, refilled in turn."""
    if not sizes:
        return {}
    names, every = sorted(sizes), sum(sizes.values())
    total = min(total, every)
    every = max(every, 1)
    ideal = {s: total * sizes[s] / every if mode == "proportional" else total / len(names) for s in names}
    out = {s: min(sizes[s], int(ideal[s])) for s in names}
    for s in sorted(names, key=lambda s: (int(ideal[s]) - ideal[s], s)):
        if sum(out.values()) < total and out[s] < sizes[s]:
            out[s] += 1
    while sum(out.values()) < total:
        for s in names:
            if sum(out.values()) < total and out[s] < sizes[s]:
                out[s] += 1
    return out


def draw(seed: int, *keys: str) -> Column:
    """A number for each key that stays the same on any cluster."""
    return drawn(seed, *[F.col(k) for k in keys])


def stratified_sample(units: DataFrame, stratum: str, size: int, mode: str = "proportional", seed: int = 42, max_per_document: int | None = None, document: str = "doc_id") -> DataFrame:
    """``units`` drawn by stratum, in the order of a seeded hash; only the strata's sizes reach the driver."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("unspecified"))
    pool = units.withColumn("_stratum", name).withColumn("_draw", draw(seed, "unit_id"))
    if max_per_document is not None:
        pool = pool.withColumn("_d", F.row_number().over(Window.partitionBy(document).orderBy("_draw", "unit_id"))).where(F.col("_d") <= max_per_document).drop("_d")
    sizes = {r["_stratum"]: r["count"] for r in pool.groupBy("_stratum").count().collect()}
    wanted = allocate(sizes, size, mode)
    if not wanted:
        return units.limit(0)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)]), F.col("_stratum"))
    order = Window.partitionBy("_stratum").orderBy("_draw", "unit_id")
    return pool.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k", "_draw", "_stratum")


def assignment(units: DataFrame, annotators: Sequence[str], strategy: str = "overlap", overlap: int = 0, seed: int = 42) -> DataFrame:
    """(unit_id, annotator): all to all, dealt in turn, or the first ``overlap`` to all and the rest in turn."""
    names = F.array(*[F.lit(a) for a in annotators])
    order = Window.orderBy("_draw", "unit_id")  # a sample for hand annotation
    ranked = units.select("unit_id", draw(seed, "unit_id").alias("_draw")).withColumn("k", F.row_number().over(order) - 1)
    shared = {"shared": F.lit(True), "disjoint": F.lit(False), "overlap": F.col("k") < overlap}[strategy]
    own = F.array(F.get(names, (F.col("k") % len(annotators)).cast("int")))
    return ranked.select("unit_id", F.explode(F.when(shared, names).otherwise(own)).alias("annotator"))


def rating_patterns(ann: DataFrame) -> tuple[DataFrame, list]:
    """(pattern, n): how many units got each combination of ratings, and the coders that a pattern lists in order. A missing rating is null.

    Patterns are as many as combinations of values, not as units.
    """
    coders = [r[0] for r in ann.select("coder_id").distinct().orderBy("coder_id").collect()]  # a row a coder
    if not coders:
        return ann.select(F.array().cast("array<string>").alias("pattern"), F.lit(0).cast("long").alias("n")).limit(0), []
    by = ann.where(F.col("value").isNotNull()).groupBy("unit_id").agg(*[F.max(F.when(F.col("coder_id") == c, F.col("value"))).cast("string").alias(f"c{i}") for i, c in enumerate(coders)])
    return by.groupBy(F.array(*[F.col(f"c{i}") for i in range(len(coders))]).alias("pattern")).agg(F.count("*").alias("n")), coders


def _agreements(codes: np.ndarray, kinds: int, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Cohen's kappa of the first two coders, Krippendorff's alpha and Fleiss' kappa for each row of ``weights`` (resample, pattern).

    ``codes``: (pattern, coder), -1 for a missing rating. NaN where a coefficient isn't defined.
    """
    counts = (codes[:, :, None] == np.arange(kinds)[None, None, :]).sum(axis=1).astype(float)  # (pattern, value)
    raters = counts.sum(axis=1)
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (codes[:, :2] >= 0).all(axis=1) & (codes.shape[1] > 1)
        w, pair = weights[:, both], codes[both, :2]
        total = w.sum(axis=1)
        po = w @ (pair[:, 0] == pair[:, 1]) / total if both.any() else np.full(len(weights), np.nan)
        shares = [np.stack([w @ (pair[:, side] == v) / total for v in range(kinds)], axis=1) if both.any() else np.zeros((len(weights), kinds)) for side in (0, 1)]
        pe = (shares[0] * shares[1]).sum(axis=1)
        out["cohen_kappa"] = np.where(np.abs(pe - 1) <= 1e-12, np.where(np.abs(po - 1) <= 1e-12, 1.0, 0.0), (po - pe) / (1 - pe))

        several = raters >= 2
        w, c, m = weights[:, several], counts[several], raters[several]
        values = w @ c
        n = values.sum(axis=1)
        apart = w @ ((c * (m[:, None] - c)).sum(axis=1) / (m - 1))
        squares = (values**2).sum(axis=1)
        alone = ((weights @ counts) > 0).sum(axis=1) < 2
        out["krippendorff_alpha"] = np.where(n == 0, np.nan, np.where(alone | (n * n == squares), 1.0, 1 - (n - 1) * apart / (n * n - squares)))

        sizes = np.unique(m)
        units = np.stack([w[:, m == s].sum(axis=1) for s in sizes], axis=1) if len(sizes) else np.zeros((len(weights), 0))
        fleiss = np.full(len(weights), np.nan)
        modal = len(sizes) - 1 - units[:, ::-1].argmax(axis=1) if len(sizes) else np.zeros(len(weights), int)  # the larger of equals
        for at, s in enumerate(sizes):
            rows = (modal == at) & (s >= 3) & (units[:, at] >= 2)
            if not rows.any():
                continue
            x, d = w[rows][:, m == s], c[m == s]
            k = x.sum(axis=1)
            p_bar = x @ (((d**2).sum(axis=1) - s) / (s * (s - 1))) / k
            p_e = ((x @ d / (k * s)[:, None]) ** 2).sum(axis=1)
            fleiss[rows] = np.where(p_e >= 1, 1.0, (p_bar - p_e) / (1 - p_e))
        out["fleiss_kappa"] = fleiss
    return out


def bootstrap_coefficients(ann: DataFrame, samples: int = 2000, level: float = 0.95, seed: int = 42, most_patterns: int = 20_000) -> DataFrame:
    """(coefficient, estimate, low, high, n_replicates) of three coefficients, by resampling units.

    Drawing units with replacement is drawing patterns by a multinomial of their counts, so a resample costs
    as much as there are patterns. Resamples are dealt over tasks; to each goes the table of patterns, which must not be longer than
    ``most_patterns``. The interval is from the sorted replicates at the floor of the lower and the ceiling of the upper place; null with fewer than two.
    """
    table, coders = rating_patterns(ann)
    kept = table.orderBy("pattern").limit(most_patterns + 1).collect()
    if len(kept) > most_patterns:
        raise ValueError(f"ratings have more than {most_patterns} patterns; group rare values first")
    spark, shape = ann.sparkSession, "coefficient string, estimate double, low double, high double, n_replicates bigint"
    if not kept:
        return spark.createDataFrame([], shape)
    values = sorted({v for r in kept for v in r["pattern"] if v is not None})
    codes = np.array([[values.index(v) if v is not None else -1 for v in r["pattern"]] for r in kept]).reshape(len(kept), len(coders))
    n = np.array([r["n"] for r in kept], np.int64)
    given = _agreements(codes, len(values), n[None, :].astype(float))

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for frame in frames:
            for start in range(0, len(frame), 64):
                part = frame["id"].to_numpy()[start : start + 64]
                drawn_ = np.stack([np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum()) for i in part])
                for name, x in _agreements(codes, len(values), drawn_.astype(float)).items():
                    yield pd.DataFrame({"coefficient": name, "x": x})

    made = spark.range(samples).mapInPandas(run, "coefficient string, x double").where(~F.isnan("x"))
    lists = {r["coefficient"]: sorted(r["x"]) for r in made.groupBy("coefficient").agg(F.collect_list("x").alias("x")).collect()}  # ``samples`` numbers each
    rows, tail = [], (1 - level) / 2
    for name, x in given.items():
        found = lists.get(name, [])
        ends = (found[math.floor(tail * (len(found) - 1))], found[math.ceil((1 - tail) * (len(found) - 1))]) if len(found) > 1 else (None, None)
        rows.append((name, None if math.isnan(x[0]) else float(x[0]), *ends, len(found)))
    return spark.createDataFrame(rows, shape)


def metadata(ann: DataFrame) -> DataFrame:
    """One row: n_coders (most ratings a unit could have), n_units, pairable_units (two ratings or more) and missing_values of the unit-by-coder table."""
    coders = ann.agg(F.countDistinct("coder_id").alias("n_coders"))
    by = ann.groupBy("unit_id").agg(F.count("value").alias("m"))
    units = by.agg(F.count("*").alias("n_units"), F.count_if(F.col("m") >= 2).alias("pairable_units"), F.coalesce(F.sum("m"), F.lit(0)).alias("present"))
    return units.crossJoin(coders).select("n_coders", "n_units", "pairable_units", (F.col("n_units") * F.col("n_coders") - F.col("present")).alias("missing_values"))  # one row each


def bootstrap_agreement(pairs: DataFrame, samples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high): percentile interval of Cohen's kappa over resampled units.

    The pairs are counted into a contingency table, whose few cells come to the driver; a resample of the units is a
    multinomial draw of the cells' counts.
    """
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).orderBy("a", "b").collect()  # at most a cell for each two labels
    labels = sorted({v for r in cells for v in (r["a"], r["b"])}, key=str)
    at = {v: i for i, v in enumerate(labels)}
    counts = np.array([r["c"] for r in cells], np.int64)
    n = int(counts.sum()) if len(counts) else 0
    found: list[float] = []
    for w in np.random.default_rng(seed).multinomial(n, counts / n, samples) if n else []:
        table = np.zeros((len(labels), len(labels)))
        for r, x in zip(cells, w):
            table[at[r["a"]], at[r["b"]]] += x / n
        po, pe = float(np.trace(table)), float(table.sum(axis=1) @ table.sum(axis=0))
        found.append(1.0 if pe >= 1 else (po - pe) / (1 - pe))
    tail = (1 - level) / 2
    ends = [float(np.quantile(found, q)) for q in (tail, 1 - tail)] if found else [None, None]
    return pairs.sparkSession.createDataFrame([tuple(ends)], "low double, high double")
