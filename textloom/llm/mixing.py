"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, by tokens. The cells'
tokens are raked: scaled to the target of one margin after the other until all three
hold, never above what a cell has. The ratio of raked to present tokens is the
probability with which each document of the cell is sampled, by a hash of its id and text, so that
the expected tokens of the sample meet the targets, and the same rows are drawn again on any
cluster.

Documents are aggregated to cells before anything else, map-side, so a hot source is
one row from each task; only the cells go through the rounds, and a margin is summed the same
way and joined, so the cells of a hot value don't meet in one task. All of it is
DataFrame expressions. Rounds are written as tables of cells, and two numbers of them
reach the driver: how far the margins are from their targets, and how much moved.

Targets are shares. A value without a target keeps its share of the remainder, in proportion
to its present tokens; a value that a target names and no document has takes no part, and one
that hasn't enough gives all it has; the rest are scaled up. Without any targets of a margin, sources and topics tend to equal
shares by ``flatten`` (shares in proportion to tokens to that power: 1 keeps, 0 makes equal).
Raking ends when the margins hold, or when nothing moves any more; targets that contradict each other or
ask for cells that are not there can't hold, which is warned of with the distance that is left.

Defined cases: null source, language or topic is a value of its own, "unspecified"; null
or blank texts have no tokens and are never sampled; rows of equal id and text are
sampled together, and rows that share only the id (or have none) each for itself; an empty table gives an empty table. Other columns stay as they are; one that bears the
name of a result (``RESULTS``) gives way to it.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import dropped, written

MARGINS = ("_source", "_lang", "_topic")
RESULTS = (*MARGINS, "_tokens", "_weight", "_sampled")

# Some words that speak for a topic, in four languages.
TOPICS: Mapping[str, Sequence[str]] = {
    "commerce": ("price", "buy", "sale", "shop", "order", "preis", "kaufen", "prix", "acheter", "vente", "precio", "comprar", "venta"),
    "science": ("study", "research", "theory", "data", "science", "studie", "forschung", "theorie", "étude", "recherche", "estudio", "ciencia"),
    "law": ("license", "licence", "copyright", "court", "law", "rights", "gesetz", "gericht", "recht", "droit", "tribunal", "loi", "ley", "derechos"),
    "software": ("code", "software", "function", "server", "password", "file", "datei", "fichier", "logiciel", "archivo", "programa"),
    "news": ("news", "today", "government", "minister", "nachrichten", "heute", "regierung", "nouvelles", "gouvernement", "noticias", "gobierno"),
}


def form_of(text: Column) -> Column:
    """The kind of text by its form: how much of it is digits, marks, lines."""
    n = F.greatest(F.length(text), F.lit(1))
    # whole runs of other characters go at once, and the little that is left is looked at again
    odd = F.regexp_replace(text, r"[^0-9#$%&*|=<>{}\[\]_~^\\]+", "")
    digits = F.length(F.regexp_replace(odd, "[^0-9]+", ""))
    marks, digits = (F.length(odd) - digits) / n, digits / n
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / n
    return (
        F.when(text.isNull(), None)
        .when(marks > 0.03, "marked")
        .when(digits > 0.02, "numeric")
        .when(lines > 0.012, "listed")
        .when(n < 600, "brief")
        .otherwise("prose")
    )


def topic_of(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS, least: int = 2) -> Column:
    """The topic most of whose words the text has, if it has so many different ones at least; null if none does.

    Ties go to the topic that is listed first. A classifier's column may be given in its place.
    """
    every = F.array(*[F.lit(w) for listed in topics.values() for w in listed])
    found = F.array_intersect(F.split(F.lower(text), r"[^\p{L}]+"), every)

    def best(hits: Column) -> Column:
        count = lambda listed: F.size(F.filter(hits, lambda w: w.isin(*listed)))
        made = F.array_max(F.array(*[F.struct(count(listed).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, listed) in enumerate(topics.items())]))
        return F.when(made["n"] >= least, made["name"])

    # a one-element transform binds the words that were found, most often none
    return F.element_at(F.transform(F.array(found), lambda hits: F.when(F.size(hits) >= least, best(hits))), 1)


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up; none in blank texts."""
    return F.when(F.btrim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.ceil(F.octet_length(text) / 4)).cast("long")


def with_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None = None) -> DataFrame:
    """(doc, the three margins, _tokens): each row of ``docs`` as one value, so that no names clash."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unspecified"))
    text = F.col(text_col)
    own = F.coalesce(topic_of(text), form_of(text)) if topic is None else topic
    return docs.select(F.struct("*").alias("doc"), named(F.col(source_col)).alias("_source"), named(F.col(lang_col)).alias("_lang"), named(own).alias("_topic"), tokens_of(text).alias("_tokens"))


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, flatten: float, share: float) -> DataFrame:
    """(margin, target tokens), one row for each value: no value above what it has, the sum in full.

    What a scarce value cannot give is shared among the others by their targets, until none is
    above. Only single numbers reach the driver.
    """
    have, raw = F.col("have"), F.col("raw")
    table = cells.groupBy(margin).agg(F.sum("have").alias("have"))
    if wanted:
        listed = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))])
        given = F.element_at(listed, F.col(margin))
        others = table.agg(F.sum(F.when(given.isNull(), have))).first()[0] or 1.0
        left = max(0.0, 1.0 - sum(wanted.values()))
        table = table.withColumn("raw", F.coalesce(given, F.lit(left) * have / F.lit(others)))
    else:
        table = table.withColumn("raw", F.pow(have, F.lit(flatten)))
    table = written(table, "aims")
    total, full, low = table.agg(F.sum("have"), F.min(have / raw), F.max(have / raw)).first()
    budget = share * (total or 0.0)
    # the scale at which all give ``budget``: between two of so many candidates, then between two within these
    low, high = 0.0, max(low or 0.0, 0.0)
    for _ in range(3):
        steps = [low + (high - low) * k / 64 for k in range(65)]
        sums = table.agg(*[F.sum(F.least(have, raw * F.lit(x))).alias(f"s{k}") for k, x in enumerate(steps)]).first()
        at = max((k for k in range(65) if (sums[k] or 0.0) <= budget), default=0)
        low, high = steps[at], steps[min(64, at + 1)]
    # and exactly so, by who is used up there
    gone = raw * F.lit((low + high) / 2) >= have
    used, free = table.agg(F.sum(F.when(gone, have).otherwise(0.0)), F.sum(F.when(gone, 0.0).otherwise(raw))).first()
    scale = (budget - (used or 0.0)) / free if free else high
    result = table.select(margin, F.least(have, raw * F.lit(scale)).alias("target"))
    return written(result, "targets")


def _scaled(cells: DataFrame, margin: str) -> DataFrame:
    """``cells`` scaled to one margin's targets: a cell that is used up keeps all it has, and the others of the
    value share what is left."""
    have, want, aim = F.col("have"), F.col("want"), F.col(f"aim{margin}")
    sums = cells.groupBy(margin).agg(
        F.sum(F.when(want >= have, have).otherwise(0.0)).alias("used"), F.sum(F.when(want >= have, 0.0).otherwise(want)).alias("free")
    )
    rest = aim - F.col("used")
    scaled = (
        F.when(rest < 0, want * aim / (F.col("used") + F.col("free")))
        .when((want >= have) | (F.col("free") <= 0), want)
        .otherwise(F.least(have, want * rest / F.col("free")))
    )
    return cells.join(sums, margin).withColumn("want", scaled).drop("used", "free")


def _distance(cells: DataFrame) -> float:
    """The largest part of all tokens by which a value of a margin misses its target."""
    total, far = None, 0.0
    for m in MARGINS:
        by = cells.groupBy(m).agg(F.sum("want").alias("want"), F.first(f"aim{m}").alias("aim"))
        total, most = by.agg(F.sum("aim"), F.max(F.abs(F.col("want") - F.col("aim")))).first()
        far = max(far, (most or 0.0) / total if total else 0.0)
    return far


def raked(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float] | None], share: float = 0.5, flatten: float = 0.5,
    tolerance: float = 1e-3, most_rounds: int = 300,
) -> DataFrame:
    """``cells`` (the margins and have) with want: tokens raked to the targets, at most have.

    Two rounds are one job; a written table follows them. Raking ends when no value misses its target by
    more than ``tolerance`` of all tokens, or when less than a tenth of that moves in two rounds.
    """
    aims = {m: _targets(cells, m, targets.get(m), flatten, share) for m in MARGINS}
    now = cells.withColumn("want", F.col("have") * share)
    for m in MARGINS:
        now = now.join(aims[m].withColumnRenamed("target", f"aim{m}"), m)
    now = written(now, "cells")
    far = _distance(now)
    for _ in range(0, most_rounds, 2):
        if far <= tolerance:
            break
        step = now.withColumn("was", F.col("want"))
        for m in MARGINS * 2:
            step = _scaled(step, m)
        then = written(step, "cells")
        dropped(now)
        now = then.drop("was")
        far = _distance(now)
        moved = then.agg(F.sum(F.abs(F.col("want") - F.col("was"))) / F.sum("want")).first()[0] or 0.0
        if moved < tolerance / 10:
            break
    if far > tolerance:
        warnings.warn(f"the targets can't all hold: one is missed by {far:.4f} of the tokens", stacklevel=2)
    return now.select(*MARGINS, "have", "want")


def mixed(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float] | None] | None = None, share: float = 0.5, flatten: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 3,
) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, _weight (raked over present tokens of the
    cell: the sampling probability) and _sampled.

    ``targets`` maps "_source", "_lang" and "_topic" to shares by value; ``share`` is the part of
    all tokens to sample.
    """
    celled = with_cells(docs, text_col, source_col, lang_col, topic)
    cells = written(celled.groupBy(*MARGINS).agg(F.sum("_tokens").cast("double").alias("have")).where("have > 0"), "have")
    weights = written(raked(cells, targets or {}, share, flatten).select(*MARGINS, (F.col("want") / F.col("have")).alias("_weight")), "weights")
    ident, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    draw = (F.xxhash64(ident, text, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1).cast("long")) / F.lit(float(1 << 52))).cast("double")
    weighed = celled.join(weights, list(MARGINS), "left").withColumn("_weight", F.when(F.col("_tokens") > 0, F.coalesce("_weight", F.lit(0.0))).otherwise(0.0))
    others = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return weighed.withColumn("_sampled", draw < F.col("_weight")).select(*others, *RESULTS)
