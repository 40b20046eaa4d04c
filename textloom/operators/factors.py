"""Singular vectors and nonnegative factors of a whole unit-by-term matrix, with no cut of the vocabulary.

The matrix is dealt once into blocks of units, a bucket of a table each, in which terms have numbers of the block. A pass over it sends each block the factor's
rows of the terms that the block has, and takes back one row for each of these terms; entries never move again. The factors stay long tables too: a row
for each unit or term with an array of as many numbers as there are factors. Only sums whose size is the square of the number of factors reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.relations import dfm, token_rel
from textloom.operators.similarity import unit_tfidf
from textloom.tables import buckets, dropped, written


def weights_of(rows: DataFrame) -> DataFrame:
    """(unit_id, term, weight): TF-IDF of ``rows`` (unit_id, tokens), each unit of length one, over all terms."""
    matrix = written(dfm(token_rel(rows)), "matrix")
    return written(unit_tfidf(matrix, rows.count()), "weights")


@dataclass
class Matrix:
    """units: (block, unit_id, ids, values), in a bucket each block; ids are numbers of the block's terms. terms: (id, term, df, idf, places), of which places
    are (block, at), the term's number in each block that has it. An entry is value times idf, over the unit's length if ``scaled``."""

    units: DataFrame
    terms: DataFrame
    blocks: int
    n_units: int
    scaled: bool


def matrix_of(rows: DataFrame, each: int = 24_000_000) -> Matrix:
    """TF-IDF of ``rows`` (unit_id, tokens), each unit of length one, in blocks of about ``each`` tokens."""
    n, size = rows.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    idf = F.ln((F.lit(float(n)) + 1) / (F.col("df") + 1)) + 1
    return _blocked(rows.select("unit_id", "tokens", F.lit(None).cast("array<double>").alias("values")), n, size or 0, each, idf, True)


def matrix_from(weights: DataFrame, each: int = 24_000_000) -> Matrix:
    """The matrix of ``weights`` (unit_id, term, weight)."""
    rows = weights.groupBy("unit_id").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("unit_id", F.col("x.term").alias("tokens"), F.col("x.weight").alias("values"))
    rows = written(rows, "rows")
    return _blocked(rows, rows.count(), weights.count(), each, F.lit(1.0), False)


def _numbered(t: pa.Table) -> pa.Table:
    """The units of one block with numbers for their terms, and after them the terms."""
    block = t["block"][0]
    unit = t["unit_id"].combine_chunks().dictionary_encode("encode")
    own, names = (unit.chunk(0), unit.chunk(0).dictionary) if isinstance(unit, pa.ChunkedArray) else (unit, unit.dictionary)
    tokens = t["tokens"].combine_chunks()
    doc = np.repeat(own.indices.to_numpy(), np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)).astype(np.int64)
    words = tokens.flatten()
    some = pc.is_valid(words).to_numpy(zero_copy_only=False)
    values = t["values"].combine_chunks().flatten()
    times = values.to_numpy(zero_copy_only=False)[some] if len(values) else None
    words, doc = words.filter(pa.array(some)).dictionary_encode(), doc[some]
    key, at = np.unique(doc * max(1, len(words.dictionary)) + words.indices.to_numpy().astype(np.int64), return_inverse=True)
    value = np.bincount(at, times, len(key))
    doc, ids = np.divmod(key, max(1, len(words.dictionary)))
    starts = np.searchsorted(doc, np.arange(len(names) + 1)).astype(np.int32)
    df = np.bincount(ids, minlength=len(words.dictionary))
    list_of = lambda x, kind: pa.ListArray.from_arrays(pa.array(starts), pa.array(x, kind))
    units = pa.table({"block": pa.repeat(block, len(names)), "unit_id": names, "ids": list_of(ids, pa.int32()), "values": list_of(value, pa.float64())})
    terms = pa.table({"block": pa.repeat(block, len(df)), "term": words.dictionary, "at": pa.array(np.arange(len(df)), pa.int32()), "df": pa.array(df, pa.int64())})
    whole = pa.concat_tables([units, terms], promote_options="default")
    return whole.select(["block", "unit_id", "ids", "values", "term", "at", "df"])


def into_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (unit_id, ...) with block first, each block a partition; rows that share an id are of one block."""
    # names of blocks that fall into different buckets, so that a task has one
    by = rows.sparkSession.range(50 * blocks).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks))).agg(F.min("id").cast("int")).collect()  # a row each block
    names = F.array(*[F.lit(r[1]) for r in by])
    return rows.select(F.get(names, F.pmod(F.xxhash64("unit_id"), F.lit(len(by))).cast("int")).alias("block"), "*").repartition(blocks, "block")


def _blocked(rows: DataFrame, n_units: int, size: int, each: int, idf: Column, scaled: bool) -> Matrix:
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // each))
    kind = rows.schema["unit_id"].dataType.simpleString()
    dealt = into_blocks(rows, blocks).groupBy("block")
    made = dealt.applyInArrow(_numbered, f"block int, unit_id {kind}, ids array<int>, values array<double>, term string, at int, df bigint")  # a block of units
    made = buckets(made, "block", blocks, "blocks")
    of = made.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("block", "at")).alias("places"))
    terms = written(of.select(F.monotonically_increasing_id().alias("id"), "term", "df", idf.alias("idf"), "places"), "terms")
    return Matrix(made.where(F.col("ids").isNotNull()).select("block", "unit_id", "ids", "values"), terms, blocks, n_units, scaled)


class _Block:
    """The entries of a block of units, and the rows of a factor that were sent for its terms."""

    def __init__(self, units: pa.Table, sent: pa.Table, n: int, scaled: bool) -> None:
        ids = units["ids"].combine_chunks()
        self.unit_id, self.many = units["unit_id"].combine_chunks(), len(units)
        self.row = np.repeat(np.arange(self.many), ids.value_lengths().to_numpy())
        self.ids = ids.flatten().to_numpy()
        of = sent.filter(pc.is_valid(sent["at"])).combine_chunks()
        at = of["at"].to_numpy()
        self.z, self.id, idf = np.zeros((len(at), n)), np.zeros(len(at), np.int64), np.zeros(len(at))
        self.id[at], idf[at] = of["id"].to_numpy(), of["idf"].to_numpy()
        for i in range(n):
            self.z[at, i] = of[f"f{i}"].to_numpy()
        self.value = units["values"].combine_chunks().flatten().to_numpy()
        self.w = self.value * idf[self.ids]
        if scaled:
            self.w /= np.sqrt(np.bincount(self.row, self.w * self.w, self.many))[self.row]

    @staticmethod
    def _stacked(columns: list[np.ndarray], n: int) -> np.ndarray:
        return np.stack(columns, axis=1) if columns else np.zeros((n, 0))

    def over(self) -> np.ndarray:
        """The sums of each unit over its entries."""
        return self._stacked([np.bincount(self.row, self.w * self.z[self.ids, i], self.many) for i in range(self.z.shape[1])], self.many)

    def back(self, y: np.ndarray) -> np.ndarray:
        """The sums of each term over its entries."""
        return self._stacked([np.bincount(self.ids, self.w * y[self.row, i], len(self.id)) for i in range(y.shape[1])], len(self.id))


def _rows(out: dict[str, pa.Array | np.ndarray], f: np.ndarray) -> pa.Table:
    return pa.table(out | {f"f{i}": np.ascontiguousarray(f[:, i]) for i in range(f.shape[1])})


def _sent(m: Matrix, factor: DataFrame, n: int) -> DataFrame:
    """(block, at, id, idf, f0, ...): the rows of ``factor`` (id, f) for each block that has the term."""
    rows = factor.select("id", "f").join(m.terms.select("id", "idf", "places"), "id").select("id", "idf", F.explode("places").alias("p"), *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(n)])
    return rows.select("p.block", "p.at", "id", "idf", *[f"f{i}" for i in range(n)])


def _passed(m: Matrix, sent: DataFrame, what: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What each block makes of its units and the rows sent to it."""
    return m.units.groupBy("block").cogroup(sent.repartition(m.blocks, "block").groupBy("block")).applyInArrow(what, schema)


def _columns(n: int) -> str:
    return "".join(f", f{i} double" for i in range(n))


def _array(n: int, of: Callable[[int], Column] = lambda i: F.col(f"f{i}")) -> Column:
    return (F.array(*[of(i) for i in range(n)]) if n else F.array().cast("array<double>")).alias("f")


def _over(m: Matrix, factor: DataFrame, n: int, off: list[float]) -> DataFrame:
    """(unit_id, f): for each unit the sum of weight times ``factor`` (id, f), less ``off``."""
    scaled = m.scaled

    def what(units: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(units):
            return _rows({"unit_id": units["unit_id"]}, np.zeros((0, n)))
        b = _Block(units, sent, n, scaled)
        return _rows({"unit_id": b.unit_id}, b.over() - off)

    kind = m.units.schema["unit_id"].dataType.simpleString()
    return _passed(m, _sent(m, factor, n), what, f"unit_id {kind}{_columns(n)}").select("unit_id", _array(n))


def _and_back(m: Matrix, factor: DataFrame, n: int, off: list[float], centred: bool) -> DataFrame:
    """(id, f): ``factor`` (id, f) through the matrix and its transpose. The units' sums have ``off`` taken from them; where the matrix is ``centred``
    the row of id -1 has the units' sums, and the last number of each other row is the sum of the term's column."""
    scaled, wide = m.scaled, n + centred

    def what(units: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(units):
            return _rows({"id": np.zeros(0, np.int64)}, np.zeros((0, wide)))
        b = _Block(units, sent, n, scaled)
        y = b.over() - off
        if centred:
            y = np.c_[y, np.ones(len(y))]
        return _rows({"id": np.r_[b.id, -1]}, np.r_[b.back(y), y.sum(axis=0)[None]])

    made = _passed(m, _sent(m, factor, n), what, f"id bigint{_columns(wide)}")
    return made.groupBy("id").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(wide)]).select("id", _array(wide))


def product(weights: DataFrame, factor: DataFrame, over: str, to: str, k: int) -> DataFrame:
    """(to, f): for each value of ``to`` the sum of weight times ``factor`` (over, f) over the entries."""
    met = weights.join(factor, over)
    sums = met.groupBy(to).agg(*[F.sum(F.col("weight") * F.get("f", F.lit(i))).alias(f"f{i}") for i in range(k)])
    return sums.select(to, F.array(*[F.col(f"f{i}") for i in range(k)]).alias("f"))


def turned(factor: DataFrame, key: str, m: np.ndarray, *carry: str) -> DataFrame:
    """``factor`` (key, f) with f times the matrix ``m``."""
    column = lambda j: sum((F.get("f", F.lit(i)) * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0))
    return factor.select(key, *carry, F.array(*[column(j) for j in range(m.shape[1])]).alias("f"))


def gram(factor: DataFrame, k: int, *more: Column) -> np.ndarray | tuple[np.ndarray, list]:
    """The k by k products of a factor's columns, and what ``more`` aggregates give, in one pass."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = factor.agg(*[F.sum(F.get("f", F.lit(i)) * F.get("f", F.lit(j))).alias(f"s{i}_{j}") for i, j in pairs], *more).first()
    out = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s or 0.0
    return (out, list(sums)[len(pairs) :]) if more else out


@dataclass
class Singular:
    """values: the leading singular values; units: (unit_id, f), terms: (id, term, f), the left and right vectors."""

    values: np.ndarray
    units: DataFrame
    terms: DataFrame


def singular(weights: DataFrame | Matrix, k: int, more: int = 6, steps: int = 4, seed: int = 42, centred: bool = False) -> Singular:
    """The leading ``k`` singular values and vectors of a matrix, or of ``weights`` (unit_id, term, weight), by a randomised range finder with power steps.

    If ``centred`` the matrix is less its column means, so these are the principal components.
    The means are taken off the products and never off the matrix, which stays sparse.

    The range of ``k + more`` random signs, drawn by a hash of each term, goes through the matrix and its transpose
    ``steps`` times and is made orthonormal after each, from its Gram matrix. The largest entry of each right vector is positive.
    """
    a = matrix_from(weights) if isinstance(weights, DataFrame) else weights
    n, means = k + more, None
    number = lambda i: F.get("f", F.lit(i))

    def off(f: DataFrame, n: int) -> list[float]:
        """What the means of all columns give."""
        if not centred:
            return [0.0] * n
        nonlocal means
        if means is None:
            sums = _and_back(a, a.terms.select("id", _array(0)), 0, [], True)
            means = written(sums.where("id >= 0").select("id", (number(0) / a.n_units).alias("mean")), "means")
        return [x or 0.0 for x in f.join(means, "id").agg(*[F.sum(number(i) * F.col("mean")) for i in range(n)]).first()]

    signs = [F.when(F.xxhash64("term", F.lit(seed), F.lit(i)) % 2 == 0, 1.0).otherwise(-1.0) for i in range(n)]
    now = a.terms.select("id", F.array(*signs).alias("f"))
    before = None
    for _ in range(steps):
        there = whole = written(_and_back(a, now, n, off(now, n), centred), "range")
        if before is not None:
            dropped(before)
        before = whole
        if centred:
            sums = whole.where("id = -1").first()
            sums = sums["f"] if sums else [0.0] * n
            there = whole.select("id", _array(n, lambda i: number(i) - number(n) / a.n_units * sums[i]))  # noqa: B023
        there = there.where("id >= 0")
        values, vectors = np.linalg.eigh(gram(there, n))
        good = values > max(values.max(initial=0), 0) * 1e-24
        n = int(good.sum())
        if not n:
            return Singular(np.zeros(0), a.units.select("unit_id", _array(0)).limit(0), a.terms.select("id", "term", _array(0)).limit(0))
        now = turned(there, "id", vectors[:, good] / np.sqrt(values[good]))
    seen = written(_over(a, now, n, off(now, n)), "seen")
    values, vectors = np.linalg.eigh(gram(seen, n))
    order = np.argsort(-values)[:k]
    order = order[values[order] > max(values.max(initial=0), 0) * 1e-12]
    sigma = np.sqrt(values[order])
    terms = written(turned(now, "id", vectors[:, order]).join(a.terms.select("id", "term"), "id"), "terms")
    size = lambda j: F.max_by(F.get("f", F.lit(j)), F.struct(F.round(F.abs(F.get("f", F.lit(j))), 12).alias("a"), "term"))
    largest = terms.agg(*[size(j) for j in range(len(order))]).first() if len(order) else []
    sign = np.array([-1.0 if (x or 0) < 0 else 1.0 for x in largest])
    return Singular(sigma, turned(seen, "unit_id", vectors[:, order] * sign / sigma), turned(terms, "id", np.diag(sign), "term"))


def svd(rows: DataFrame, k: int = 2, **settings) -> DataFrame:  # noqa: ANN003
    """(unit_id, components): the projections of each unit on the first ``k`` right singular vectors of the TF-IDF matrix, which is not centred."""
    found = singular(matrix_of(rows), k, **settings)
    made = turned(found.units, "unit_id", np.diag(found.values)).withColumnRenamed("f", "components")
    return rows.select("unit_id").join(made, "unit_id", "left").select("unit_id", F.coalesce("components", F.array(*[F.lit(0.0)] * len(found.values))).alias("components"))


def principal(rows: DataFrame, k: int = 2, **settings) -> DataFrame:  # noqa: ANN003
    """(unit_id, components): the first ``k`` principal components of each unit's TF-IDF vector, over all terms."""
    found = singular(matrix_of(rows), k, centred=True, **settings)
    return turned(found.units, "unit_id", np.diag(found.values)).withColumnRenamed("f", "components")


def _started(found: Singular, mean: float) -> tuple[DataFrame, DataFrame]:
    """(units, terms) to begin nonnegative factors from: of each pair of singular vectors the larger of the positive and negative parts,
    zeros filled with the mean of the matrix."""
    k = len(found.values)
    part = lambda i, s: F.greatest(s * F.get("f", F.lit(i)), F.lit(0.0))
    norms = lambda df: df.agg(*[F.sqrt(F.sum(part(i, s) * part(i, s))) for i in range(k) for s in (1.0, -1.0)]).first()
    left, right = np.array(norms(found.units), float).reshape(k, 2), np.array(norms(found.terms), float).reshape(k, 2)

    def begun(df: DataFrame, keys: list[str], own: np.ndarray) -> DataFrame:
        out: list[Column] = []
        for i, sigma in enumerate(found.values):
            if i == 0:
                made = float(np.sqrt(sigma)) * F.abs(F.get("f", F.lit(0)))
            else:
                side = int(left[i, 1] * right[i, 1] > left[i, 0] * right[i, 0])
                both = left[i, side] * right[i, side]
                made = part(i, (1.0, -1.0)[side]) * float(np.sqrt(sigma * both) / max(own[i, side], 1e-300))
            out.append(F.when(made < 1e-6, mean).otherwise(made))
        return df.select(*keys, F.array(*out).alias("f"))

    return begun(found.units, ["unit_id"], left), begun(found.terms, ["id"], right)


def _updated(factor: DataFrame, key: str, against: DataFrame, m: np.ndarray, k: int) -> DataFrame:
    """(key, f, met): factor * against / (factor m), and the sum of the new factor times against."""
    own = lambda i: F.get(factor["f"], F.lit(i))
    to = lambda i: F.coalesce(F.get("to", F.lit(i)), F.lit(0.0))
    below = lambda i: sum((own(j) * float(m[j, i]) for j in range(k)), F.lit(0.0))
    met = factor.join(against.withColumnRenamed("f", "to"), key, "left")
    made = met.select(key, F.array(*[own(i) * to(i) / F.greatest(below(i), F.lit(1e-12)) for i in range(k)]).alias("f"), "to")
    return made.select(key, "f", sum((F.get("f", F.lit(i)) * to(i) for i in range(k)), F.lit(0.0)).alias("met"))


def _shared(w: DataFrame, k: int) -> DataFrame:
    """(unit_id, shares): each unit's factor over its sum."""
    whole = sum((F.get("f", F.lit(i)) for i in range(k)), F.lit(0.0))
    return w.select("unit_id", F.transform("f", lambda x: x / F.greatest(F.lit(1e-12), whole)).alias("shares"))


@dataclass
class Factored:
    """units, terms: (unit_id or term, f), the nonnegative factors; frequency: (term, df) and ``n_units``, from which further units are weighed."""

    k: int
    units: DataFrame
    terms: DataFrame
    frequency: DataFrame
    n_units: int
    errors: list[float]

    def top_terms(self, top_n: int = 10) -> DataFrame:
        """(topic, term, weight, rank): the first terms of each topic; each order is taken by itself, so no task holds a vocabulary."""
        top = None
        for i in range(self.k):
            one = self.terms.select(F.lit(i).alias("topic"), "term", F.get("f", F.lit(i)).alias("weight")).orderBy(F.desc(F.round("weight", 9)), "term").limit(top_n)
            top = one if top is None else top.unionAll(one)
        if top is None:
            return self.terms.sparkSession.createDataFrame([], "topic int, term string, weight double, rank int")
        return top.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term")))  # ``top_n`` rows a topic

    def shares(self) -> DataFrame:
        return _shared(self.units, self.k)

    def transform(self, rows: DataFrame, rounds: int = 20) -> DataFrame:
        """(unit_id, shares) of further ``rows`` (unit_id, tokens): their factors against the terms' as they are. Terms that weren't there say nothing."""
        weight = F.col("count") * (F.ln((F.lit(float(self.n_units)) + 1) / (F.col("df") + 1)) + 1)
        raw = dfm(token_rel(rows)).join(self.frequency, "term").select("unit_id", "term", weight.alias("w"))
        norm = raw.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        a = raw.join(norm, "unit_id").select("unit_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
        against = written(product(a, self.terms, "term", "unit_id", self.k), "against")
        hh, w = gram(self.terms, self.k), against.select("unit_id", F.array(*[F.lit(1.0 / max(1, self.k))] * self.k).alias("f"))
        for n in range(rounds):
            w = _updated(w, "unit_id", against, hh, self.k).select("unit_id", "f")
            if n % 5 == 4:  # else the plan grows with the rounds
                w = written(w, "factor")
        return _shared(w, self.k)


def _both(m: Matrix, w: DataFrame, h: DataFrame, hh: np.ndarray, k: int) -> DataFrame:
    """One pass of both updates: (unit_id, f0, ..., met), the new factor of each unit and the sum of it times what it is set against; and
    (id, f0, ...), what each term's factor is set against then."""
    scaled = m.scaled
    kind = m.units.schema["unit_id"].dataType.simpleString()
    units = m.units.select("block", "unit_id").join(w, "unit_id")
    at = lambda i: F.get("f", F.lit(i)).alias(f"f{i}")
    sent = _sent(m, h, k).withColumn("unit_id", F.lit(None).cast(kind)).unionByName(units.select("block", "unit_id", *[at(i) for i in range(k)]), allowMissingColumns=True)

    def what(units: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(units):
            return _rows({"unit_id": units["unit_id"], "id": pa.array([], pa.int64()), "met": np.zeros(0)}, np.zeros((0, k)))
        b = _Block(units, sent, k, scaled)
        own = sent.filter(pc.is_null(sent["at"])).combine_chunks()
        place = pc.index_in(b.unit_id, own["unit_id"].combine_chunks()).to_numpy()
        old = np.stack([own[f"f{i}"].to_numpy() for i in range(k)], axis=1)[place]
        to = b.over()
        new = old * to / np.maximum(old @ hh, 1e-12)
        id_, none = pa.array(b.id), lambda n, kind: pa.nulls(n, kind)
        one = _rows({"unit_id": b.unit_id, "id": none(b.many, pa.int64()), "met": (new * to).sum(axis=1)}, new)
        return pa.concat_tables([one, _rows({"unit_id": none(len(id_), b.unit_id.type), "id": id_, "met": none(len(id_), pa.float64())}, b.back(new))])

    return _passed(m, sent, what, f"unit_id {kind}, id bigint, met double{_columns(k)}")


def factored(rows: DataFrame, k: int = 4, iterations: int = 20, tolerance: float = 1e-4, seed: int = 42) -> Factored:
    """Nonnegative factors of the TF-IDF matrix of ``rows`` (unit_id, tokens), and the reconstruction error after each round.

    Multiplicative updates from singular vectors. They end when ten rounds bring the error down by less than ``tolerance``
    of what it was at the start. Units without tokens take no part.
    """
    a = matrix_of(rows)
    a.units = a.units.where(F.size("ids") > 0)
    frequency = a.terms.select("term", "df")
    of_each = _over(a, a.terms.select("id", F.array(F.lit(1.0)).alias("f")), 1, [0.0])
    n_units, total = of_each.agg(F.count("*"), F.sum(F.get("f", F.lit(0)))).first()
    n_terms, square = a.terms.count(), float(n_units)  # each unit has length one
    empty = F.array().cast("array<double>").alias("f")
    if not n_units:
        return Factored(0, a.units.select("unit_id", empty), a.terms.select("term", empty), frequency, rows.count(), [])
    found = singular(a, min(k, n_units, n_terms), seed=seed)
    k = len(found.values)
    w, h = (written(x, "factor") for x in _started(found, total / (n_units * n_terms)))
    hh, errors, before = gram(h, k), [], None
    for _ in range(iterations):
        then = written(_both(a, w, h, hh, k), "factor")
        new = then.where(F.col("id").isNull())
        dropped(w if before is None else before)
        before, w = then, new.select("unit_id", _array(k))
        ww, (met,) = gram(new.select(_array(k), "met"), k, F.sum("met"))
        errors.append(float(np.sqrt(max(0.0, square - 2 * met + float((ww * hh).sum())))))
        if len(errors) > 10 and (errors[-11] - errors[-1]) < tolerance * errors[0]:
            break
        sums = then.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(k)])
        then = written(_updated(h, "id", sums.select("id", _array(k)), ww, k).select("id", "f"), "factor")
        dropped(h)
        h = then
        hh = gram(h, k)
    return Factored(k, w, h.join(a.terms.select("id", "term"), "id").select("term", "f"), frequency, a.n_units, errors)


def nmf(rows: DataFrame, k: int = 4, iterations: int = 20, tolerance: float = 1e-4, top_n: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame, list[float]]:
    """Topic terms, units with their shares, and the errors, of ``factored``."""
    made = factored(rows, k, iterations, tolerance, seed)
    return made.top_terms(top_n), made.shares(), made.errors
