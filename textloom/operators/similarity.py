"""Similarity and duplicates of units, and of vectors."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import checksum, normalized
from textloom.operators.relations import ratio, running
from textloom.tables import written


def unit_tfidf(matrix: DataFrame, n_units: int) -> DataFrame:
    """(unit_id, term, weight): smoothed TF-IDF with rows of length one."""
    frequency = matrix.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("count") * (F.ln((F.lit(float(n_units)) + 1) / (F.col("df") + 1)) + 1)
    raw = matrix.join(frequency, "term").withColumn("w", weight)
    norm = raw.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "unit_id").select("unit_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def pairwise(weights: DataFrame, min_score: float, top_k: int | None = None) -> DataFrame:
    """(i, j, score) of units by dot product of vectors of length one; i < j, by (-score, i, j).

    Exact, by the whole products of blocks of units (``dot_pairs``).
    """
    weights = written(weights, "weights")  # read twice
    common = weights.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    ranked = written(running(common, [F.col("df"), F.col("term")], {"rank": F.lit(1)}), "ranked")
    one = F.struct(F.col("rank").cast("int").alias("id"), "weight")
    units = weights.join(ranked, "term").groupBy("unit_id").agg(F.sort_array(F.collect_list(one)).alias("x"))  # one unit's terms
    scores = dot_pairs(units.select("unit_id", F.col("x.id").alias("ids"), F.col("x.weight").alias("values"), F.lit(1.0).alias("norm")), ranked, min_score)
    return scores.orderBy(F.desc("score"), "i", "j").limit(top_k) if top_k else scores


def dot_pairs(units: DataFrame, ranked: DataFrame, min_score: float, n_units: int | None = None, most: int = 1 << 24) -> DataFrame:
    """(i, j, score) of ``units`` (unit_id, ids, values, norm) by dot product, at or over the score; i < j. ``ranked`` (df, rank) has the
    terms that more than one unit has, and ids are their ranks, the rarest first, in order.

    An entry is value over norm, with ``n_units`` times the term's inverse unit frequency too: counts take less room than weights. Blocks of
    units meet as arrays: the terms that a sixteenth of all units have as one product of two matrices, the others by their places. So the dot
    products are whole and exact, and no pair is a row before it is found.
    """
    levels = ranked.groupBy("df").agg(F.max("rank").alias("upto")).orderBy("df").collect()  # at most the root of twice the entries
    df, upto = (np.array([r[k] for r in levels], np.int64) for k in (0, 1))
    idf = np.ones(len(df)) if n_units is None else np.log((n_units + 1) / (df + 1)) + 1
    total = units.count()
    often = max(int(upto[df * 16 < total].max(initial=0)), int(upto.max(initial=0)) - 4096)  # ids above are of matrices

    def compare(t: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        starts, ids = _lists(t["ids"])
        row = np.repeat(np.arange(len(t)), np.diff(starts))
        weights = _lists(t["values"])[1] * idf[np.searchsorted(upto, ids)] / t["norm"].to_numpy()[row]
        hot = np.flatnonzero(ids > often)
        many = np.diff(starts) - np.bincount(row[hot], minlength=len(t))
        used, at = np.unique(ids[hot], return_inverse=True)
        x = np.zeros((len(t), len(used)))
        x[row[hot], at] = weights[hot]
        other = np.ascontiguousarray(x[right].T)
        same = len(left) == len(right) and left[0] == right[0]
        for i, j, score in _met(starts, ids, many, left, right, weights, lambda some: x[some] @ other, min_score):
            once = i < j if same else slice(None)
            yield i[once], j[once], score[once]

    return _block_pairs(units.where(F.size("ids") > 0).withColumn("n", F.size("ids")), compare, 0.0, most)


def _lists(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(where each list begins and the last ends, all values) of a column of lists."""
    x = x.combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    starts = np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return starts, x.flatten().to_numpy(zero_copy_only=False)


def _block_pairs(units: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], min_share: float, most: int) -> DataFrame:
    """(i, j, score) of what ``compare`` finds among ``units`` (unit_id, n, ids, ...); i < j.

    Units are dealt by size ``n`` into blocks of about ``most`` ids, and each two blocks whose sizes are near enough by
    ``min_share`` are one task. ``compare`` gets their rows and which of them are of the one and of the other block, and yields
    the rows of pairs and their scores; of a block against itself either order will do.
    """
    units = written(units, "units")
    total = units.agg(F.sum(F.size("ids"))).first()[0] or 0
    each = max(1, min(most, total // 8))
    dealt = written(running(units, [F.col("n"), F.col("unit_id")], {"upto": F.size("ids").cast("long")}).withColumn("k", F.floor((F.col("upto") - 1) / each)).drop("upto"), "dealt")
    blocks = dealt.groupBy("k").agg(F.min("n").alias("least"), F.max("n").alias("largest"))
    a, b = blocks.toDF("a", "least_a", "largest_a"), blocks.toDF("b", "least_b", "largest_b")
    met = a.join(b, (F.col("a") <= F.col("b")) & (F.col("largest_a") >= F.col("least_b") * min_share - 1e-9)).select("a", "b")
    of = met.select(F.col("a").alias("k"), "a", "b").unionAll(met.where("a < b").select(F.col("b").alias("k"), "a", "b"))
    kind = units.schema["unit_id"].dataType.simpleString()

    def near(t: pa.Table) -> pa.Table:
        k, one, other = t["k"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
        left, right = np.flatnonzero(k == one), np.flatnonzero(k == other)
        x, y, score = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *compare(t, left, right)))
        ids = t["unit_id"].combine_chunks()
        i, j = ids.take(pa.array(x)), ids.take(pa.array(y))
        turned = pc.greater(i, j)
        return pa.table({"i": pc.if_else(turned, j, i), "j": pc.if_else(turned, i, j), "score": pa.array(score)})

    return dealt.join(F.broadcast(of), "k").groupBy("a", "b").applyInArrow(near, f"i {kind}, j {kind}, score double")  # a row for each two blocks


def _met(
    starts: np.ndarray, ids: np.ndarray, many: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray | None = None,
    beside: Callable[[np.ndarray], np.ndarray] | None = None, least: float = 0.0,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the left, rows of the right, what they share) of rows that share one of their first ``many`` ids: how many, or the sum
    of the products of their weights. Some rows of the left are met with all of the right at once. ``beside`` gives what such rows share
    with all of the right in other ids; with it, all rows meet. What is below ``least`` is left out."""

    def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = many[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        return owner, np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    owner, at = firsts(right)
    order = np.argsort(ids[at], kind="stable")
    owner, at = owner[order], at[order]
    known, begin, many_of = np.unique(ids[at], return_index=True, return_counts=True)
    if not len(right) or (beside is None and not len(known)):
        return
    asks, entry = firsts(left)
    if len(known):
        place = np.minimum(np.searchsorted(known, ids[entry]), len(known) - 1)
        hit = known[place] == ids[entry]
        asks, entry, place = asks[hit], entry[hit], place[hit]
    else:
        asks = entry = place = asks[:0]
    width, rows = len(right), max(1, (1 << 22) // len(right))
    bounds = np.searchsorted(asks, np.arange(0, len(left) + rows, rows))
    for n, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
        if s == e and beside is None:
            continue
        size = many_of[place[s:e]]
        upto = np.cumsum(size)
        shared = np.zeros(rows * width, np.int64 if weights is None else np.float64)
        if beside is not None:
            some = beside(left[n * rows : (n + 1) * rows])
            shared[: some.size] = some.ravel()
        while s < e:  # about four million meetings at once
            stop = max(1, int(np.searchsorted(upto, (1 << 22) + (0 if not len(upto) else upto[0] - size[0]), "right")))
            now = size[:stop]
            index = np.repeat(begin[place[s : s + stop]] - (np.cumsum(now) - now), now) + np.arange(int(now.sum()))
            cell = np.repeat((asks[s : s + stop] - n * rows) * width, now) + owner[index]
            shared += np.bincount(cell, None if weights is None else np.repeat(weights[entry[s : s + stop]], now) * weights[at[index]], rows * width).astype(shared.dtype, copy=False)
            size, upto, s = size[stop:], upto[stop:], s + stop
        cells = np.flatnonzero(shared >= least if least > 0 else shared)
        yield left[cells // width + n * rows], right[cells % width], shared[cells]


def jaccard_pairs(matrix: DataFrame, min_score: float, counted: bool = False, most: int = 1 << 24) -> DataFrame:
    """(i, j, score) of units by the Jaccard index of their terms; i < j. ``counted``: of multisets, by ``count``.

    Exact, by prefix filtering: two sets can reach the score only if they share one of the rarest
    size - ⌈score · size⌉ + 1 terms of each. What they share of these is counted; beyond the prefix that ends first, they can share no more
    than is left of that set, and few pairs pass this. These are compared whole. Blocks of units of near sizes meet as arrays of
    numbers (``_block_pairs``), so no pair is a row before it is found. Terms of one unit alone are counted but not sent.
    """
    each = matrix.select("unit_id", "term", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("n")).select("unit_id", F.struct("term", "n").alias("term")) if counted else matrix.select("unit_id", "term")
    each = written(each, "elements")  # read three times
    common = each.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    ranked = running(common, [F.col("df"), F.col("term")], {"id": F.lit(1)}).select("term", F.col("id").cast("int").alias("id"))
    shared = each.join(ranked, "term").groupBy("unit_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # one unit's terms
    sized = shared.join(each.groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id")
    # what is left of the prefix after the terms that no other unit has
    first = F.least(F.col("n") - F.ceil(F.col("n") * min_score - 1e-9) + 1 - (F.col("n") - F.size("ids")), F.size("ids")).cast("int")
    units = sized.withColumn("first", first).where("first > 0")

    def compare(t: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        starts, ids = _lists(t["ids"])
        n, many = t["n"].to_numpy(), t["first"].to_numpy().astype(np.int64)
        last, rest = ids[starts[:-1] + many - 1], np.diff(starts) - many
        row = np.repeat(np.arange(len(n)), np.diff(starts))
        placed = (row << 32) + ids
        bins = np.bincount(row * 256 + ids % 256, minlength=256 * len(n)).astype(np.int32).reshape(-1, 256)
        same = len(left) == len(right) and left[0] == right[0]
        for x, y, both in _met(starts, ids, many, left, right):
            if same:
                x, y, both = x[x < y], y[x < y], both[x < y]
            turn = last[x] > last[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)  # x's prefix ends first
            least = (n[x] + n[y]) * (min_score / (1 + min_score)) - 1e-9
            enough = both + rest[x] >= least
            x, y, both, least = x[enough], y[enough], both[enough], least[enough]
            beyond = starts[y + 1] - np.searchsorted(placed, (y << 32) + last[x], "right")
            enough = both + np.minimum(rest[x], beyond) >= least
            x, y, least = x[enough], y[enough], least[enough]
            # ids of other bins aren't shared
            fits = [np.minimum(bins[x[s : s + 8192]], bins[y[s : s + 8192]]).sum(axis=1) for s in range(0, len(x), 8192)]
            enough = np.concatenate([np.zeros(0), *fits]) >= least
            x, y = x[enough], y[enough]
            both = np.array([len(np.intersect1d(ids[starts[p] : starts[p + 1]], ids[starts[q] : starts[q + 1]], True)) for p, q in zip(x, y)], np.int64)
            score = both / (n[x] + n[y] - both)
            yield x[score >= min_score], y[score >= min_score], score[score >= min_score]

    return _block_pairs(units, compare, min_score, most)


def query_scores(weights: DataFrame, query_id: Column | int) -> DataFrame:
    """(unit_id, score): every other unit against one that took part in the weights."""
    asked = weights.where(F.col("unit_id") == query_id).select("term", F.col("weight").alias("q"))
    made = weights.where(F.col("unit_id") != query_id).join(asked, "term")  # one unit's terms
    return made.groupBy("unit_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def centroids(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_key, term, mean): mean vectors; terms that a unit lacks count as 0."""
    sizes = groups.groupBy("group_key").agg(F.count("*").alias("n"))
    sums = weights.join(groups, "unit_id").groupBy("group_key", "term").agg(F.sum("weight").alias("total"))
    return sums.join(sizes, "group_key").select("group_key", "term", (F.col("total") / F.col("n")).alias("mean"))


def centroid_between(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, score): cosine of the mean vectors of each two groups."""
    c = centroids(weights, groups)
    norm = c.groupBy("group_key").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    c = c.join(norm, "group_key")
    a = c.select(F.col("group_key").alias("a"), "term", F.col("mean").alias("x"), F.col("norm").alias("na"))
    b = c.select(F.col("group_key").alias("b"), "term", F.col("mean").alias("y"), F.col("norm").alias("nb"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / (F.first("na") * F.first("nb"))).alias("score"))


def item_to_group(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(unit_id, group_key, score): cosine of each unit with its own group's mean vector."""
    c = centroids(weights, groups)
    norm = c.groupBy("group_key").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    mine = weights.join(groups, "unit_id").join(c, ["group_key", "term"]).groupBy("unit_id", "group_key").agg(F.sum(F.col("weight") * F.col("mean")).alias("dot"))
    return mine.join(norm, "group_key").select("unit_id", "group_key", (F.col("dot") / F.col("norm")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for a zero vector or unequal lengths."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    below = size(a) * size(b)
    return F.when((F.size(a) != F.size(b)) | (below == 0), 0.0).otherwise(dot / below)


def vector_pairs(vectors: DataFrame, min_score: float, block: int = 512) -> DataFrame:
    """(i, j, score) by cosine of the vectors of equal label, at or over the score; i < j.

    ``vectors``: (id long, label, v array<double>). A label's vectors are dealt into blocks, and each pair of blocks is
    one matrix product in one task, so a large label is many tasks. Zero vectors and those of other lengths have no pair.
    """
    sizes = vectors.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("k")).alias("a"), F.greatest(k, F.col("k")).alias("b")))
    dealt = vectors.where(F.size("v") > 0).join(sizes, "label").withColumn("k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.select("id", "label", "v", "k", F.explode(pairs).alias("p")).select("id", "label", "v", "k", "p.a", "p.b")

    def near(t: pa.Table) -> pa.Table:
        i, j, score = [], [], []
        a, b, k, ids = t["a"][0].as_py(), t["b"][0].as_py(), t["k"].to_numpy(), t["id"].to_numpy()
        values = t["v"].to_pylist()
        sizes = np.array([len(v) for v in values])
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            x = np.array([values[n] for n in of], np.float64)
            long = np.sqrt((x * x).sum(axis=1))
            of, x, long = of[long > 0], x[long > 0], long[long > 0]
            left, right = np.flatnonzero(k[of] == a), np.flatnonzero(k[of] == b)
            scores = x[left] @ x[right].T / long[left][:, None] / long[right][None, :]
            m, n = np.nonzero(scores >= min_score)
            p, q = ids[of[left[m]]], ids[of[right[n]]]
            once = p < q if a == b else p != q
            i.append(np.minimum(p, q)[once])
            j.append(np.maximum(p, q)[once])
            score.append(scores[m, n][once])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"i": cat(i, np.int64), "j": cat(j, np.int64), "score": cat(score, np.float64)})

    return dealt.groupBy("label", "a", "b").applyInArrow(near, "i bigint, j bigint, score double")


# --- duplicates ------------------------------------------------------------------------------


def checksum_groups(units: DataFrame, unit: str = "doc_id", text: str = "text", normal: bool = False) -> DataFrame:
    """(key, first, unit_id, count): one row for each unit whose checksum, of the text or its normal form, another has.

    ``first`` is the least unit of the group, which stands for it; so a group of any size is spread over rows.
    """
    key = checksum(normalized(F.col(text)) if normal else F.col(text))
    keyed = units.select(F.col(unit).alias("unit_id"), key.alias("key"))
    groups = keyed.groupBy("key").agg(F.min("unit_id").alias("first"), F.count("*").alias("count")).where("count >= 2")
    return keyed.join(groups, "key").select("key", "first", "unit_id", "count")


def gram_counts(units: DataFrame, n: int = 5, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """(unit_id, term, count): character n-grams of the normal form; a shorter text is one gram, an empty one has none."""

    def grams(t: Column) -> Column:
        # one pass of a look-ahead finds the grams of every place; substring would walk from the start for each
        many = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(many)

    # a one-element transform binds the normal form, which would else be made anew for each gram
    made = F.element_at(F.transform(F.array(normalized(F.col(text))), grams), 1)
    return units.select(F.col(unit).alias("unit_id"), F.explode_outer(made).alias("term")).where("term IS NOT NULL").groupBy("unit_id", "term").agg(F.count("*").alias("count"))


def size_classes(threshold: float, most: int) -> list[int]:
    """Least sizes of classes, up to one beyond ``most``: two units that reach the threshold are of one class or of neighbours."""
    least = [1]
    while least[-1] <= most:
        least.append(max(least[-1] + 1, int((least[-1] - 1) / threshold + 1e-9) + 1))
    return [*least, max(least[-1] + 1, int((least[-1] - 1) / threshold + 1e-9) + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _gram_hashes(text: str, n: int = 5) -> np.ndarray:
    """A hash of each gram (as in ``gram_counts``), repeats told apart by their number."""
    points = _code_points(text)
    many = max(len(points) - n + 1, min(len(points), 1))
    h = np.full(many, len(points) if len(points) < n else n, np.uint64)
    for k in range(min(n, len(points))):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + many])
    h.sort()
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][:many])
    return _mixed(h + (np.arange(many) - np.repeat(first, np.diff(np.r_[first, many]))).astype(np.uint64))


def _part_keys(elements: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """The keys of a unit's parts in its two windows of classes; a key's low byte is how many keys a pair must share."""
    at, out = int(np.searchsorted(least, len(elements), "right")) - 1, []
    low, high = (elements & np.uint64((1 << 32) - 1)).astype(np.float64), (elements >> np.uint64(32)).astype(np.float64)
    turned = _mixed(elements)
    for window in {max(at - 1, 0), at}:
        apart = int((1 - threshold) / (1 + threshold) * (least[window + 1] + least[window + 2] - 2) + 1e-9)
        more = min(apart // 16, 200)
        parts = apart + 1 + more
        part = (turned % np.uint64(parts)).astype(np.int64)
        # sums of fewer than 2^20 numbers of 32 bits are exact in doubles
        sums = [np.bincount(part, x, parts).astype(np.uint64) for x in (low, high)]
        key = _mixed(_mixed(sums[0] + (np.arange(parts, dtype=np.uint64) << np.uint64(40))) + sums[1] * np.uint64(3) + np.uint64(window))
        out.append(key >> np.uint64(24) << np.uint64(8) | np.uint64(more + 1))  # 40 bits: two bytes of zeros are not shuffled for long; what meets by chance is compared
    return np.concatenate(out).view(np.int64)


def _gram_score(a: str, b: str, n: int = 5) -> float:
    """The multiset Jaccard index of two texts' grams, exactly."""
    known, ids = np.unique(np.r_[_code_points(a), _code_points(b)], return_inverse=True)
    if len(known) > 6000 or min(len(a), len(b)) < n:  # five ids don't fit 63 bits, or a text is one gram
        grams = [Counter(t[i : i + n] for i in range(max(1, len(t) - n + 1))) for t in (a, b)]
        both, every = (grams[0] & grams[1]).total(), grams[0].total() + grams[1].total()
        return both / (every - both)
    codes = []
    for own in (ids[: len(a)], ids[len(a) :]):
        code = np.zeros(len(own) - n + 1, np.int64)
        for k in range(n):
            code = code * len(known) + own[k : k + len(code)]
        codes.append(np.unique(code, return_counts=True))
    _, x, y = np.intersect1d(codes[0][0], codes[1][0], assume_unique=True, return_indices=True)
    both = int(np.minimum(codes[0][1][x], codes[1][1][y]).sum())
    return both / (len(a) + len(b) - 2 * n + 2 - both)


def lexical_pairs(units: DataFrame, threshold: float = 0.85, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """(i, j, score) by the multiset Jaccard index of character 5-grams, at or over the threshold, rounded to four.

    Units of equal normal form are one, named by the least of them (``checksum_groups`` has the others);
    the pairs of different texts are complete.

    Exact, by parts: two texts that reach the threshold differ in at most (1 - threshold) / (1 + threshold) of their grams
    together. Grams are dealt into more parts than that by their hash, so some parts are the same in both; texts that share as many
    parts as they must are compared gram by gram. How many parts there are goes by windows of neighbouring
    classes of size. No gram is a row of its own, and a part holds several grams, so that other texts seldom share it.
    """
    firsts = units.groupBy(checksum(normalized(F.col(text))).alias("key")).agg(F.min(F.struct(F.col(unit).alias("u"), F.col(text).alias("t"))).alias("one"))
    texts = written(firsts.select(F.col("one.u").alias("unit_id"), normalized(F.col("one.t")).alias("text")).where("text <> ''"), "normal")  # read three times
    kind = texts.schema["unit_id"].dataType.simpleString()
    least = size_classes(threshold, 1 << 31)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                some = batch.slice(start, 64)
                keys = [_part_keys(_gram_hashes(t), threshold, least) for t in some.column(1).to_pylist()]
                of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array(np.concatenate(keys))], ["unit_id", "key"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_gram_score(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["i", "j", "score"])

    keyed = texts.mapInArrow(parts, f"unit_id {kind}, key bigint")
    met = keyed.withColumnRenamed("unit_id", "i").join(keyed.withColumnRenamed("unit_id", "j"), "key").where("i < j")
    enough = met.groupBy("i", "j").agg(F.count("*").alias("shared"), F.min(F.col("key").bitwiseAND(255)).alias("least")).where("shared >= least")
    pairs = written(enough.select("i", "j"), "pairs")  # true size for the planner
    both = pairs.join(texts.select(F.col("unit_id").alias("i"), F.col("text").alias("a")), "i").join(texts.select(F.col("unit_id").alias("j"), F.col("text").alias("b")), "j")
    scored = both.select("i", "j", "a", "b").mapInArrow(compared, f"i {kind}, j {kind}, score double").where(F.col("score") >= threshold)
    return scored.select("i", "j", F.round("score", 4).alias("score"))


_PRIME = (1 << 61) - 1


def _coefficients(num_perm: int, seed: int) -> tuple[list[int], list[int]]:
    import random

    r = random.Random(seed)
    pairs = [(r.randint(1, _PRIME - 1), r.randint(0, _PRIME - 1)) for _ in range(num_perm)]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _permuted(a: int, b: int, x: np.ndarray) -> np.ndarray:
    """The low 32 bits of a·x + b modulo 2^61 - 1, of 32-bit x, without leaving 64 bits: a is cut at its 30th bit."""
    p, n = np.uint64(_PRIME), np.uint64
    high = n(a >> 30) * x  # below 2^63
    high = (high & p) + (high >> n(61))
    # 2^31 times 2^30 is 1; the sum is below 2^63 + 2^32
    v = ((high & n((1 << 31) - 1)) << n(30)) + (high >> n(31)) + n(a & ((1 << 30) - 1)) * x + n(b)
    v = (v & p) + (v >> n(61))
    return np.where(v >= p, v - p, v) & n((1 << 32) - 1)


def minhash(num_perm: int = 64, shingle: int = 3, seed: int = 1, most: int = 1 << 14):  # noqa: ANN201
    """An Arrow function: 64 least permuted hashes of word shingles, as 32-bit numbers. About ``most`` shingles are permuted at once, of as many texts."""
    a, b = _coefficients(num_perm, seed)

    def hashes(text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        grams = {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
        return np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[:4] for g in grams), ">u4").astype(np.uint64)

    def least(some: list[np.ndarray]) -> Iterator[list[int]]:
        sizes = np.array([len(h) for h in some])
        out = np.full((len(some), num_perm), (1 << 32) - 1, np.int64)
        if sizes.any():
            x, starts = np.concatenate(some), (np.cumsum(sizes) - sizes)[sizes > 0]
            for k in range(num_perm):
                out[sizes > 0, k] = np.minimum.reduceat(_permuted(a[k], b[k], x), starts)
        yield from out.tolist()

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signature(texts: pd.Series) -> pd.Series:
        out, some, n = [], [], 0
        for text in texts:
            some.append(hashes(text))
            n += len(some[-1])
            if n >= most:
                out += least(some)
                some, n = [], 0
        return pd.Series([*out, *least(some)], dtype=object)

    return signature


def signature_classes(signatures: DataFrame) -> DataFrame:
    """(unit_id, first, signature): first is the least unit of the same signature, which stands for all of them."""
    firsts = signatures.groupBy("signature").agg(F.min("unit_id").alias("first"))
    return signatures.join(firsts, "signature").select("unit_id", "first", "signature")


def lsh_candidates(signatures: DataFrame, bands: int = 16) -> DataFrame:
    """(i, j): units whose signatures agree in a whole band but not in all; i < j.

    Units of equal signature are one, named by the least of them; ``signature_classes`` has the others.
    """
    rows = F.size("signature") / bands
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.slice("signature", (k * rows).cast("int") + 1, rows.cast("int"))).alias("key")))
    distinct = written(signatures.groupBy("signature").agg(F.min("unit_id").alias("unit_id")), "signatures")  # read twice
    keyed = distinct.select("unit_id", F.explode(cut).alias("c")).select("unit_id", "c.band", "c.key")
    a, b = keyed.withColumnRenamed("unit_id", "i"), keyed.withColumnRenamed("unit_id", "j")
    return a.join(b, ["band", "key"]).where("i < j").select("i", "j").distinct()


def estimated(pairs: DataFrame, signatures: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(i, j, score): share of equal signature places, at or over the threshold."""
    joined = pairs.join(signatures.select(F.col("unit_id").alias("i"), F.col("signature").alias("x")), "i").join(
        signatures.select(F.col("unit_id").alias("j"), F.col("signature").alias("y")), "j"
    )
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return joined.select("i", "j", ratio(same.cast("double"), F.size("x")).alias("score")).where(F.col("score") >= threshold)


def estimated_links(signatures: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(i, j, score): the pairs of ``estimated`` between the first units of all signatures, and each other unit of a signature with its first, at 1.

    Whole: two signatures that reach the threshold differ in fewer places than there are bands, so they agree in one band at least.
    """
    s = written(signatures, "signatures")  # read four times
    size = (s.select(F.size("signature").alias("n")).first() or [1])[0]
    apart = int(size * (1 - threshold) + 1e-9)
    bands = next((n for n in range(16, size) if n > apart and size % n == 0), size)
    same = signature_classes(s).where("unit_id <> first").select(F.col("first").alias("i"), F.col("unit_id").alias("j"), F.lit(1.0).alias("score"))
    return estimated(lsh_candidates(s, bands), s, threshold).unionAll(same)


def hashed_embedding(toks: Column, dims: int = 256) -> Column:
    """Bag of hashed tokens (MD5), as a vector of length one; of no tokens all zeros."""
    slot = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")

    def counts(slots: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double"))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm == 0, v).otherwise(F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), 1))

    # one-element transforms bind the slots and the counts, which would else be made anew for each dimension
    made = F.transform(F.transform(F.array(F.transform(toks, slot)), counts), unit)
    return F.element_at(made, 1)


def combined(*tiers: tuple[str, DataFrame]) -> DataFrame:
    """(i, j, score, method): the pairs of several tiers together."""
    out: DataFrame | None = None
    for name, df in tiers:
        one = df.select("i", "j", F.col("score").cast("double").alias("score"), F.lit(name).alias("method"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("no tier given")
    return out


def methods(wanted: Sequence[str] | None) -> list[str]:
    """The named tiers, checked."""
    known = ("exact", "normalized", "lexical", "minhash")
    made = list(wanted or ("exact", "normalized", "lexical"))
    if set(made) - set(known):
        raise ValueError(f"unknown methods {sorted(set(made) - set(known))}")
    return made
