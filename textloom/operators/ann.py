"""Approximate nearest vectors by an inverted-file index, and how much of the exact result it finds.

Coarse centroids come from a bounded, hashed sample of the vectors (``sample`` rows at most reach the driver); every vector
is then given to its nearest centroid's cell, and its residual is stored with one byte a dimension. A search scores
the codes of the cells nearest to each query, keeps the best ``k * wide`` of these and ranks them by their whole vectors. Scores are
cosines: vectors are scaled to length one first, zero and null ones are left out.

The number of cells looked at is set on the sample: the fewest that find ``recall`` of the sample's own exact neighbours.
Cells may be of any size: a cell is stored and searched in blocks of ``block`` rows, so a hot one is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.retrieval import top
from textloom.tables import written


@dataclass
class Index:
    """``cells``: (cell, block, chunk_id, code); ``vectors``: (chunk_id, v) of length one; centroids and the step of a code in each dimension."""

    cells: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    step: np.ndarray
    probe: int


def _unit(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the commonest use: which have a direction, and these scaled to length one."""
    size = max((len(v) for v in values if v), default=0)
    fits = np.array([bool(v) and len(v) == size and all(x is not None for x in v) for v in values], bool)
    x = np.array([v for v, ok in zip(values, fits) if ok], np.float64).reshape(int(fits.sum()), size)
    long = np.sqrt((x * x).sum(axis=1)) if size else np.zeros(0)
    good = np.isfinite(long) & (long > 0)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, x[good] / long[good, None]


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of length one by k-means on cosines; an empty one takes the vector that fits worst."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ c.T
        of, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        for empty in np.flatnonzero(np.bincount(of, minlength=k) == 0):
            worst = int(best.argmin())
            sums[empty], best[worst] = x[worst], np.inf
        long = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(long > 0, sums / np.maximum(long, 1e-12), c)
    return c


def build(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, recall: float = 0.97, k: int = 10, block: int = 4096, seed: int = 11) -> Index:
    """An index of all of ``vectors`` (chunk_id long, embedding). Without ``cells`` there are about as many as the root of the rows."""
    given = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = _unit(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), pa.array(list(x), pa.list_(pa.float64()))], ["chunk_id", "v"])

    unit = written(given.mapInArrow(scaled, "chunk_id bigint, v array<double>"), "vectors")
    n = unit.count()
    drawn = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1_000_000))
    few = unit.where(drawn < 1_000_000 * sample * 2 // max(1, n) + 1).orderBy(drawn, "chunk_id").limit(sample).select("v").toArrow()["v"].to_pylist()
    x = np.array(few, np.float64)
    if not len(x):
        return Index(unit.select(F.lit(0).alias("cell"), F.lit(0).alias("block"), "chunk_id", F.lit(b"").alias("code")), unit, np.zeros((1, 1)), np.ones(1), 1)
    wanted = min(len(x), cells or max(1, round(n**0.5)), max(1, len(x) // 8))
    centroids = _lloyd(x, wanted, 12, seed)
    step = np.maximum(np.abs(x - centroids[(x @ centroids.T).argmax(axis=1)]).max(axis=0), 1e-9) / 127

    # the fewest cells that hold the wanted part of the exact neighbours of the first rows, among the sample
    asked = x[: min(256, len(x))]
    exact = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(wanted)[None, :].repeat(len(asked), axis=0), axis=1)
    needs = np.sort(np.take_along_axis(place, (x @ centroids.T).argmax(axis=1)[exact], axis=1).ravel())
    probe = int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)]) + 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
            if not len(v):
                continue
            cell = (v @ centroids.T).argmax(axis=1)
            code = np.clip(np.rint((v - centroids[cell]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "chunk_id", "code"])

    rows = unit.mapInArrow(coded, "cell int, chunk_id bigint, code binary")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row a cell
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    return Index(written(dealt.select("cell", "block", "chunk_id", "code"), "cells"), unit, centroids, step, probe)


def search(index: Index, queries: DataFrame, k: int, least: float = -1.0, allowed: DataFrame | None = None, probe: int | None = None, wide: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``k`` by (-score, chunk_id), among the cells nearest to each of ``queries`` (query_id, q).

    ``allowed`` (chunk_id): only these are found; the list is applied before the best are kept. Cells without allowed rows are passed over, and
    more cells are looked at until they hold as many allowed rows as the usual number of cells holds rows, so a short list is searched more widely.
    """
    centroids, step, looked = index.centroids, index.step, min(len(index.centroids), probe or index.probe)
    rows = index.cells if allowed is None else index.cells.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    held = np.zeros(len(centroids), np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a cell
        held[r["cell"]] = r["n"]
    every = index.vectors.count() if allowed is not None else int(held.sum())
    wanted = every * looked // len(centroids)
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = _unit(batch.column(1).to_pylist())
            if not len(x) or x.shape[1] != centroids.shape[1]:
                continue
            ids = batch.column(0).filter(pa.array(fits))
            cell = np.argsort(-(x @ centroids.T), axis=1, kind="stable")
            some = held[cell] > 0
            before = np.cumsum(held[cell], axis=1) - held[cell]
            taken = some & ((np.cumsum(some, axis=1) <= looked) | (before < wanted))
            query, place = np.nonzero(taken)
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays([pa.array(cell[query, place].astype(np.int32)), ids.take(at), pa.array(list(x), pa.list_(pa.float64())).take(at)], ["cell", "query_id", "q"])

    probes = asked.mapInArrow(nearest, "cell int, query_id bigint, q array<double>")
    blocks = rows.select("cell", "block").distinct()
    most = k * wide

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, codes = b["chunk_id"].to_numpy(), b["code"].to_pylist()
        none = {"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())}
        if not len(a) or not len(ids):
            return pa.table(none)
        c = np.frombuffer(b"".join(codes), np.int8).reshape(len(ids), -1) * step + centroids[a["cell"][0].as_py()]
        near = np.array(a["q"].to_pylist(), np.float64) @ c.T
        taken = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(ids) else np.arange(len(ids))[None, :].repeat(len(near), axis=0)
        return pa.table({"query_id": np.repeat(a["query_id"].to_numpy(), taken.shape[1]), "chunk_id": ids[taken.ravel()], "near": np.take_along_axis(near, taken, axis=1).ravel()})

    stored = rows.select(F.col("cell").alias("own_cell"), F.col("block").alias("own_block"), "chunk_id", "code")
    found = probes.join(blocks, "cell").groupBy("cell", "block").cogroup(stored.groupBy("own_cell", "own_block")).applyInArrow(best, "query_id bigint, chunk_id bigint, near double")
    few = top(found.select("query_id", "chunk_id", F.col("near").alias("score")), most).select("query_id", "chunk_id")
    exact = few.join(index.vectors, "chunk_id").join(asked, "query_id")
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scored = exact.select("query_id", "chunk_id", F.round(total(F.col("v"), F.col("q")) / F.sqrt(total(F.col("q"), F.col("q"))), 9).alias("score"))
    return top(scored.where(F.col("score") >= least), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the part of each query's exact result that was found; of an empty one all was."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
