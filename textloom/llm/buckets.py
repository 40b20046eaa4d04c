"""Comparison of all rows that share a bucket, whatever its size.

Rows come with a bucket of two 64-bit numbers, a name ``rep`` and a packed payload. A bucket
beyond ``block`` rows is cut into blocks by a hash, and every pair of its blocks is a comparison of
its own; so no task holds a whole hot bucket and none is left out. A comparison emits a
spanning set of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written

_BUCKET = ["b1", "b2"]
_PAIR = [*_BUCKET, "i", "j"]


def roots(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the numbers 0 .. n-1 the one of least ``order`` that links (a[k], b[k]) lead to."""
    by_rank = np.argsort(order, kind="stable")
    low = np.empty(len(order), np.int64)
    low[by_rank] = np.arange(len(order))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[by_rank[new]])
        if (new == low).all():
            return by_rank[low]
        low = new


def packed_rows(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as rows of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the bucket and the pair of blocks; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _PAIR])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(batch)]
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(cuts, cuts[1:]):
            held.append(batch.slice(start, end - start))
            if end < len(batch):
                if len(held) > 1 or end - start > 1:
                    yield pa.Table.from_batches(held)
                held = []
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def linked(rows: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], block: int = 1000, seed: int = 5) -> DataFrame:
    """(rep, root, links) of the rows that link in some bucket.

    ``rows``: b1, b2, rep (long), copies (long), payload (binary), extra (binary), t (int). ``compare`` takes the rows
    of two blocks, and which of them are the left and the right ones (the same for a block with
    itself), and returns linked rows a and b and whether the pair counts. links adds up the copies
    of the partners over the pairs that count.
    """
    sizes = rows.groupBy(*_BUCKET).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = written(sizes.select(*_BUCKET, F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    dealt = (
        rows.join(hot, _BUCKET, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("parts")).cast("int"))
        .withColumn("pair", F.explode(pairs))
        .select(*_BUCKET, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "t", "block", "rep", "copies", "payload", "extra")
        .repartition(*_PAIR)
        .sortWithinPartitions(*_PAIR)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            table = table.combine_chunks()
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            of = table["block"].to_numpy()
            left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
            if not len(left) or not len(right) or len(table) < 2:
                continue
            a, b, counts = compare(table, left, right)
            if not len(a):
                continue
            rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
            root = rep[roots(rep, a, b)]
            links = np.bincount(a[counts], copies[b[counts]], len(rep))
            if i != j:
                links += np.bincount(b[counts], copies[a[counts]], len(rep))
            some = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], ["rep", "root", "links"])

    return dealt.mapInArrow(run, "rep bigint, root bigint, links bigint")
