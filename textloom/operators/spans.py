"""Intervals of one text: which of them overlap, and which are kept of those that nearly coincide."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(spans: DataFrame, bars: DataFrame, key: str = "unit_id") -> DataFrame:
    """``spans`` (key, start, end, ...) with bar_start and bar_end: of the bars of the same key that a span overlaps, the one
    that reaches furthest (of equal ones the first to begin), or null. Intervals are half open; empty ones overlap nothing.

    One sweep instead of pairs. A bar overlaps a span just if it begins before the span ends and ends after the span begins;
    so of the bars that begin before a span's end only the furthest end matters. Bars are passed
    at their beginnings and spans at their ends, in one sorted pass over each key, whatever overlaps what.
    """
    whole = lambda df: df.where(F.col("start") < F.col("end"))
    place = F.struct(F.col("end"), (-F.col("start")).alias("low"))
    none = F.lit(None)
    asked = spans.select(F.col(key).alias("_key"), F.col("end").alias("_at"), F.lit(0).alias("_bar"), none.cast("struct<end:bigint,low:bigint>").alias("_far"), F.struct(*spans.columns).alias("_span"))
    passed = whole(bars).select(
        F.col(key).alias("_key"), F.col("start").alias("_at"), F.lit(1).alias("_bar"), place.cast("struct<end:bigint,low:bigint>").alias("_far"),
        none.cast(asked.schema["_span"].dataType).alias("_span"),
    )
    # at one place spans come first: a bar that begins where a span ends doesn't overlap it
    order = Window.partitionBy("_key").orderBy("_at", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionAll(passed).withColumn("_far", F.max("_far").over(order)).where("_bar = 0")
    over = (F.col("_far.end") > F.col("_span.start")) & (F.col("_span.start") < F.col("_span.end"))
    return met.select("_span.*", F.when(over, -F.col("_far.low")).alias("bar_start"), F.when(over, F.col("_far.end")).alias("bar_end"))


class _Kept:
    """Spans kept so far, found by their length and place.

    Spans whose Jaccard index is ``least`` or more differ in length by a factor of 1/least at most and in place by a part of the
    length; so classes of length and cells of place as wide as the length leave a few cells to look at. Kept spans are far from one
    another, so a cell holds few of them, however many spans were offered.
    """

    def __init__(self, least: float) -> None:
        self.least, self.base = least, math.log(1 / least) if least < 1 else 1.0
        self.cells: dict[tuple[int, int], list[tuple[int, int, int, object]]] = defaultdict(list)
        self.hashes: dict[str, tuple[int, object]] = {}
        self.n = 0

    def like(self, start: int, end: int, digest: str | None) -> object | None:
        """The kept one of highest priority that has the same digest or nearly the same place."""
        found = [self.hashes[digest]] if digest is not None and digest in self.hashes else []
        if end > start:
            size = end - start
            reach = size * (1 / self.least - 1)
            own = math.floor(math.log(size) / self.base + 1e-9)
            for k in (own - 1, own, own + 1):
                wide = math.exp(k * self.base)
                for cell in range(math.floor((start - reach) / wide), math.floor((start + reach) / wide) + 1):
                    for n, s, e, name in self.cells.get((k, cell), ()):
                        both = min(end, e) - max(start, s)
                        if both > 0 and both >= self.least * (size + e - s - both) - 1e-9:
                            found.append((n, name))
        return min(found, key=lambda x: x[0])[1] if found else None

    def put(self, name: object, start: int, end: int, digest: str | None) -> None:
        if digest is not None:
            self.hashes.setdefault(digest, (self.n, name))
        if end > start:
            k = math.floor(math.log(end - start) / self.base + 1e-9)
            self.cells[k, math.floor(start / math.exp(k * self.base))].append((self.n, start, end, name))
        self.n += 1


def representatives(chunks: DataFrame, keys: Sequence[str], least: float = 0.8) -> DataFrame:
    """(keys, chunk_id, representative): each chunk with the chunk that is kept for it, or itself if it is kept.

    ``chunks``: the keys (such as query, document and revision), chunk_id, score, rank, start, end, content_hash. Within a
    key chunks are taken by (-score, rank, chunk_id), nulls last; one goes if a kept one has its content hash, or a span
    whose Jaccard index with its own is ``least`` or more. Nothing is compared across keys. Chunks stream in order; only
    what is kept of the key at hand is in memory, and each chunk looks at a few cells of it. Null and empty spans and null
    hashes are like nothing.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("least must be from 0.5 to 1")
    names = [*keys, "chunk_id"]
    given = chunks.select(*names, "start", "end", "content_hash", "score", "rank")
    order = [*[F.asc(k) for k in keys], F.desc_nulls_last("score"), F.asc_nulls_last("rank"), F.asc("chunk_id")]
    streamed = given.repartition(*keys).sortWithinPartitions(*order).select(*names, "start", "end", "content_hash")
    kind = given.schema["chunk_id"].dataType.simpleString()
    shape = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, _Kept(least)
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            out = []
            for row in zip(*columns):
                key, (name, start, end, digest) = row[: len(keys)], row[len(keys) :]
                if key != last:
                    last, kept = key, _Kept(least)
                start, end = start or 0, start or 0 if end is None or start is None else end
                found = kept.like(start, end, digest)
                if found is None:
                    kept.put(name, start, end, digest)
                out.append(name if found is None else found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, batch.column(len(keys)).type)], [*names, "representative"])

    return streamed.mapInArrow(run, f"{shape}, representative {kind}")
