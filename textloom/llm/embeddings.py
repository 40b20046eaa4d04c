"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Vectors are compared only within a label. Each table hashes a unit vector to the signs
of its products with random hyperplanes; vectors that share a bucket of any table are
compared by exact cosine in double precision. Bits follow the rows of a label, so that
a bucket holds about ``BUCKET`` unrelated vectors at any size, and tables follow the
bits, so that a pair at the threshold is missed with probability ``miss``.

Equal vectors of a label become one row first, named by two 64-bit hashes. Vectors travel packed,
once for each table; buckets too large for a task are compared block by block (``buckets``), and
a comparison emits counts and a spanning set of links, not pairs. A pair that meets in several
tables counts in the first only: the rows carry their buckets of all tables.

Defined cases: a null, empty or zero vector, one with null or non-finite components, and
one without a label link with nothing; so do vectors of different lengths. Rows with
equal ids are one vector each and share a component if they link. An empty table gives
an empty table. Other columns may have any name: only the three are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.buckets import linked, packed_rows
from textloom.llm.common import written
from textloom.llm.components import connected_components

THRESHOLD = 0.98
BUCKET = 512


def plan_tables(rows: int, threshold: float = THRESHOLD, miss: float = 1e-4) -> tuple[int, int]:
    """Bits a table and number of tables, where a row's label has so many rows."""
    bits = min(60, max(2, math.ceil(math.log2(max(2, rows) / BUCKET))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1


def _key_kind(bits: int) -> str:
    """The narrowest whole number for keys of so many bits."""
    return "<i2" if bits < 16 else "<i4" if bits < 32 else "<i8"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch], kind: str, bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Packs the last column, a vector, and adds its bucket in every table, as a list and packed."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column(len(batch.columns) - 1)
        values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.diff(vectors.offsets.to_numpy())])
        keys, sizes = np.zeros((len(vectors), tables), np.int64), np.diff(ends)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size not in planes:
                planes[size] = np.random.default_rng([seed, size]).normal(size=(size, tables * bits))
            signs = _unit(values[ends[at][:, None] + np.arange(size)]) @ planes[size] > 0
            keys[at] = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        data, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
        packed = pa.array([data[a * width : b * width] for a, b in zip(ends, ends[1:])], pa.binary())
        offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], packed, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([k.tobytes() for k in keys.astype(_key_kind(bits))], pa.binary())],
            [*batch.schema.names[:-1], "payload", "keys", "extra"],
        )


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, kind: str, key_kind: str, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at the threshold or over it, and whether this table is the first in which they meet."""
    x = _unit(packed_rows(table["payload"].chunk(0), kind))
    near = x[left] @ x[right].T >= threshold
    if len(left) == len(right) and (left == right).all():
        np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    keys = packed_rows(table["extra"].chunk(0), key_kind)
    earlier = slice(0, table["t"][0].as_py())
    return a, b, (keys[a, earlier] != keys[b, earlier]).all(axis=1)


def vector_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, miss: float = 1e-4, block: int = 1000, seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    single = "array<float>" in vectors.schema[vector_col].dataType.simpleString()
    kind = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"), F.col(label_col).alias("label")
    )
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False)
    )
    # two numbers: how many rows share a row's label, on average over rows
    n = vectors.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col)).agg(F.count("*").cast("double").alias("n"))
    mean = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    bits, tables = plan_tables(int(mean or 1), threshold, miss)
    # equal vectors of a label are one row, named by hashes that all of them can compute
    named = rows.select("id", "vector", "label", F.when(usable, F.xxhash64("label", "vector")).alias("h1"), F.when(usable, F.xxhash64(F.lit(1), "vector", "label")).alias("h2"))
    of_id = rows.schema["id"].dataType.simpleString()
    of_label = rows.schema["label"].dataType.simpleString()
    distinct = (
        named.where(F.col("h1").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .select(F.monotonically_increasing_id().alias("rep"), "*")
    )
    keyed = written(
        distinct.mapInArrow(
            lambda b: _keyed(b, kind, bits, tables, seed),
            f"rep bigint, h1 bigint, h2 bigint, copies bigint, first_id {of_id}, label {of_label}, payload binary, keys array<bigint>, extra binary",
        ),
        "keyed",
    )
    spread = keyed.select("rep", "copies", "label", "payload", "extra", F.posexplode("keys").alias("t", "key"))
    same = ["label", F.length("payload"), "t", "key"]
    spread = spread.select(F.xxhash64(*same).alias("b1"), F.xxhash64(F.lit(1), *same).alias("b2"), "rep", "copies", "payload", "extra", "t")
    found = written(linked(spread, lambda t, x, y: _near(t, x, y, kind, _key_kind(bits), threshold), block, seed), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_rep = (
        keyed.select("rep", "h1", "h2", "copies", "first_id")
        .join(counts, "rep", "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "copies", "first_id", "links", F.coalesce("root", "rep").alias("root"))
    )
    firsts = of_rep.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # a table of its own, so that the rows of a hot vector can be split over tasks when they are joined with it
    of_rep = written(of_rep.join(firsts, "root").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    ), "named")
    hashed = named.select("id", "h1", "h2")
    made = hashed.where(F.col("h1").isNotNull()).join(of_rep, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = hashed.where(F.col("h1").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return made.unionAll(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
