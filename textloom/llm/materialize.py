"""Training-order materialisation: token ids as fixed-stride shards in a keyed order.

The token streams of all documents, each closed by an end id, are joined to one stream
and cut into sequences of ``length`` ids; only the very last one is padded, with end ids. A keyed
Feistel network permutes the numbers of the sequences; cycle-walking keeps it within
their count, so that every sequence has one global slot and no slot is empty. Slots
are dealt in ranges to shards. A shard holds its sequences back to back, little-endian,
so slot s is at byte (s mod per_shard) × length × width of shard s div per_shard: a
reader resumes anywhere without an index.

The stream is in the order of ids, ties by a hash of the text, so slots and shards depend on the rows alone and
not on the cluster's size or on files. A first job deals the documents into ranges of ids, encodes them,
once, and writes their ids with each document's offset in its range. The ranges' offsets are sums
over one number for each range. Further jobs, one for each third of the shards, give each piece of a
sequence its slot, and one shuffle by ranges of slots brings the pieces together; no document is held whole by more than one
task. Each task writes its shards under a temporary name and renames them, so a repeated attempt
leaves the same files.

Defined cases: a null or empty text is an end id alone; an empty table has no sequence;
repeated rows are documents of their own; null ids come first; extra columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bytewords import pieces as by_size
from textloom.llm.common import dropped, shared_folder, written

LENGTH = 1024
PER_SHARD = 4096


@dataclass(frozen=True)
class BytePairs:
    """A byte-level vocabulary of ranks, as read from its file on the driver; ``end_id`` is a free id."""

    ranks: bytes
    pattern: str
    end_id: int

    @staticmethod
    def load(path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            ranks = f.read()
        return BytePairs(ranks, pattern, len(ranks.splitlines()))

    def encode_all(self, texts: list[str | None], kind: str) -> list[bytes]:
        """Ids of each text with the end id, as packed numbers."""
        if self not in _held:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _held[self] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        encode, end = _held[self].encode_ordinary, [self.end_id]
        sign = {"<u2": "H", "<u4": "I"}[kind]  # packing a list so is several times cheaper than by numpy
        return [array(sign, encode(t or "") + end).tobytes() for t in texts]


_held: dict[BytePairs, object] = {}


def _round_keys(key: int, rounds: int = 6) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below n: a bijection of 0 .. n-1 that the key chooses."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    bits = np.uint64(half)
    keys = _round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return left << bits | right

    out = once(index.astype(np.uint64))
    while (over := out >= n).any():  # the domain is at most four times n, so few walks are long
        out[over] = once(out[over])
    return out.astype(np.int64)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_sequences(folder: str, start: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of the slots from ``start`` on, in order, by seeking in the shards of a mounted folder."""
    width = np.dtype(kind).itemsize
    for slot in range(start, start + count):
        with open(os.path.join(folder, shard_name(slot // per_shard)), "rb") as f:
            f.seek(slot % per_shard * length * width)
            yield np.frombuffer(f.read(length * width), kind)


def _file_system(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def materialize(
    docs: DataFrame, tokenizer: BytePairs, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 2026, folder: str | None = None, kind: str = "<u2",
    rows_each: int = 100_000, waves: int = 3,
) -> DataFrame:
    """Writes the shards and returns their index: slot, shard, place, sequence, n_tokens, first_id, sha256.

    ``folder`` is a URI that all executors reach; by default a new one in the shared folder. The
    files are there when this returns. n_tokens is ``length`` but for the padded sequence;
    first_id is the document that the sequence begins in.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file: fixed size
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    width = np.dtype(kind).itemsize

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        for batch in batches:
            for part in by_size(batch, 1, 1 << 19):  # by their size, as texts may be long
                yield part.column(0), shipped.value.encode_all(part.column(1).to_pylist(), kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for ids, made in tokens(batches):
            n = np.array([len(m) // width for m in made], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int64)), pa.array(before), pa.array(n), ids, pa.array(made, pa.binary())], ["part", "before", "n", "id", "tokens"]
            )

    id_kind = base.schema["id"].dataType.simpleString()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // rows_each)
    order = ("id", F.xxhash64("text"))  # so that the rows of one id, or of none, are dealt over ranges too
    in_order = base.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    encoded = written(in_order.mapInArrow(encode, f"part bigint, before bigint, n bigint, id {id_kind}, tokens binary"), "tokens")
    # one row for each range
    sums = written(encoded.groupBy("part").agg(F.sum("n").alias("n")), "sums")
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    sequences = -(-total // length)

    def deal(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The pieces whose slots are from low to below high."""
        for batch in batches:
            if not len(batch):
                continue
            at, ids, made = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            bounds = np.frombuffer(made.buffers()[1], np.int32)[made.offset :][: len(made) + 1].astype(np.int64)
            end = at + np.diff(bounds) // width
            # the sequences that each document has a part of
            count = (end - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(at)), count)
            sequence = at[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(at[doc], sequence * length)
            cuts = np.append(bounds[doc] + (start - at[doc]) * width, bounds[-1]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts.tobytes()), made.buffers()[2]])
            slot = permuted(sequence, sequences, key)
            now = np.flatnonzero((slot >= low) & (slot < high))
            rows = pa.array(now)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[now]), pa.array(sequence[now]), pa.array((start[now] % length).astype(np.int32)), ids.take(pa.array(doc[now])), pieces.take(rows)],
                ["slot", "sequence", "begin", "id", "tokens"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        out, shard, slot, filled, head = None, -1, -1, 0, None
        names = (f"{root}/", f".{uuid.uuid4().hex}")
        rows: list[tuple] = []
        digest = hashlib.sha256()

        def close_sequence() -> None:
            nonlocal filled
            if slot < 0:
                return
            pad = np.full(length - filled, shipped.value.end_id, kind).tobytes()
            digest.update(pad)
            out.write(pad)
            rows.append((slot, slot // per_shard, slot % per_shard, head[0], filled, head[1], digest.hexdigest()))

        def close_shard() -> None:
            if out is not None:
                out.close()
                store.move(names[0] + shard_name(shard) + names[1], names[0] + shard_name(shard))

        def index() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), docs_id, pa.string()]
            titles = ["slot", "shard", "place", "sequence", "n_tokens", "first_id", "sha256"]
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], titles)

        docs_id = pa.int64()
        for batch in batches:
            docs_id = batch.schema.field("id").type
            for s, q, ident, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "id", "tokens"))):
                if s != slot:
                    close_sequence()
                    if s // per_shard != shard:
                        close_shard()
                        shard = s // per_shard
                        out = store.open_output_stream(names[0] + shard_name(shard) + names[1])
                    slot, filled, head, digest = s, 0, (q, ident), hashlib.sha256()
                out.write(piece)
                digest.update(piece)
                filled += len(piece) // width
            if len(rows) > 4096:
                yield index()
                rows.clear()
        close_sequence()
        close_shard()
        yield index()

    # whole shards to a task: dealt by the shard's number, ordered by slot within. The shards are written in waves, so that
    # the pieces of one wave alone are on disk beside the ids
    shards = max(1, -(-sequences // per_shard))
    placed = encoded.join(starts, "part").select((F.col("start") + F.col("before")).alias("at"), "id", "tokens")
    out = []
    for first in range(0, shards, -(-shards // waves)):
        many = min(shards - first, -(-shards // waves))
        low, high, tasks = first * per_shard, (first + many) * per_shard, min(many, 100_000)
        pieces = placed.mapInArrow(
            lambda b, low=low, high=high: deal(b, low, high), f"slot bigint, sequence bigint, begin int, id {id_kind}, tokens binary"
        )
        # ranges of equal width are known beforehand
        ordered = (
            pieces.withColumn("task", F.floor((F.floor(F.col("slot") / per_shard) - first) * tasks / many).cast("int"))
            .repartitionById(tasks, "task")
            .sortWithinPartitions("slot", "begin")
            .select("slot", "sequence", "id", "tokens")
        )
        index = ordered.mapInArrow(write, f"slot bigint, shard bigint, place int, sequence bigint, n_tokens int, first_id {id_kind}, sha256 string")
        out.append(written(index, "index"))
    dropped(encoded)
    return reduce(DataFrame.unionAll, out)
