"""Importance resampling of documents towards a target text set, on hashed runs of words.

Two Arrow passes over whole texts. The first counts the hashed features of every partition with
``np.bincount`` into a vector as long as the buckets; ``treeReduce`` merges the vectors, so only one
vector reaches the driver, whatever the rows. From both counts each bucket gets a gain, a whole number.
The second pass has the gains as a broadcast variable (80 KB for 10,000 buckets), sums them over each
document and adds a Gumbel draw by a hash of the id, so that the highest scores are a sample without
replacement in proportion to the weights, the same on any cluster.

A feature's bucket is its CRC-32 modulo the buckets. The CRC of a run is put together from those of its
words, so no text of a run is ever built. The order of all scores is dealt into ranges, and ranks are
running counts over them: no task holds more than a range.

Defined cases: null, empty and wordless texts have no features, weight 0 and are never drawn; a null id
is hashed as no characters at all, and among equal scores comes after all others; rows that share an id share its draw,
and ties between them are dealt in any order; an empty table gives an empty table, and an empty target
gives gains all the same (the formula's smoothing). Only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import Words, pieces
from textloom.llm.common import written
from textloom.llm.crc import appended, crc32, with_byte
from textloom.operators.relations import running

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
_AT_ONCE = 1 << 20
#: Bytes of words once A-Z are lower-cased: digits, a to z, and all of longer characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature) of a string array."""
    found = Words(texts, lower=True, inside=lambda data: _INSIDE[data])
    at = found.offsets
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    one, size = crc32(found.data, found.start, found.end), found.end - found.start
    docs, values, run = [doc], [one], one
    for n in range(2, longest + 1):
        if len(doc) < n:
            break
        same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        run = appended(with_byte(run[:-1], 0x20), one[n - 1 :], size[n - 1 :])
        docs.append(doc[n - 1 :][same])
        values.append(run[same])
    return np.diff(at), np.concatenate(docs), np.concatenate(values).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts: one vector, merged in a tree on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, 0, _AT_ONCE):
                total += np.bincount(features(part.column(0), buckets, longest)[2], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    made = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "counts binary").rdd
    vectors = made.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # for tables without partitions
    return vectors.union(none).treeReduce(np.add)


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The whole-number gain of each bucket: a thousand times the log ratio of smoothed shares, floored."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * (s + k)) / (float(a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: object, seed: int = SEED) -> int:
    """A thousand times a Gumbel draw by the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = sent.value
        for batch in batches:
            for part in pieces(batch, 1, _AT_ONCE):
                words, doc, bucket = features(part.column(1), len(each), longest)
                count = np.bincount(doc, minlength=len(part))
                total = np.bincount(doc, each[bucket], len(part)).astype(np.int64)
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                score = weight + np.array([gumbel(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(x.astype(np.int64)) for x in (words, count, weight, score)]], ["id", "n_words", "n_features", "weight", "score"]
                )

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint").withColumnRenamed("id", id_col)


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank counts the drawn ones from 1 and is null for the others.

    Drawn are the highest ``percent`` of the scores of documents with ``least_words`` words or more.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    made = written(scored(docs, gains, id_col, text_col, longest, seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    n = made.agg(F.count(F.when(enough, 1))).first()[0]
    # the row number only tells apart what is equal otherwise, so that a hot id can be dealt over ranges
    order = (F.desc("score"), F.asc_nulls_last(id_col), F.asc("_row"))
    ranked = running(made.where(enough), order, {"rank": F.lit(1)})
    rank = F.when(F.col("rank") <= percent * n // 100, F.col("rank")).cast("long").alias("rank")
    out = [id_col, "n_features", "weight", "score"]
    return ranked.select(*out, rank).unionAll(made.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))
