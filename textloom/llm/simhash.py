"""SimHash near-duplicates, found by anchor-point covering.

The anchors are the words of a covering code: the [63, 57] Hamming code on the low 63
bits, with any top bit. Its covering radius is 1: every point of the space is within
one bit of an anchor. Two fingerprints at most two bits apart have a point between
them that is at most one bit from either, so an anchor lies within 1 + 1 bits of
both. Every fingerprint is therefore replicated to the anchors within two bits (33
of them, or 2 next to a code word), and fingerprints are compared only where they share an
anchor. (Replicating to radius 1 + 2 finds the same pairs with twenty times the rows.)

Seen from an anchor a fingerprint is the set of at most two bits flipped. Two such sets
are at most two bits apart just if one is empty, both hold one bit, or they share a
bit. So the comparison needs no pairs: the sets that hold a given bit all link with
each other, and a star to the least of them keeps the same components. An anchor has
at most 2,081 distinct fingerprints, whatever the data, since equal fingerprints are
one row from the start.

Two bits are few: texts that share 0.8 of their five-word shingles differ in ten of 64. So
``near_copies`` has a wider fingerprint of 256 bits and covers it block by block. Each table takes 15
of its bits, whose anchors are the words of the [15, 11] Hamming code within 1 + 1 bits, and
some plain bits beside them, as many as the rows ask for. Fingerprints that share an anchor of any
table are compared in full; ``LIMIT`` bits or fewer make them candidates. Candidates are then judged by the
shingles themselves: texts link just if the sets of their shingles have a Jaccard index of ``LIKENESS`` or more. For
that the shingles of each group of candidates meet once, and not once for each anchor.

Defined cases: null, empty and blank texts have fingerprint zero and link like any
other; equal ids are rows of their own with the same component; null ids never name
a component unless all ids in it are null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.buckets import linked, packed_rows
from textloom.llm.bytewords import Words, mix, pieces, run_hashes
from textloom.llm.common import WORD, bucketed, dropped, written
from textloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
_FIND = re.compile(WORD).findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AT_ONCE = 1 << 16


def shingles_of(text: str | None, size: int) -> list[str]:
    """Word shingles of the text with A-Z lower-cased, repeats included."""
    found = _FIND((text or "").translate(_LOWER))
    if len(found) <= size:
        return [" ".join(found)] if found else []
    return [" ".join(w) for w in zip(*(found[k:] for k in range(size)))]


def simhash_of(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if set in over half the shingle hashes."""
    shingles = shingles_of(text, size)
    ones = np.zeros(64, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for start in range(0, len(shingles), _AT_ONCE):
        part = np.array([hash_of(s.encode(), seed) for s in shingles[start : start + _AT_ONCE]], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def with_simhash(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) of every whole text. A text without words has fingerprint 0."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash_of(x.as_py(), size, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, fp bigint")


#: Parity masks of the Hamming code: bit i (from 1) is in mask k if the k-th bit of i is set.
_MASKS = [sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1) for k in range(6)]
_TOP = 64


def _flip(i: Column) -> Column:
    """The i-th bit alone, counted from 1; 0 stands for no bit."""
    return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))


def _syndrome(fp: Column) -> Column:
    """Which low bit to flip to reach a code word; 0 for none."""
    total = F.lit(0)
    for k, mask in enumerate(_MASKS):
        total = total + F.bit_count(fp.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << k)
    return total.cast("int")


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp`` with the components of "at most two bits apart"."""

    def pair(i: Column, j: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))

    s = F.col("s")
    code_word = F.array(pair(F.lit(0), F.lit(0)))
    others = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(s)), lambda i: pair(i, i.bitwiseXOR(s))
    )
    flips = F.concat(F.when(s == 0, code_word).otherwise(others), F.array(pair(s, F.lit(_TOP))))
    i, j = F.col("i"), F.col("j")
    replicas = (
        fps.select("fp", _syndrome(F.col("fp")).alias("s"))
        .select("fp", F.explode(flips).alias("f"))
        .select("fp", F.col("f.i").alias("i"), F.col("f.j").alias("j"))
        .withColumn("anchor", F.col("fp").bitwiseXOR(_flip(i)).bitwiseXOR(_flip(j)))
    )
    shared = replicas.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    # under the key of a bit meet the sets that hold it; under 0 those of at most one bit
    keys = (
        F.when((i == 0) & (j == 0), F.sequence(F.lit(0), F.lit(_TOP)))
        .otherwise(F.array(i, j))
    )
    held = shared.select("anchor", "fp", F.explode(keys).alias("key"))
    least = F.min("fp").over(Window.partitionBy("anchor", "key"))
    return held.select(F.col("fp").alias("a"), least.alias("b")).where("a != b").distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable.

    Equal fingerprints become one row before anything is replicated, so a hot text
    costs no more than a rare one. Other columns may have any name: only the two are read.
    """
    made = written(with_simhash(docs, id_col, text_col, size, seed), "simhash")
    fps = made.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = connected_components(near_links(fps.select("fp")))
    linked = fps.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    changed = linked.join(firsts, "root").select("fp", "linked_id")
    component = fps.join(changed, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id"))
    # a table of its own, so that a hot fingerprint's rows can be split over tasks when they are joined with it
    component = written(component, "components")
    return made.join(component, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- near copies over a wider radius -----------------------------------------------------------

#: Bits of the wide fingerprint, and in how many of them candidates differ at most. Texts that share 0.8 of
#: their shingles differ in 38.8 on average, with a deviation of 5.7; unrelated ones in 128.
WIDE = 256
LIMIT = 56
LIKENESS = 0.8
_BLOCK = 15
#: Chance that a pair of likeness 0.8 shares an anchor of one block, and that one plain bit is the same.
_SHARE, _SAME = 0.72, 0.8485
#: For each syndrome the flips of at most two bits that lead to an anchor; the word itself is its own.
_FLIPS = np.array(
    [[0] * 8] + [[1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i < i ^ s] for s in range(1, 16)]
)


def plan_anchors(rows: int, most: int = 1000, miss: float = 0.01) -> tuple[int, int]:
    """Plain bits beside a block, so that an anchor has about ``most`` unrelated rows at most, and
    tables, so that a pair of likeness 0.8 is missed with probability ``miss``."""
    plain = max(0, math.ceil(math.log2(max(1, rows) * 7.5625 / 2048 / most)))
    return plain, math.ceil(math.log(miss) / math.log(1 - _SHARE * _SAME**plain))


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word shingle, repeats included, in order of texts; fewer words are one shingle."""
    found = Words(texts, lower=True)
    h, at = found.hashes(), found.offsets
    count = np.diff(at)
    shingles = [run_hashes(h, size)] if len(h) >= size else []
    start = np.arange(len(shingles[0])) if shingles else np.zeros(0, np.int64)
    doc = np.searchsorted(at, start, side="right") - 1
    inside = start + size <= at[doc + 1] if len(start) else np.zeros(0, bool)
    values, docs = [s[inside] for s in shingles], [doc[inside]]
    for i in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence is the one shingle
        values.append(run_hashes(h[at[i] : at[i + 1]], int(count[i])))
        docs.append(np.array([i]))
    value, doc = np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]


def wide_fingerprints(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``WIDE`` bits, packed: a bit is 1 if set in over half the hashes of a text's shingles. No word: zero."""
    ones = np.zeros((n, WIDE), np.int32)
    for s in range(0, len(value), _AT_ONCE // 4):
        v, d = value[s : s + _AT_ONCE // 4], doc[s : s + _AT_ONCE // 4]
        words = np.stack([mix(v, np.full(len(v), k, np.uint64), k) for k in range(WIDE // 64)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1)


def shingle_sets(value: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct hashes of each of ``n`` texts, sorted."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    value, doc = value[new], doc[new]
    return np.split(value, np.searchsorted(doc, np.arange(1, n))) if n else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two sorted sets; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both)


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(row, fp, same): same is equal for equal sets of shingles."""
    for batch in batches:
        for part in pieces(batch, 1, 1 << 19):
            value, doc = shingle_hashes(part.column(1), size)
            made = wide_fingerprints(value, doc, len(part))
            same = [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in shingle_sets(value, doc, len(part))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in made], pa.binary()), pa.array(same, pa.int64())], ["row", "fp", "same"])


def _with_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rep, comp, fp, copies, shingles) from (rep, text, comp, fp, copies)."""
    for batch in batches:
        for part in pieces(batch, 1, 1 << 19):
            sets = shingle_sets(*shingle_hashes(part.column(1), size), len(part))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "comp", "fp", "copies", "shingles"]
            )


def _anchored(batches: Iterator[pa.RecordBatch], plain: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(rep, payload, t, b1, b2) for every anchor of every table. Columns: rep, payload."""
    r = np.random.default_rng(seed)
    places = [r.choice(WIDE, _BLOCK + plain, replace=False) for _ in range(tables)]
    weight = 1 << np.arange(_BLOCK + plain, dtype=np.int64)
    for batch in batches:
        for s in range(0, len(batch), 1024):
            part = batch.slice(s, 1024)
            bits = np.unpackbits(packed_rows(part.column(1), "u1"), axis=1)
            for t, of in enumerate(places):
                taken = bits[:, of].astype(np.int64)
                syndrome = np.bitwise_xor.reduce(np.where(taken[:, :_BLOCK] == 1, np.arange(1, _BLOCK + 1), 0), axis=1)
                anchors = (taken @ weight)[:, None] ^ _FLIPS[syndrome]
                wanted = np.ones(anchors.shape, bool)
                wanted[syndrome == 0, 1:] = False
                at = np.nonzero(wanted)[0]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.full(len(at), t, np.int32)), pa.array(anchors[wanted])],
                    ["rep", "payload", "t", "anchor"],
                )


def _close(table: pa.Table, left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fps = packed_rows(table["payload"].chunk(0), "<u8")
    far = np.zeros((len(left), len(right)), np.uint16)
    for k in range(fps.shape[1]):
        far += np.bitwise_count(fps[left, k][:, None] ^ fps[right, k][None, :])
    a, b = np.nonzero(far <= limit)
    a, b = left[a], right[b]
    other = a != b
    return a[other], b[other], np.zeros(int(other.sum()), bool)


def _judged(table: pa.Table, limit: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rep, root) that link the rows of a table which are alike, directly or through others: each left row against each right one.

    Pairs that are linked already are passed over, so a group of near copies costs about one comparison a row.
    """
    rep, left = table["rep"].to_numpy(), np.flatnonzero(table["left"].to_numpy(zero_copy_only=False))
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    fps = packed_rows(table["fp"].combine_chunks() if isinstance(table["fp"], pa.ChunkedArray) else table["fp"], "<u8")
    group = np.arange(len(rep))  # the least row of each row's group
    size = np.array([len(x) for x in sets])
    for i in left:
        far = np.bitwise_count(fps ^ fps[i]).sum(axis=1, dtype=np.int64)
        near = (far <= limit) & (size >= least * size[i] - 1e-9) & (least * size <= size[i] + 1e-9)
        near[i] = False
        for j in np.flatnonzero(near):
            if group[i] != group[j] and likeness(sets[i], sets[j]) >= least:
                low, high = sorted((group[i], group[j]))
                group[group == high] = low
    some = np.flatnonzero(group != np.arange(len(rep)))
    return rep[some], rep[group[some]]


def _verified(sets: DataFrame, limit: int, least: float, block: int) -> DataFrame:
    """(a, b) links among ``sets`` (rep, comp, fp, copies, shingles) of likeness ``least`` or more that keep the components of all such pairs within a comp.

    A comp of up to ``block`` rows meets in one place. In a larger one all rows are first held against a leader, the row with most
    copies, which is one comparison a row; those that are alike are one group by that. Only the others are then compared with all rows,
    block by block. So a large group of near copies isn't compared pair by pair, and no link between groups is lost.
    """
    sizes = sets.groupBy("comp").agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > block).select("comp", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.bool_())], ["a", "b", "alike"])

    large = sets.join(hot, "comp")
    first = large.groupBy("comp").agg(F.max(F.struct("copies", (-F.col("rep")).alias("low"))).alias("x")).select("comp", (-F.col("x.low")).alias("rep"))
    lead = written(large.join(first, ["comp", "rep"]).select("comp", F.col("rep").alias("leader"), F.col("shingles").alias("of_leader")), "leaders")
    judged = written(large.join(lead, "comp").select("rep", "shingles", "leader", "of_leader").mapInArrow(alike, "a bigint, b bigint, alike boolean"), "judged")
    rest = large.join(judged.where("NOT alike").select(F.col("a").alias("rep")), "rep", "left_semi")
    left = rest.select("rep", "comp", "fp", "shingles", F.lit(True).alias("left"))
    parts = left.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("lefts"))
    halves = hot.join(parts, "comp")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["rep", "comp", "fp", "shingles", "left", "i", "j"]
    ones = sets.join(hot, "comp", "left_anti").select("rep", "comp", "fp", "shingles", F.lit(True).alias("left"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    left = left.join(halves, "comp").withColumn("i", place(F.col("lefts"))).withColumn("j", every(F.col("parts"))).select(columns)
    right = sets.join(halves, "comp").withColumn("left", F.lit(False)).withColumn("i", every(F.col("lefts"))).withColumn("j", place(F.col("parts"))).select(columns)

    def compared(table: pa.Table) -> pa.Table:
        a, b = _judged(table, limit, least)
        return pa.table({"a": a, "b": b})

    met = ones.unionAll(left).unionAll(right).groupBy("comp", "i", "j").applyInArrow(compared, "a bigint, b bigint")
    return met.unionAll(judged.where("alike AND a != b").select("a", "b"))


def near_copies(
    texts: DataFrame, size: int = 5, limit: int = LIMIT, least: float = LIKENESS, miss: float = 0.01, block: int = 1000, verify_block: int = 256, seed: int = 17
) -> DataFrame:
    """(row, root) of each row of ``texts`` (row, text) that is a near copy of another: root is the same for all of a group.

    Near copies share ``least`` of the set of their word shingles, or are joined by others that do. Rows of equal sets are one row
    before anything is replicated; groups at an anchor are compared block by block.
    """
    fps = written(texts.select("row", "text").mapInArrow(lambda b: _fingerprinted(b, size), "row bigint, fp binary, same bigint"), "wide")
    distinct = written(fps.groupBy("fp", "same").agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "distinct")
    plain, tables = plan_anchors(distinct.count(), miss=miss)
    placed = distinct.select("rep", F.col("fp").alias("payload")).mapInArrow(
        lambda b: _anchored(b, plain, tables, seed), "rep bigint, payload binary, t int, anchor bigint"
    )
    rows = placed.select(
        F.col("t").cast("long").alias("b1"), F.col("anchor").alias("b2"), "rep", F.lit(0).cast("long").alias("copies"), "payload", F.lit(b"").alias("extra"), "t"
    )
    found = written(linked(rows, lambda t, x, y: _close(t, x, y, limit), block, seed), "links")
    candidates = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    members = written(distinct.join(candidates, F.col("rep") == F.col("node")).select("rep", F.col("root").alias("comp"), "fp", "copies"), "members")
    asked = texts.join(members.withColumnRenamed("rep", "row"), "row").select(F.col("row").alias("rep"), "text", "comp", "fp", "copies")
    sets = written(asked.mapInArrow(lambda b: _with_sets(b, size), "rep bigint, comp bigint, fp binary, copies bigint, shingles binary"), "sets")
    links = written(_verified(sets, limit, least, verify_block), "verified")
    dropped(sets)
    component = connected_components(links)
    of_rep = distinct.join(component, F.col("rep") == F.col("node"), "left").where((F.col("copies") > 1) | F.col("root").isNotNull())
    # a table of its own, so that the rows of a hot text can be split over tasks when they are joined with it
    of_fp = written(of_rep.select("fp", "same", F.coalesce("root", "rep").alias("root")), "groups")
    return fps.join(of_fp, ["fp", "same"]).select("row", "root")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, limit: int = LIMIT, least: float = LIKENESS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id.

    Every row counts for itself, so rows that share an id, or have none, are told apart; among equal
    ids any one row stays, and a null id gives way to any other. Texts without words are one group.
    """
    keyed = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "row", "rows")
    ident, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    grouped = written(near_copies(keyed.select("row", F.coalesce(text, F.lit("")).alias("text")), size, limit, least), "grouped")
    ids = keyed.select("row", ident.alias("id"))
    first = grouped.join(ids, "row").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("row"))
    gone = grouped.join(first.select("row"), "row", "left_anti").select("row")
    return keyed.join(gone.hint("shuffle_hash"), "row", "left_anti").select("doc.*")
