"""Exact substring deduplication over a compacted De Bruijn graph of word k-mers.

A window is ``window`` consecutive words of one document. Each word covered by a window
whose words also start at any other place is removed. Windows are judged on the input.

Windows are the edges of the graph; the words that two successive windows share are the node
between them. Only edges that occur twice are wanted, and they are found in two steps:

* Equal windows hold the same leftmost least ``kmer`` words (by hash). The successive windows of
  a document with the same such k-mer form a stretch, about twelve windows. A k-mer that
  occurs in one stretch only has no repeated window and drops out. Where all its stretches are
  equal, each is a ready-made path of repeated edges.
* The stretches of other k-mers are opened at their source coordinates, and their windows are
  counted one by one.

A unit, stretch or window, is followed by another if they touch in some document. Where a unit has
one successor, and that has one predecessor, nothing branches; such units are joined to maximal
paths by pointer doubling, in as many joins as the longest path has bits. A document's
units that follow each other on one path are one run: a long repeated span, with its source
coordinates and its place on the path.

So far words were compared by 64-bit hashes. Now the words themselves are read at the coordinates of
each run, and laid along the path. A path on which any place has two different words owes them
to a collision; the windows of its runs are counted anew with their words as the key. All other runs
are right as they stand.

The texts are dealt out once, as a bucketed table; opening, comparing and cutting join it without
moving it. Every count is a partial aggregation, so a passage shared by a third of all
documents is one row from each task; tables that are joined on a hot key are written first, so that
the planner can split it.

Defined cases: a null, empty or blank text has no words, n_words 0 and kept text "".
A text of fewer words than the window is kept whole. Every row is a place of its own,
also if its id is null or repeats, so two rows equal in id and text are both cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bytewords import Words, mix, pieces, run_hashes
from textloom.llm.common import bucketed, dropped, written

WINDOW = 35
KMER = 12
#: Path places whose words are compared as one string.
_TILE = 128
#: Bytes of text that a worker looks at together.
_AT_ONCE = 2 << 20


def _least_at(x: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` values the place of its leftmost least one."""
    at, length = np.arange(len(x)), 1
    while length < size:
        step = min(length, size - length)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        length += step
    return at


class _Stretches:
    """The windows of one batch of documents, grouped by their least k-mer."""

    def __init__(self, text: pa.Array, window: int, kmer: int, bits: int) -> None:
        found = Words(text)
        hashes, self.offsets = found.hashes() >> np.uint64(64 - bits), found.offsets
        n = max(0, len(hashes) - window + 1)
        self.windows = run_hashes(hashes, window) if n else np.zeros(0, np.uint64)
        kmers = run_hashes(hashes, kmer) if n else np.zeros(0, np.uint64)
        place = _least_at(kmers, window - kmer + 1) if n else np.zeros(0, np.int64)
        at = np.arange(n)
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        valid = at + window <= self.offsets[doc + 1]
        first = valid.copy()
        first[1:] &= (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        self.begin = np.flatnonzero(first)
        self.count = np.bincount((np.cumsum(first) - 1)[valid], minlength=len(self.begin))
        self.doc = doc[self.begin]
        self.node = kmers[place[self.begin]].view(np.int64)
        # a node has at most window - kmer + 1 windows, so the first and the last cover the stretch
        ends = mix(self.windows[self.begin], self.windows[self.begin + self.count - 1], 1) if n else self.windows
        self.edge = mix(ends, self.count.astype(np.uint64), 2).view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch], window: int, kmer: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Every stretch. Columns: row, text."""
    for batch in batches:
        for part in pieces(batch, 1, _AT_ONCE):
            s = _Stretches(part.column(1), window, kmer, bits)
            begin = (s.begin - s.offsets[s.doc]).astype(np.int32)
            columns = [part.column(0).take(pa.array(s.doc)), s.node, s.edge, begin, s.count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "node", "edge", "begin", "n"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, kmer: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Every window of the wanted stretches. Columns: row, text, wanted (their begins)."""
    for batch in batches:
        for part in pieces(batch, 1, _AT_ONCE):
            s = _Stretches(part.column(1), window, kmer, bits)
            wanted = part.column(2)
            rows = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            pick = np.flatnonzero(np.isin(s.begin, wanted.flatten().to_numpy() + s.offsets[rows]))
            count = s.count[pick]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(s.begin[pick], count) + inside
            doc = np.repeat(s.doc[pick], count)
            begin = (at - s.offsets[doc]).astype(np.int32)
            columns = [part.column(0).take(pa.array(doc)), np.repeat(s.node[pick], count), s.windows[at].view(np.int64), begin]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "node", "window", "begin"])


def _laid(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each run, cut at the tiles of its path. Columns: row, text, runs."""
    for part in (p for b in batches for p in pieces(b, 1, _AT_ONCE)):
        out: list[tuple[int, int, bytes]] = []
        for text, runs in zip(part.column(1), part.column(2)):
            found = text.as_py().encode().split()
            for r in runs.as_py():
                at, begin, end = r["at"], r["begin"], r["end"] + window - 1
                while begin < end:
                    stop = min(end, begin + _TILE - at % _TILE)
                    out.append((r["path"], at, b" ".join(found[begin:stop])))
                    at, begin = at + stop - begin, stop
        path, at, words = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.int64()), pa.array(at, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], ["path", "at", "words"]
        )


def _spelled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of each run, spelled out. Columns: row, text, runs."""
    for batch in batches:
        for row, text, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
            found = text.as_py().encode().split()
            begins = [k for r in runs.as_py() for k in range(r["begin"], r["end"])]
            for s in range(0, len(begins), 4096):
                part = begins[s : s + 4096]
                words = pa.array([b" ".join(found[k : k + window]) for k in part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * len(part), pa.int64()), pa.array(part, pa.int32()), words], ["row", "begin", "words"]
                )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans of each row and drops the words they cover. Columns: id, text, spans."""
    for part in (p for b in batches for p in pieces(b, 1, _AT_ONCE)):
        n_words, n_removed, kept, removed = [], [], [], []
        for text, spans in zip(part.column(1), part.column(2)):
            found = text.as_py().encode().split()  # bytes are split at just the six ASCII blanks
            merged: list[dict[str, int]] = []
            for x in sorted(spans.as_py() or (), key=lambda x: (x["begin"], x["end"])):
                if merged and x["begin"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(x)
            n_words.append(len(found))
            n_removed.append(sum(x["end"] - x["begin"] for x in merged))
            removed.append(merged)
            for x in reversed(merged):
                del found[x["begin"] : x["end"]]
            kept.append(b" ".join(found))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, kind)],
            ["id", "n_words", "n_removed", "kept", "removed"],
        )


def repeated_units(texts: DataFrame, window: int, kmer: int, bits: int = 64) -> DataFrame:
    """(row, begin, n, unit): the stretches and single windows that occur twice, by hash, wherever they stand."""
    nodes = written(texts.select("row", "text").mapInArrow(lambda b: _nodes(b, window, kmer, bits), "row bigint, node bigint, edge bigint, begin int, n int"), "nodes")
    kinds = (
        nodes.groupBy("node")
        .agg(F.count("*").alias("many"), F.min("edge").alias("lo"), F.max("edge").alias("hi"))
        .where("many > 1")
        .select("node", (F.col("lo") != F.col("hi")).alias("branching"))
    )
    kinds = written(kinds, "kinds")
    found = written(nodes.join(kinds, "node"), "stretches")
    dropped(nodes)
    dropped(kinds)
    wanted = found.where("branching").groupBy("row").agg(F.collect_list("begin").alias("wanted"))
    opened = texts.join(wanted.hint("shuffle_hash"), "row").select("row", "text", "wanted")
    opened = written(opened.mapInArrow(lambda b: _windows(b, window, kmer, bits), "row bigint, node bigint, window bigint, begin int"), "windows")
    twice = written(opened.groupBy("node", "window").count().where("count > 1").select("node", "window"), "twice")
    units = found.where(~F.col("branching")).select("row", "begin", "n", F.xxhash64("node", "edge", "n").alias("unit")).unionAll(
        opened.join(twice, ["node", "window"]).select("row", "begin", F.lit(1).alias("n"), F.xxhash64("node", "window").alias("unit"))
    )
    units = written(units, "units")
    for t in (found, opened, twice):
        dropped(t)
    return units


def compacted(units: DataFrame) -> DataFrame:
    """(unit, path, at): the maximal nonbranching path of each unit, and its place there in words.

    ``units``: (row, begin, n, unit). A path is named by its first unit; a unit on a circle is a
    path of its own.
    """
    order = Window.partitionBy("row").orderBy("begin")
    end = F.col("begin") + F.col("n")
    touching = units.select(
        "unit", "n",
        F.when(F.lag(end).over(order) == F.col("begin"), F.lag("unit").over(order)).alias("before"),
        F.when(F.lead("begin").over(order) == end, F.lead("unit").over(order)).alias("after"),
    )
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    graph = written(touching.groupBy("unit").agg(F.min("n").alias("n"), only("before"), only("after")), "graph")
    previous = graph.select(F.col("unit").alias("before"), F.col("after").alias("back"), F.col("n").alias("far"))
    linked = F.coalesce((F.col("back") == F.col("unit")) & (F.col("before") != F.col("unit")), F.lit(False))
    # to: a unit further back on the path, far words away; the first unit points at itself. done: to is the first
    now = written(
        graph.join(previous, "before", "left").select(
            "unit", F.when(linked, F.col("before")).otherwise(F.col("unit")).alias("to"),
            F.when(linked, F.col("far")).otherwise(0).cast("long").alias("far"), (~linked).alias("done"),
        ),
        "paths",
    )
    dropped(graph)
    total, open_ = now.agg(F.count("*"), F.sum((~F.col("done")).cast("int"))).first()
    for _ in range(max(1, total).bit_length()):
        if not open_:
            break
        # no two open units point at the same one, so no key of this join is hot
        ahead = now.select(F.col("unit").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        moved = now.where(~F.col("done")).join(ahead, "to").select("unit", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        then = written(now.where("done").unionAll(moved), "paths")
        dropped(now)
        now = then
        open_ = now.where(~F.col("done")).count()
    return now.select("unit", F.when(F.col("done"), F.col("to")).otherwise(F.col("unit")).alias("path"), F.when(F.col("done"), F.col("far")).otherwise(0).alias("at"))


def runs_of(units: DataFrame, paths: DataFrame) -> DataFrame:
    """(row, begin, end, path, at): the units of a row that follow each other on a path, as one; end is of windows."""
    order = Window.partitionBy("row").orderBy("begin")
    placed = units.join(paths, "unit").select("row", "begin", (F.col("begin") + F.col("n")).alias("end"), "path", "at", F.col("n"))
    follows = (
        (F.lag("end").over(order) == F.col("begin")) & (F.lag("path").over(order) == F.col("path"))
        & (F.lag(F.col("at") + F.col("n")).over(order) == F.col("at"))
    )
    broken = placed.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    return (
        broken.withColumn("run", F.sum("new").over(order))
        .groupBy("row", "run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("path").alias("path"), F.min("at").alias("at"))
        .drop("run")
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, bits: int = 64
) -> DataFrame:
    """(id, n_words, n_removed, kept, removed) of every row of ``docs``.

    kept is the words that stay, joined by one space; removed the merged spans that were
    cut, as array<struct<begin, end>> in words, end exclusive. Words are hashed to ``bits`` bits; with
    few, words collide and the results stay the same.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_kind = base.schema["id"].dataType.simpleString()
    texts = bucketed(base, "row", "texts")

    units = repeated_units(texts, window, kmer, bits)
    paths = written(compacted(units), "compacted")
    runs = written(runs_of(units, paths), "runs")
    dropped(units)
    dropped(paths)

    def beside(some: DataFrame) -> DataFrame:
        """The texts of the rows that have runs, with them."""
        by_row = some.groupBy("row").agg(F.collect_list(F.struct("begin", "end", "path", "at")).alias("runs"))
        return texts.join(by_row.hint("shuffle_hash"), "row").select("row", "text", "runs")

    # the words along each path: equal pieces are one before they are spelled out
    laid = beside(runs).mapInArrow(lambda b: _laid(b, window), "path bigint, at bigint, words string").distinct()
    word = laid.select("path", "at", F.posexplode(F.split("words", " ")).alias("k", "word")).select("path", (F.col("at") + F.col("k")).alias("at"), "word")
    doubtful = written(word.distinct().groupBy("path", "at").count().where("count > 1").select("path").distinct(), "doubtful")

    span = lambda end: F.struct(F.col("begin"), end.cast("int").alias("end")).alias("span")
    spans = runs
    if not doubtful.isEmpty():
        spans = runs.join(doubtful, "path", "left_anti")
        spelled = written(beside(runs.join(doubtful, "path", "left_semi")).mapInArrow(lambda b: _spelled(b, window), "row bigint, begin int, words string"), "spelled")
        again = spelled.groupBy("words").count().where("count > 1").select("words")
        spans = spans.select("row", "begin", "end").unionAll(spelled.join(again, "words").select("row", "begin", (F.col("begin") + 1).alias("end")))
    spans = spans.select("row", span(F.col("end") + (window - 1))).groupBy("row").agg(F.collect_list("span").alias("spans"))
    out = texts.join(spans.hint("shuffle_hash"), "row", "left").select("id", "text", "spans").mapInArrow(
        _cut, f"id {id_kind}, n_words bigint, n_removed bigint, kept string, removed array<struct<begin:int,end:int>>"
    )
    return out.withColumnRenamed("id", id_col)
