"""Toxicity scores by a convolutional text classifier over hashed word embeddings.

Words are hashed to 2^22 buckets, whose embeddings are ``WIDTH`` numbers each. Filters of one, two and three words
slide over the whole text; each filter's greatest activation (max pooling) goes to a logistic unit. All of it is
trained in numpy by backpropagation with Adam, on every word of every labelled row that is not held out: in each round each task goes over
its own rows from the same network, and the network moves by the mean of how the tasks moved it. Buckets that too few texts
share (two, and up to twenty with many toxic rows) have a fixed embedding of zeros, so a bucket that training never saw says nothing. The first
number of an embedding starts from how far the bucket's documents are more toxic than expected, in standard deviations, as counted
over all of them; the others start at random. The driver holds one network, whose size the number of buckets bounds.

A fifth of the rows never trains. On it a threshold is chosen for each language, where it has enough toxic rows, and
else for all, and the score is bent so that the threshold lands at ``CUT`` (0.3): a score of ``CUT`` or more means toxic in
any language. A text's language is its own words' guess (naive Bayes on the same buckets, from
the rows' languages), so a prediction needs nothing but the text.

Texts are run in pieces, and documents of a piece are kept apart by padding, so a filter never spans two.

Defined cases: null, empty and wordless texts are one padding word long, and score what it scores; rows are independent, so repeated
rows and extra columns don't matter. A null label is no label. With no labelled row of either label the
score is 0 for every text, or 1 if all are toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import Words, pieces
from textloom.tables import written

CUT = 0.3
SIZES = (1, 2, 3)
#: A word's embedding is the sum of those of the whole word and of its first so many bytes, so that endings matter less.
STEMS = (None, 7, 9)
WIDTH = 8
FILTERS = 6
_BITS = 22
_PAD = max(SIZES) - 1
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's words begin, buckets of each word and its stems): words are runs of letters, digits and longer characters, A-Z lower-cased."""
    found = Words(texts, lower=True, inside=lambda data: _INSIDE[data])
    each = [found.hashes(first) >> np.uint64(64 - _BITS) | np.uint64(k << _BITS) for k, first in enumerate(STEMS)]
    return found.offsets, np.stack(each, axis=1).astype(np.int32)


@dataclass
class Network:
    """``known``: sorted buckets, whose embeddings are the rows of E from 1 on. F: filters by size (size, width, filters);
    b: their biases; v, c: the logistic unit. L: what each row says for each language; cuts: the threshold of each."""

    known: np.ndarray
    E: np.ndarray
    F: dict[int, np.ndarray]
    b: dict[int, np.ndarray]
    v: np.ndarray
    c: np.ndarray
    languages: list[str] = field(default_factory=list)
    L: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def rows_of(self, buckets: np.ndarray) -> np.ndarray:
        """Row of E of each bucket; 0 for those without one."""
        if not len(self.known):
            return np.zeros(buckets.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, buckets), len(self.known) - 1)
        return np.where(self.known[at] == buckets, at + 1, 0)


def padded(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of E (word, part) in order with padding (row 0) after each text, one for an empty text more; and where each text begins."""
    n = np.maximum(np.diff(offsets), 1)
    begin = np.cumsum(n + _PAD) - (n + _PAD)
    out = np.zeros((int((n + _PAD).sum()), rows.shape[1]), np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    out[begin[doc] + np.arange(len(rows)) - offsets[:-1][doc]] = rows
    return out, begin


def pooled(net: Network, line: np.ndarray, begin: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(greatest activation of each filter in each text, and where it is first reached if asked): (text, filter)."""
    ends = np.r_[begin[1:], len(line)] - _PAD
    cuts = np.stack([begin, ends], axis=1).ravel()  # texts and padding in turn
    out, where = [], []
    for size in SIZES:
        seen = np.zeros((len(line), net.F[size].shape[2]), np.float32)
        for k in range(size):
            each = net.E @ net.F[size][k]
            for part in range(line.shape[1]):
                seen[: len(line) - k] += each[line[k:, part]]
        top = np.maximum.reduceat(seen, cuts, axis=0)[::2]
        out.append(top + net.b[size])
        if places:
            doc = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(line)]))
            first = np.empty(top.shape, np.int64)
            for f in range(top.shape[1]):
                hit = np.flatnonzero(seen[:, f] == top[doc, f])
                hit = hit[hit < ends[doc[hit]]]
                first[doc[hit][::-1], f] = hit[::-1]
            where.append(first)
    return np.maximum(np.concatenate(out, axis=1), 0), where


def probability(net: Network, h: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(h @ net.v + net.c, -30, 30)))


def _gradients(net: Network, line: np.ndarray, begin: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over texts and its gradients by backpropagation. Only the places of the greatest activations get any."""
    h, where = pooled(net, line, begin, True)
    p = probability(net, h)
    n = len(y)
    loss = -float(np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    d = (p - y) / n
    g = {"v": h.T @ d, "c": np.array([d.sum()])}
    dh = d[:, None] * net.v[None, :] * (h > 0)
    ge = np.zeros_like(net.E)
    for i, size in enumerate(SIZES):
        part = dh[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"b{size}"] = part.sum(axis=0)
        gf = np.zeros_like(net.F[size])
        for k in range(size):
            rows = line[where[i] + k]  # (text, filter, part of the word)
            gf[k] = np.einsum("tf,tfpw->wf", part, net.E[rows])
            np.add.at(ge, rows, (part[:, :, None] * net.F[size][k].T[None])[:, :, None, :])
        g[f"F{size}"] = gf
    ge[0] = 0  # padding and unknown words stay at zero
    return loss, g | {"E": ge}


def _parts(net: Network) -> dict[str, np.ndarray]:
    return {"E": net.E, "v": net.v, "c": net.c} | {f"F{s}": net.F[s] for s in SIZES} | {f"b{s}": net.b[s] for s in SIZES}


def fresh(known: np.ndarray, first: np.ndarray, seed: int, width: int = WIDTH, filters: int = FILTERS) -> Network:
    """An untrained network whose embeddings begin with ``first``."""
    r = np.random.default_rng(seed)
    e = np.zeros((len(known) + 1, width))
    e[1:] = r.normal(0, 0.05, (len(known), width))
    e[1:, 0] = first
    f = {s: r.normal(0, 0.15, (s, width, filters)) for s in SIZES}
    for s in SIZES:
        f[s][:, 0, :] = np.abs(f[s][:, 0, :]) + 0.3
    as32 = lambda x: x.astype(np.float32)
    return Network(known, as32(e), {s: as32(f[s]) for s in SIZES}, {s: np.full(filters, -0.1, np.float32) for s in SIZES}, as32(r.normal(0.3, 0.05, len(SIZES) * filters)), np.array([-2.0], np.float32))


def best_cut(p: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """The middle, in log odds, of the thresholds whose F1 is within a hundredth of the largest. Of each probability of ``p``, so many rows and toxic ones."""
    order = np.argsort(-p, kind="stable")
    order = order[rows[order] > 0]
    low = np.clip(np.r_[p[order], 0.0], 0.001, 0.999)
    f1 = 2 * np.cumsum(toxic[order]) / (np.cumsum(rows[order]) + toxic.sum())
    near = np.flatnonzero(f1 >= f1.max() - 0.01)
    odds = np.log(low / (1 - low))
    return float(1 / (1 + np.exp(-(odds[near[0]] + odds[near[-1] + 1]) / 2)))


def guessed(net: Network, line: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Number of the likeliest language of each text by its words."""
    if not len(net.languages):
        return np.zeros(len(begin), np.int64)
    return np.add.reduceat(net.L[line[:, 0]], begin, axis=0, dtype=np.float64).argmax(axis=1)


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of each text, from 0 to 1; ``CUT`` is the threshold of the text's language."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    if not len(texts):
        return np.zeros(0)
    offsets, buckets = hashed_words(texts)
    line, begin = padded(net.rows_of(buckets), offsets)
    p = probability(net, pooled(net, line, begin)[0]).astype(np.float64)
    cut = net.cuts[guessed(net, line, begin)]
    return np.clip(np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut)), 0, 1)


#: Cells of a histogram of log odds from -8 to 8, by which thresholds are chosen.
_CELLS = 2048
_LOSS, _HISTOGRAM = -(1 << 20), -(1 << 21)


def _small(net: Network) -> np.ndarray:
    """All numbers but the embeddings in one array."""
    return np.concatenate([w.ravel() for k, w in _parts(net).items() if k != "E"]).astype(np.float64)


def _moved(net: Network, rows: np.ndarray, by: np.ndarray, small: np.ndarray) -> Network:
    """A copy whose embeddings and other numbers are moved."""
    made = replace(net, E=net.E.copy(), F={k: w.copy() for k, w in net.F.items()}, b={k: w.copy() for k, w in net.b.items()}, v=net.v.copy(), c=net.c.copy())
    made.E[rows] += by.astype(np.float32)
    for k, w in _parts(made).items():
        if k != "E":
            w += small[: w.size].reshape(w.shape).astype(np.float32)
            small = small[w.size :]
    return made


def learned(net: Network, texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int, batch: int = 64, rate: float = 0.01, slow: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Adam over ``texts`` (words of all, where each begins, labels): (rows of E, how often each was met, numbers all moved, texts seen) beside what ``net`` becomes in place."""
    r, n, step = np.random.default_rng(seed), 0, 0
    m, v2, met = {}, {}, np.zeros(len(net.E), np.int32)
    for k, w in _parts(net).items():
        m[k], v2[k] = np.zeros_like(w), np.zeros_like(w)
    for line, begin, y in texts:
        ends = np.r_[begin[1:], len(line)]
        order = r.permutation(len(y))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            size = ends[pick] - begin[pick]
            known, own = np.unique(np.r_[0, np.concatenate([line[begin[i] : ends[i]] for i in pick]).ravel()], return_inverse=True)
            # only the rows of E that the batch has
            part = replace(net, E=net.E[known])
            _, g = _gradients(part, own[1:].reshape(-1, line.shape[1]), np.cumsum(size) - size, y[pick])
            step, n = step + 1, n + len(pick)
            met[known] += 1
            for k, w in _parts(net).items():
                at = known if k == "E" else slice(None)
                times = met[known][:, None] if k == "E" else step
                m[k][at] = 0.9 * m[k][at] + 0.1 * g[k]
                v2[k][at] = 0.99 * v2[k][at] + 0.01 * g[k] * g[k]
                w[at] -= ((rate if k != "E" else rate * slow) * m[k][at] / (1 - 0.9**times) / (np.sqrt(v2[k][at] / (1 - 0.99**times)) + 1e-7)).astype(np.float32)
    rows = np.flatnonzero(met[1:]) + 1
    return rows, met[rows], _small(net), n


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Bits by which rows that have no label are told before the join, whatever the number of labels.
_ID_BITS = 1 << 26


def likely(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, ...) whose id has the hash of an id of ``known``: all that a join by id keeps and few others, so that it shuffles no other texts."""
    bit = F.pmod(F.xxhash64("id"), F.lit(_ID_BITS))
    bitmap = known.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    met = texts.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(F.broadcast(bitmap), "_bucket")  # 8 MB at most
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*texts.columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic", seed: int = 7) -> Network:
    """Trains on the whole texts of all labelled documents that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    aside = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(5)) == 0
    rows = written(likely(texts, known).join(known, "id").select("text", "label", "lang", aside.alias("aside")), "labelled")  # read in each round
    sizes = rows.groupBy("label", "lang", "aside").agg(F.count("*").alias("n")).collect()  # a row for each label and language
    count = lambda label, side=None: sum(x["n"] for x in sizes if x["label"] == label and side in (None, x["aside"]))
    if not count(0) or not count(1):
        net = fresh(np.zeros(0, np.int32), np.zeros(0), seed)
        net.constant = float(count(1) > 0)
        return net
    if not count(0, False) or not count(1, False):  # too few to set any aside
        rows = rows.withColumn("aside", F.lit(False))
        count = lambda label, side=None: 0 if side else sum(x["n"] for x in sizes if x["label"] == label)
    fitted, toxic = count(0, False) + count(1, False), count(1, False)
    names = sorted({x["lang"] for x in sizes if x["lang"] is not None})
    share = toxic / fitted

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0, 2 << 20):
                offsets, buckets = hashed_words(part.column(0))
                doc = np.repeat(np.arange(len(part)), np.diff(offsets))
                each = np.unique((doc[:, None] << 24) | buckets)  # a bucket once a text
                of = part.column(2).to_pylist()
                kind = np.array([2 * (names.index(x) if x is not None else len(names)) for x in of], np.int64) + part.column(1).to_numpy()
                keys, n = np.unique(((each & ((1 << 24) - 1)) * (2 * len(names) + 2)) + kind[each >> 24], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys // (2 * len(names) + 2)), pa.array(keys % (2 * len(names) + 2)), pa.array(n)], ["bucket", "kind", "n"])

    met = rows.where(~F.col("aside")).select("text", "label", "lang").mapInArrow(seen, "bucket bigint, kind bigint, n bigint").groupBy("bucket")
    by = [F.sum(F.when(F.floor(F.col("kind") / 2) == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(len(names))]
    made = met.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") % 2 == 1, F.col("n")).otherwise(0)).alias("bad"), *by)
    vocabulary = made.where(F.col("n") >= int(np.clip(toxic // 40, 2, 20))).toArrow().sort_by("bucket")  # of 3 * 2^22 buckets those that enough texts have
    n, bad = vocabulary["n"].to_numpy(), vocabulary["bad"].to_numpy()
    net = fresh(vocabulary["bucket"].to_numpy().astype(np.int32), np.tanh((bad - n * share) / np.sqrt(n * share + 1) / 4), seed)
    if names:
        each = np.stack([vocabulary[f"l{k}"].to_numpy() for k in range(len(names))], axis=1) + 0.1
        log = np.log(each / each.sum(axis=0))
        net.languages, net.L = names, np.r_[np.zeros((1, len(names))), log - log.mean(axis=1, keepdims=True)].astype(np.float32)

    every = count(1, True) < 5  # with too few texts aside, thresholds look at all
    parted = rows.select("text", "label", "aside").coalesce(int(np.clip(fitted // 1000, 1, 32)))
    rounds = int(np.clip(160_000 // fitted, 3, 8))
    best, kept = np.inf, (net, {})
    for k in range(rounds + 1):  # each round judges the network of the round before
        moved, small, loss, histogram = _round(parted, net, seed + k, every, k < rounds)
        if loss < best or not count(0, True) + count(1, True):
            best, kept = loss, (net, histogram)
        if k < rounds:
            net = _moved(net, moved[0], moved[1], small)
    net, histogram = kept

    odds = (np.arange(_CELLS) + 0.5) / _CELLS * 16 - 8
    cells = np.zeros((max(1, len(names)), 2, _CELLS))
    for at, x in histogram.items():
        cells.reshape(-1)[at] = x
    cut = lambda c: best_cut(1 / (1 + np.exp(-odds)), c.sum(axis=0), c[1])
    net.cuts = np.array([cut(c if c[1].sum() >= 20 else cells.sum(axis=0)) for c in cells])
    net.cuts = np.clip(net.cuts, 0.02, 0.98)
    return net


def _round(rows: DataFrame, net: Network, seed: int, every: bool, trains: bool) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float, dict[int, float]]:
    """One pass over all ``rows`` (text, label, aside): the mean of how each task moves the network over its texts, weighed by texts (of an
    embedding, by the batches that have it); and the loss over the texts aside and the histogram of the judged, by language and label, of the network as it was."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    names = ["key", "times", *[f"x{i}" for i in range(WIDTH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, histogram, lost = sent.value, Counter(), [0.0, 0]
        now = _moved(was, np.zeros(0, np.int64), np.zeros((0, WIDTH)), np.zeros(len(_small(was))))

        def lines() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for part in pieces(batch, 0, 1 << 20):
                    aside, y = part.column(2).to_numpy(zero_copy_only=False), part.column(1).to_numpy().astype(np.float64)
                    for held in (True, False):
                        some = part.column(0).filter(pa.array(aside == held))
                        if not len(some):
                            continue
                        offsets, buckets = hashed_words(some)
                        line, begin = padded(was.rows_of(buckets), offsets)
                        own = y[aside == held]
                        if held or every:
                            known, at = np.unique(np.r_[0, line.ravel()], return_inverse=True)
                            p = probability(was, pooled(replace(was, E=was.E[known]), at[1:].reshape(line.shape), begin)[0]).astype(np.float64)
                            if held:
                                lost[0] -= float(np.sum(own * np.log(p + 1e-9) + (1 - own) * np.log(1 - p + 1e-9)))
                                lost[1] += len(p)
                            odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
                            cell = np.clip(((odds + 8) / 16 * _CELLS).astype(np.int64), 0, _CELLS - 1)
                            histogram.update(((guessed(was, line, begin) * 2 + own.astype(np.int64)) * _CELLS + cell).tolist())
                        if not held and trains:
                            yield line, begin, own

        at, times, small, n = learned(now, lines(), seed)
        keys = [at, -1 - np.arange(len(small)), np.array([_LOSS]), _HISTOGRAM - np.fromiter(histogram, np.int64, len(histogram))]
        weights = [times, np.full(len(small), n), np.array([lost[1]]), np.zeros(len(histogram))]
        values = np.zeros((sum(map(len, keys)), WIDTH))
        values[: len(at)] = (now.E[at].astype(np.float64) - was.E[at]) * times[:, None]
        values[len(at) :, 0] = np.r_[(small - _small(was)) * n, lost[0], np.fromiter(histogram.values(), np.float64, len(histogram))]
        columns = [np.concatenate(keys).astype(np.int64), np.concatenate(weights).astype(np.float64), *values.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    schema = "key bigint, times double, " + ", ".join(f"x{i} double" for i in range(WIDTH))
    sums = rows.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()  # a row for each embedding met
    key, times = sums["key"].to_numpy(), sums["times"].to_numpy()
    x = np.stack([sums[f"x{i}"].to_numpy() for i in range(WIDTH)], axis=1)
    sent.unpersist()
    small = np.zeros(len(_small(net)))
    of = (key < 0) & (key > _LOSS)
    small[-1 - key[of]] = x[of, 0] / np.maximum(times[of], 1)
    judged = float(times[key == _LOSS].sum())
    loss = float(x[key == _LOSS, 0].sum()) / judged if judged else np.inf
    return (key[key > 0], x[key > 0] / times[key > 0][:, None]), small, loss, {int(_HISTOGRAM - k): v for k, v in zip(key[key <= _HISTOGRAM], x[key <= _HISTOGRAM, 0])}


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a row for each bucket that enough labelled rows share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(sent.value, part.column(1)))], ["id", "score"])

    kind = base.schema["id"].dataType.simpleString()
    made = base.mapInArrow(run, f"id {kind}, score double")
    return made.select(F.col("id").alias(id_col), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
