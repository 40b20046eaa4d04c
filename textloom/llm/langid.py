"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read every window of 64 bytes of a text, one from each end, each
with a fresh state, as in training; no state crosses from one window to the next. From both
states a softmax labels every position; a document's probabilities are the mean over
the positions of its letters, in the whole text. One more label, which no text is given,
stands for no language: it is trained on windows of the sample whose letters are shuffled,
drawn at random or taken from other scripts (``nonsense``). So the score of a text in none of
the languages falls towards 0, and not just towards one over their number. The network is written in numpy and
trained by backpropagation through time on a bounded sample of labelled rows:
``per_language`` documents of each language, ``windows_each`` windows of each, drawn by
a hash of the id. The sample bounds training alone; every byte of every text is labelled.

Defined cases: a null text or one without a letter is ``und`` with score 0. Rows are
independent, so repeated rows and extra columns don't matter. With no labelled row at
all every text is ``und``; with one language every text with a letter is that language.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.bytewords import pieces

UNKNOWN = "und"
WIDTH = 64
HIDDEN = 8
_AT_ONCE = 2048
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes whose positions count: ASCII letters and all of longer characters.
_COUNTS = np.zeros(256, bool)
_COUNTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: First and last letters of scripts.
_SCRIPTS = [
    (0x100, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE2E),
    (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]


@dataclass
class Network:
    """Weights. E: what a byte adds to the gates; U, C: from the state; W, b: to the labels, and to no language if there is a row more."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int, none: int = 0) -> Network:
        r, k = np.random.default_rng(seed), len(labels) + none
        w: dict[str, np.ndarray] = {"W": r.normal(0, 0.3, (k, 2 * hidden)), "b": np.zeros((k, 1))}
        for d in "fb":
            w[f"E{d}"] = r.normal(0, 0.4, (3 * hidden, 256))
            w[f"U{d}"] = r.normal(0, 0.4 / np.sqrt(hidden), (2 * hidden, hidden))
            w[f"C{d}"] = r.normal(0, 0.4 / np.sqrt(hidden), (hidden, hidden))
        return Network(labels, {k: v.astype(np.float32) for k, v in w.items()})


def _states(w: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch) of one direction over bytes x (time, batch).

    A unit keeps its state as far as its gate z is shut, and else takes a candidate made of
    the byte and the state seen through its gate r. ``keep`` gets what training needs.
    """
    e, u, c = w[f"E{d}"], w[f"U{d}"], w[f"C{d}"]
    hidden, (steps, batch) = c.shape[0], x.shape
    out = np.empty((steps, hidden, batch), np.float32)
    h = np.zeros((hidden, batch), np.float32)
    given = np.empty((3 * hidden, batch), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(e, x[t], axis=1, out=given, mode="clip")
        gates = u @ h
        gates += given[: 2 * hidden]
        gates *= 0.5  # the logistic function by tanh
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:hidden], gates[hidden:]
        seen = r * h
        new = c @ seen
        new += given[2 * hidden :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((t, h, z, r, seen, new))
            h = h + z * (new - h)
        else:
            new -= h
            new *= z
            new += h
            h = new
        out[t] = h
    return out


def _probabilities(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Softmax of the labels at every position: (time, label, batch)."""
    hidden = forward.shape[1]
    p = w["W"][:, :hidden] @ forward
    p += w["W"][:, hidden:] @ backward
    p += w["b"]
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over counted positions, and its gradients by backpropagation through time."""
    hidden, keeps = w["Cf"].shape[0], {"f": [], "b": []}
    states = {d: _states(w, d, x, keeps[d]) for d in "fb"}
    p = _probabilities(w, states["f"], states["b"])
    counted = _COUNTS[x].astype(np.float32)
    total = max(1.0, float(counted.sum()))
    batch = np.arange(x.shape[1])
    loss = -float((np.log(p[:, y, batch] + 1e-9) * counted).sum()) / total
    p[:, y, batch] -= 1
    p *= counted[:, None, :] / total
    both = np.concatenate([states["f"], states["b"]], axis=1)
    g = {"W": np.einsum("tlb,thb->lh", p, both, optimize=True), "b": p.sum(axis=(0, 2))[:, None]}
    back = np.einsum("lh,tlb->thb", w["W"], p, optimize=True)
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        u, c = w[f"U{d}"], w[f"C{d}"]
        gu, gc, ge = np.zeros_like(u), np.zeros_like(c), np.zeros_like(w[f"E{d}"])
        dh = np.zeros_like(back[0, part])
        for t, h, z, r, seen, new in reversed(keeps[d]):
            dh = dh + back[t, part]
            d_new = dh * z * (1 - new * new)
            d_seen = c.T @ d_new
            d_gates = np.concatenate([dh * (new - h) * z * (1 - z), d_seen * h * r * (1 - r)])
            gu += d_gates @ h.T
            gc += d_new @ seen.T
            np.add.at(ge.T, x[t], np.concatenate([d_gates, d_new]).T)
            dh = dh * (1 - z) + d_seen * r + u.T @ d_gates
        g |= {f"U{d}": gu, f"C{d}": gc, f"E{d}": ge}
    return loss, g


def nonsense(windows: list[str], seed: int = 7) -> list[str]:
    """The windows with their letters shuffled, drawn from a to z, or drawn from one other script, in turn."""
    r, out = random.Random(seed), []
    for n, window in enumerate(windows):
        signs = list(window)
        at = [i for i, c in enumerate(signs) if c.isalpha()]
        if n % 3 == 0:
            new = [signs[i] for i in at]
            r.shuffle(new)
        else:
            low, high = (97, 122) if n % 3 == 1 else r.choice(_SCRIPTS)
            new = [chr(r.randint(low, high)) for _ in at]
        for i, c in zip(at, new):
            signs[i] = c
        out.append("".join(signs))
    return out


def train(
    windows: list[bytes], labels: list[str], none: list[bytes] = [], hidden: int = HIDDEN, epochs: int = 8, batch: int = 128,
    rate: float = 0.02, seed: int = 7,
) -> Network:
    """Fits a network to labelled windows of at most ``WIDTH`` bytes, and windows of no language, by Adam."""
    names = sorted(set(labels))
    net = Network.fresh(names, hidden, seed, bool(none))
    if len(names) < 2:
        return Network.fresh(names, hidden, seed)
    windows = windows + none
    x = np.zeros((len(windows), WIDTH), np.uint8)
    for i, b in enumerate(windows):
        x[i, : len(b[:WIDTH])] = np.frombuffer(b[:WIDTH], np.uint8)
    y = np.array([names.index(v) for v in labels] + [len(names)] * len(none))
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps = max(300, epochs * len(x) // batch)
    for step in range(1, steps + 1):
        pick = r.integers(0, len(x), batch)
        _, g = _gradients(net.weights, np.ascontiguousarray(x[pick].T), y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        now = rate * (1 - 0.9 * step / steps) / max(1.0, norm)
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            v2[k] = 0.99 * v2[k] + 0.01 * a * a
            net.weights[k] -= (now * m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions, superscripts and other numbers are none."""
    return _ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text)))


def pooled(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and its mean probability for each text of a string array."""
    texts = texts.fill_null("") if texts.null_count else texts
    n, k = len(texts), len(net.labels)
    sums = np.zeros((n, len(net.weights["W"])))
    if k > 1:
        _, bounds, data = texts.buffers()
        at = np.frombuffer(bounds, np.int32)[texts.offset :][: n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(1, np.uint8)
        count = -(-np.diff(at) // WIDTH)
        doc = np.repeat(np.arange(n), count)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start, end = at[doc] + inside * WIDTH, at[doc + 1]
        for s in range(0, len(doc), _AT_ONCE):
            part = slice(s, s + _AT_ONCE)
            place = start[None, part] + np.arange(WIDTH)[:, None]
            x = np.where(place < end[None, part], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8)
            p = _probabilities(net.weights, _states(net.weights, "f", x), _states(net.weights, "b", x))
            p *= _COUNTS[x][:, None, :]
            each = p.sum(axis=0)
            for label in range(sums.shape[1]):
                sums[:, label] += np.bincount(doc[part], each[label], n)
    elif k:
        sums[:, 0] = 1
    total = sums.sum(axis=1)
    sums = sums[:, :k]
    best = sums.argmax(axis=1) if k else np.zeros(n, int)
    score = np.divide(sums.max(axis=1, initial=0), total, out=np.zeros(n), where=total > 0)
    names = []
    for i in range(n):
        known = total[i] > 0 and has_letter(texts[i].as_py())
        names.append(net.labels[best[i]] if known else UNKNOWN)
        if not known:
            score[i] = 0
    return names, np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 240, windows_each: int = 8, seed: int = 7,
) -> Network:
    """Trains on at most ``per_language`` × ``windows_each`` windows of each language of rows not held out.

    Only these windows (64 code points each) come to the driver.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = base.where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000))
    # counting reads no text; a language of n rows keeps about three times what is wanted
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    usable = usable.join(F.broadcast(counts), "lang")  # one row a language
    limit = F.lit(3_000_000 * per_language) / F.col("rows") + 1
    few = usable.where((drawn < limit) & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("drawn", "id")
    start = lambda i: F.pmod(F.xxhash64(F.col("id"), i), F.greatest(F.length("text") - WIDTH, F.lit(1))) + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(windows_each)), lambda i: F.substring(F.col("text"), start(i).cast("int"), F.lit(WIDTH)))
    rows = (
        few.select("id", "lang", drawn.alias("drawn"), cut.alias("cut"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= per_language)
        .select("lang", "n", "cut")
        .collect()
    )
    if not rows:
        return Network.fresh([], HIDDEN, seed)
    pairs = sorted({(r["lang"], r["n"], w) for r in rows for w in r["cut"] if w})
    none = nonsense([w for _, _, w in pairs[::2]], seed)
    return train([w.encode() for _, _, w in pairs], [lang for lang, _, _ in pairs], [w.encode() for w in none], seed=seed)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                names, score = pooled(net, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, and lang_pred and score after them; columns of these names give way."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, 2 << 20):
                names, score = pooled(net, part.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"]
                )

    return docs.mapInArrow(run, schema)
