"""URL filtering: host and path rules first, then logistic regression on hashed n-grams.

Host: what stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case.
Path: what follows, up to "?", "#" or the end. A rule names a host and the start of a path, fits the
host and its subdomains, and the longest fitting rule decides. Where none fits, a logistic
regression over hashed character n-grams of host and path decides; it is trained from a
small labelled table of URLs (``labelled_urls``), which may be a file.

Defined cases: a null URL or one without "://" has empty host and path, no rule, and the
model's verdict on an empty URL, which rests on its bias. Rows are independent.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SIZES = (3, 4, 5)
BUCKETS = 1 << 16

# Words of hosts and paths that are to be blocked, and of others.
BLOCKED_WORDS = (
    "casino slots poker bet jackpot roulette viagra cialis pills pharma meds xxx porn adult cams sex escort adserver banner popup clicktrack "
    "warez keygen crack torrent nulled lottery prize payday loan forex bitcoin-double replica spam seo-links verify-login hacked free-money"
).split()
ALLOWED_WORDS = (
    "university research encyclopedia news blog docs library museum school weather forum recipes journal books government travel sports hospital science "
    "community photos code podcast music archive company health garden history physics manual city maps theatre nature kitchen language"
).split()
BLOCKED_PATHS = ("bonus/win", "free/spins", "buy/cheap", "order/now", "watch/hd", "live/chat", "track?id=", "download/full", "claim/now", "account/verify")
ALLOWED_PATHS = ("articles/2019", "wiki/main", "posts/how-to", "about/team", "catalogue/items", "courses/lesson", "topics/roses", "texts/1910", "exhibits/art", "en/page")
ENDINGS = ("com", "org", "net", "info", "io", "de", "fr", "example")


def labelled_urls(path: str | None = None) -> list[tuple[str, int]]:
    """The small labelled table, label 1 for block: (url, label) lines of a CSV file that ``path`` names, or else one
    made by rule: each word as a host in four shapes, with an ending and a path that follow its place in the list."""
    if path:
        with open(path, encoding="utf-8", newline="") as f:
            return [(r[0], int(r[1])) for r in csv.reader(f) if len(r) > 1 and r[1] in ("0", "1")]
    out = []
    for words, paths, label in ((BLOCKED_WORDS, BLOCKED_PATHS, 1), (ALLOWED_WORDS, ALLOWED_PATHS, 0)):
        for i, word in enumerate(words):
            for k, host in enumerate((word, f"www.{word}", f"{word}-{words[(i + 7) % len(words)]}", f"m.{words[(i + 3) % len(words)]}{word}")):
                scheme = ("http", "https")[(i + k) % 2]
                out.append((f"{scheme}://{host}.{ENDINGS[(i + 3 * k) % len(ENDINGS)]}/{paths[(i + k) % len(paths)]}{i}", label))
                out.append((f"{scheme}://{host}.{ENDINGS[(i + 5 * k + 1) % len(ENDINGS)]}/{i * 37 + k}.html", label))
    return out


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits; null if none does. ``rules``: the operator's few hand-written ones."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        of, start = rule[:at], rule[at:]
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram (by UTF-8 bytes) of the texts."""
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    length = np.array([len(b) for b in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), length)
    end = np.cumsum(length)[row] if len(raw) else row
    rows, found = [], []
    for size in SIZES:
        at = np.flatnonzero(np.arange(len(data)) + size <= end)
        h = np.full(len(at), 1469598103934665603 + size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = (h ^ data[at + k]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(32)
        rows.append(row[at])
        found.append((h % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class UrlModel:
    """Weights of hashed n-grams, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that each host and path is to be blocked."""
        rows, found = _features(texts, len(self.weights))
        total = np.bincount(rows, self.weights[found], len(texts))
        norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(texts))))
        return 1 / (1 + np.exp(-(total / norm + self.bias)))


def train(labelled: Sequence[tuple[str, int]], buckets: int = BUCKETS, steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> UrlModel:
    """Logistic regression by gradient descent on (host and path, label) of a small table. No row: everything is even."""
    texts, y = [t for t, _ in labelled], np.array([v for _, v in labelled], float)
    rows, found = _features(texts, buckets)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(texts))))
    w, b = np.zeros(buckets), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[found], len(texts)) * scale + b)))
        error = (p - y) / max(1, len(texts))
        w -= rate * (np.bincount(found, (error * scale)[rows], buckets) * 10 + decay * w)
        b -= rate * error.sum()
    return UrlModel(w.astype(np.float32), float(b))


def split_url(url: str) -> str:
    """Host and path of a labelled URL, joined as the model sees them."""
    rest = url.partition("://")[2]
    for sign in "?#":
        rest = rest.partition(sign)[0]
    host, slash, path = rest.partition("/")
    return host.lower() + slash + path


def fitted(path: str | None = None) -> UrlModel:
    """The model of the labelled table."""
    return train([(split_url(u), v) for u, v in labelled_urls(path)])


def judged(
    pages: DataFrame, model: UrlModel | None = None, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every URL; score is the model's probability of block."""
    model = model or fitted()
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts))], [*batch.schema.names, "score"])

    kind = base.schema["id"].dataType.simpleString()
    scored = base.mapInArrow(run, f"id {kind}, host string, path string, score double")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for name, decision in rules:
        verdict = F.when(F.col("rule") == name, decision).otherwise(verdict)
    return scored.withColumn("rule", rule).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
