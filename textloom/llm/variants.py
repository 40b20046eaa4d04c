"""Spelling variants: words one code point apart, found by rolling-hash deletions.

Runs of letters are cut, lower-cased and counted by numpy and Arrow inside tasks, so that each task
sends a word once for each piece of text. Counts are summed by Spark.

A word's code points have polynomial hashes of all its prefixes and suffixes; from these comes the
64-bit hash of the word without its i-th code point for every i at once, without building one string. Two words are
one replacement apart just if both lose the same position and become the same, and one insertion apart just if one of
them becomes the other. So a row of three numbers goes out for each deletion, and one for the word itself, under the
hash of what is left. Spark deals them by the hash's leading bits and sorts each partition by the hash
(long keys are sorted by radix); a task reads one run of equal keys after the other. Rows that
meet another word there are joined with the words, and what is left is built as a string and compared, so a collision of hashes links nothing.

What is left of a word has at most one more letter at a place, so the words that meet under a key and position are
no more than the alphabet has letters, and no key is hot, whatever the counts. Nor are pairs sent: each word of a run
gets how many it is near to there, and the commonest; the sums and the commonest of all runs are the word's.
Every pair of near words meets in one key only.

The form of a word is its near word of largest count (ties: the smallest in code-point order), if that is at
least five times its own. Following forms, counts grow fivefold each time; roots are found by doubling.

Defined cases: null and empty texts have no runs; a null id is hashed as no characters; rows count each for
itself, so repeated rows count again; an empty table gives an empty table. Only the two columns named are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import Words, pieces
from textloom.llm.common import dropped, written
from textloom.llm.crc import appended, crc32, with_byte

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
EVERY = 199
_RADIX_BITS = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The first byte of U+00C0 to U+00FF in UTF-8; one byte follows it.
_LEAD = 0xC3
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inside(data: np.ndarray) -> np.ndarray:
    lead = data == _LEAD
    out = _LETTER[data] | lead
    out[1:] |= lead[:-1]
    return out


def runs(ids: pa.Array, texts: pa.Array, every: int = EVERY) -> pa.Array:
    """Every run of letters of the texts, A-Z lower-cased, as strings; one in ``every``, drawn by id and run, lost a letter."""
    found = Words(texts, lower=True, inside=_inside)
    size = found.end - found.start
    letters = np.zeros(len(found.data) + 1, np.int64)
    np.cumsum((found.data & 0xC0) != 0x80, out=letters[1:])
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    place = np.arange(bounds[-1]) + np.repeat(found.start - bounds[:-1], size)
    made = pa.StringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(found.data[place]))
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    h = appended(np.repeat(before, np.diff(found.offsets)), crc32(found.data, found.start, found.end), size)
    hit = np.flatnonzero(h % every == 0)
    if not len(hit):
        return made
    count = (letters[found.end] - letters[found.start])[hit]
    changed = []
    for word, cut in zip(made.take(pa.array(hit)).to_pylist(), (h[hit] % count).tolist()):
        changed.append(word[:cut] + word[cut + 1 :])
    rest = np.ones(len(size), bool)
    rest[hit] = False
    return pa.concat_arrays([made.filter(pa.array(rest)), pa.array(changed, pa.string())])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, every: int = EVERY) -> DataFrame:
    """(word, n) over all texts, for words of so many code points at least."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                made = runs(part.column(0), part.column(1), every)
                got = pc.value_counts(made.filter(pc.greater_equal(pc.utf8_length(made), least_letters)))
                yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    return base.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, position, key, new) of every deletion of every word, and of the word itself at position -1.

    new is false where the letter before is the same, as that deletion leaves the same.
    """
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = int(size.max(initial=0))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(code)) - start[word]
        value = code * (code ^ np.uint64(0xC2B2AE3D27D4EB4F))
        # sums over all words; a difference of two is a prefix or suffix. A letter at i stands for value * base^i
        here, left = value * power[pos], value * power[np.maximum(pos - 1, 0)]
        sums = np.r_[np.uint64(0), np.cumsum(here, dtype=np.uint64)]
        moved = np.r_[np.uint64(0), np.cumsum(left, dtype=np.uint64)]
        end = start + size
        prefix = sums[start[word] + pos] - sums[start[word]]
        suffix = moved[end[word]] - moved[start[word] + pos + 1]  # one place nearer
        keys = np.r_[prefix + suffix, sums[end] - sums[start]]
        keys ^= keys >> np.uint64(31)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    new = np.ones(len(code) + len(words), bool)
    new[1 : len(code)] = (code[1:] != code[:-1]) | (pos[1:] == 0)
    return np.r_[word, np.arange(len(words))], np.r_[pos, np.full(len(words), -1)], keys.view(np.int64), new


def _keyed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(radix, key, wid, pos, new) from (wid, word)."""
    for batch in batches:
        for part in pieces(batch, 1, 1 << 16):
            at, pos, key, new = deletion_keys(part.column(1).to_pylist())
            if bits < 64:
                key = key & ((1 << bits) - 1)
            radix = (key.view(np.uint64) >> np.uint64(max(0, min(bits, 64) - _RADIX_BITS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key), part.column(0).take(pa.array(at)), pa.array(pos.astype(np.int32)), pa.array(new)], ["radix", "key", "wid", "pos", "new"])


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole runs of equal keys, one run or several at once; rows come sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = now if held is None else pa.concat_tables([held, now])
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and len(held):
        yield held


_WHOLE, _SHORTER, _REPLACED = 0, 1, 2


def _met(table: pa.Table) -> pa.RecordBatch:
    """(key, wid, pos, how) of the rows that meet another word under their key, from whole runs of keys.

    A word itself and, where there is one, the deletions of other words that leave something new stand for insertions; deletions of
    different words at one position stand for replacements. All other rows go.
    """
    key, wid, pos, other = (table[c].to_numpy() for c in ("key", "wid", "pos", "new"))
    order = np.lexsort((wid, pos, key))
    key, wid, pos, other = key[order], wid[order], pos[order], other[order]
    new = np.r_[True, key[1:] != key[:-1]]
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    several = (np.minimum.reduceat(wid, first) != np.maximum.reduceat(wid, first))[of]
    whole = np.bitwise_or.reduceat((pos < 0).astype(np.int8), first).astype(bool)[of]
    place = np.r_[True, new[1:] | (pos[1:] != pos[:-1])]
    at = np.cumsum(place) - 1
    begin = np.flatnonzero(place)
    replaced = (pos >= 0) & (np.minimum.reduceat(wid, begin) != np.maximum.reduceat(wid, begin))[at]
    parts = [(_WHOLE, several & (pos < 0)), (_SHORTER, several & whole & other & (pos >= 0)), (_REPLACED, replaced)]
    kept = [np.flatnonzero(x) for _, x in parts]
    how = np.repeat([k for k, _ in parts], [len(x) for x in kept]).astype(np.int32)
    rows = np.concatenate(kept)
    return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(wid[rows]), pa.array(pos[rows]), pa.array(how)], ["key", "wid", "pos", "how"])


def _near(table: pa.Table) -> dict[str, list]:
    """For each word of a table of whole runs (key, how, pos, word, n): how many words it is near to there, and the commonest with its count."""
    groups: dict[tuple[int, str], list[tuple[int, int, int, str]]] = defaultdict(list)
    for k, how, pos, word, n in zip(*(table[c].to_pylist() for c in ("key", "how", "pos", "word", "n"))):
        groups[k, word if pos < 0 else word[:pos] + word[pos + 1 :]].append((how, pos, -n, word))
    out: dict[str, list] = {c: [] for c in ("word", "n_near", "near", "near_n")}

    def put(word: str, others: int, best: tuple[int, str]) -> None:
        for c, v in zip(out, (word, others, best[1], -best[0])):
            out[c].append(v)

    for members in groups.values():
        whole = [(n, w) for how, _, n, w in members if how == _WHOLE]
        longer = [(n, w) for how, _, n, w in members if how == _SHORTER]
        if whole and longer:
            put(whole[0][1], len(longer), min(longer))
            for _, w in longer:
                put(w, 1, whole[0])
        by_place = defaultdict(list)
        for how, pos, n, w in members:
            if how == _REPLACED:
                by_place[pos].append((n, w))
        for at in by_place.values():
            if len(at) > 1:
                first, second = sorted(at)[:2]
                for x in at:
                    put(x[1], len(at) - 1, second if x == first else first)
    return out


def near_words(words: DataFrame, bits: int = 64) -> DataFrame:
    """(word, n_near, near, near_n): the near words of each of ``words`` (wid, word, n) that has any, and the commonest of them.

    Only keys, ids and positions are dealt and sorted; strings join the few rows that met another word.
    """
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = words.select("wid", "word").mapInArrow(lambda b: _keyed(b, bits), "radix int, key bigint, wid bigint, pos int, new boolean")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _equal_runs(batches):
            yield _met(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _equal_runs(batches):
            made = _near(table)
            yield pa.RecordBatch.from_arrays([pa.array(made["word"], pa.string()), pa.array(made["n_near"], pa.int64()), pa.array(made["near"], pa.string()), pa.array(made["near_n"], pa.int64())], ["word", "n_near", "near", "near_n"])

    met = written(keyed.repartition(parts, "radix").sortWithinPartitions("key").mapInArrow(meet, "key bigint, wid bigint, pos int, how int"), "met")
    told = met.join(words, "wid").select("key", "how", "pos", "word", "n").repartition("key").sortWithinPartitions("key")
    found = told.mapInArrow(judge, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.o")).alias("near_n"))


def _roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) from (word, form), by doubling; counts grow along forms, so there are no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = then.where("moved").limit(1).count()
        dropped(now)
        now = then.select("word", "root")
        if not moved:
            return now
    raise RuntimeError(f"roots did not settle in {most_rounds} rounds")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
    ratio: int = RATIO, every: int = EVERY, bits: int = 64,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of all texts that is long and common enough.

    ``bits`` of the keys may be fewer in tests, which makes them collide.
    """
    counts = word_counts(docs, id_col, text_col, least_letters, every).where(F.col("n") >= least_count)
    words = written(counts.withColumn("wid", F.monotonically_increasing_id()), "words")
    near = words.join(near_words(words, bits), "word", "left")
    enough = F.col("near_n") >= ratio * F.col("n")
    made = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "near")
    roots = _roots(made.where("form IS NOT NULL"))
    return made.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
