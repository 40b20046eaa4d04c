"""Exact merge-type piece encoding by backtracking, and decoding.

A merge-type model joins the best-scored adjacent pair again and again. A
segmentation is the model's own if and only if every two adjacent tokens, merged
anew on their own, come out as just these two: the first merge across a border would
also happen between the two tokens alone. So no merge queue runs over a text. An
Aho-Corasick automaton gives the tokens that start at each place; the longest that is
compatible with the token before is taken; at a dead end the last token is given up
for a shorter one. Since the tokens that reach a place are unique, a place found
dead is dead for good: one bit of a bitfield each. Work is linear in the text.

Words are encoded once and remembered (a memory per worker bounded in words and in their length), where the
vocabulary proves that no token crosses their border: none has a space sign after
another character, and none holds a line feed.

Characters outside the vocabulary become their UTF-8 bytes' tokens. Defined cases: null is
the empty text, which is the end id alone; decoding gives the text back with every
U+2581 as a blank, as the model's own library does. Rows are independent, so repeated
rows and extra columns don't matter.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_MEMORY = 100_000
_LONGEST = 64  # longer words are encoded anew each time, which bounds the memory in bytes too


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds: pieces with scores in id order, and the kind of each id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # n normal, c control, u unknown, b byte, one sign for each id
    end_id: int


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a model file on the driver. Only merge-type models with byte tokens and
    without text normalisation are accepted."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    kinds = {1: "n", 2: "u", 3: "c", 4: "x", 5: "x", 6: "b"}
    signs = "".join(kinds[p.type] for p in model.pieces)
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or "x" in signs or signs.count("b") != 256:
        raise ValueError("only merge-type models with byte tokens are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models without text normalisation are supported")
    ends = [i for i, p in enumerate(model.pieces) if p.type == 3 and p.piece == "</s>"]
    return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), signs, ends[0])


class Encoder:
    """Encodes and decodes within one worker."""

    def __init__(self, v: Vocabulary) -> None:
        self.score = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.kinds[i] == "n"}
        self.id = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "n"}
        self.byte = {int(v.pieces[i][3:5], 16): i for i in range(len(v.pieces)) if v.kinds[i] == "b"}
        self.end_id = v.end_id
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.score:
            self.automaton.add_word(p)
        self.automaton.make_automaton()
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.by_line = not any("\n" in p for p in self.score)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # the longest token that a token begins with, or else its first character
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.score), p[0]) for p in self.score if len(p) > 1}
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        surfaces = [self._surface(p, k) for p, k in zip(v.pieces, v.kinds)]
        firsts = [s[1:] if s[:1] == b" " and k == "n" else s for s, k in zip(surfaces, v.kinds)]
        self.surfaces = pa.array(surfaces + firsts, pa.binary())
        self.control = np.array([k == "c" for k in v.kinds])
        self.is_byte = np.array([k == "b" for k in v.kinds])

    @staticmethod
    def _surface(piece: str, kind: str) -> bytes:
        if kind == "b":
            return bytes([int(piece[3:5], 16)])
        return {"c": b"", "u": " ⁇ ".encode()}.get(kind) if kind in "cu" else piece.replace(SPACE, " ").encode()

    def merge(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The model's merges on a short text: best score first, leftmost among equals.

        Also returns, for each merge, its score and the first and last piece after it.
        """
        now, steps = list(text), []
        while len(now) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(now, now[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            now[at : at + 2] = [now[at] + now[at + 1]]
            steps.append((best, now[0], now[-1]))
        return now, steps

    def _history(self, token: str) -> list[tuple[float, str, str]]:
        """Its merges, after a first state without one; empty if they don't end in the token."""
        known = self.histories.get(token)
        if known is None:
            now, steps = self.merge(token)
            known = [(np.inf, token[0], token[-1]), *steps, (-np.inf, token, token)] if len(now) == 1 else []
            self.histories[token] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether two adjacent tokens, merged anew, stay these two. left "": a token alone.

        Merges within either happen in the order of their scores whatever the other does, as long
        as none crosses the border; so the two histories are replayed together and the pair at
        the border is looked up after each merge.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _MEMORY:
                self.pairs.clear()
            known = self.pairs[left, right] = self._replay(left, right)
        return known

    def _replay(self, left: str, right: str) -> bool:
        b = self._history(right)
        if not left or not b:
            return bool(b)
        a, score = self._history(left), self.score
        if not a:
            return False
        i = k = 0
        while True:
            cross = score.get(a[i][2] + b[k][1])
            one, two = a[i + 1][0] if i + 1 < len(a) else -np.inf, b[k + 1][0] if k + 1 < len(b) else -np.inf
            # among equal scores the leftmost goes first
            if cross is not None and cross > one and cross >= two:
                return False
            if one == two == -np.inf:
                return True
            if one >= two:
                i += 1
            else:
                k += 1

    def segment(self, text: str) -> list[str]:
        """The tokens of a text, by backtracking."""
        n, pairs, shorter = len(text), self.pairs, self.shorter
        # one run of the automaton: later ends overwrite earlier ones, so the longest match stays for each start
        longest = array("H", bytes(2 * n))
        for last, length in self.automaton.iter(text):
            longest[last + 1 - length] = length
        dead, marked = bytearray(n // 8 + 1), False
        out: list[str] = []
        at, left, token = 0, "", ""
        while True:
            if not token:
                token = text[at : at + (longest[at] or 1)]
            end = at + len(token)
            fits = pairs.get((left, token))
            if fits is None:
                fits = self.fits(left, token)
            if fits and not (marked and dead[end >> 3] >> (end & 7) & 1):
                out.append(token)
                if end == n:
                    return out
                at, left, token = end, token, ""
                continue
            token = shorter.get(token, "")
            while not token:
                dead[at >> 3] |= 1 << (at & 7)
                marked = True
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else ""
                token = shorter.get(token, "")

    def _ids(self, text: str) -> bytes:
        found: list[int] = []
        for token in self.segment(text):
            i = self.id.get(token)
            if i is None:
                found.extend(self.byte[b] for b in token.encode())
            else:
                found.append(i)
        return array("i", found).tobytes()

    def _word(self, word: str) -> bytes:
        """A word not among the recent ones; those of the generation before come back."""
        ids = self.before.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) > _LONGEST:
            return ids
        if len(self.known) >= _MEMORY:
            self.before, self.known = self.known, {}
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers, without the end id."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self._ids(text)
        out: list[bytes] = []
        for i, line in enumerate(text.split("\n") if self.by_line else [text]):
            if i:
                out.append(self.known.get("\n") or self._word("\n"))
            # cut before each space sign that follows another sign
            parts = line.split(SPACE)
            if "" in parts[1:] or len(parts) == 1:
                words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
            else:
                words = [SPACE + p for p in parts[1:]]
                if parts[0]:
                    words.insert(0, parts[0])
            get = self.known.get
            out += [get(w) or self._word(w) for w in words]
        return b"".join(out)

    def encode_all(self, texts: Sequence[str | None]) -> pa.ListArray:
        """Ids of each text, the end id last."""
        end = np.array([self.end_id], "<i4").tobytes()
        made = [self.encode(t or "") + end for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        values = values.astype(np.int64)
        content = np.flatnonzero(~self.control[values])
        first = np.searchsorted(content, offsets[:-1])
        first = content[first[first < len(content)]] if len(content) else content
        values[first] = values[first] % len(self.control) + len(self.control)
        surface = self.surfaces.take(pa.array(values))
        ends = np.frombuffer(surface.buffers()[1], np.int32)[: len(values) + 1]
        bounds = ends[offsets].astype(np.int32)
        data = surface.buffers()[2] or pa.py_buffer(b"")
        out = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(bounds.tobytes()), data])
        # bytes on both sides of a control id are no one character
        kind = np.where(self.control[ids.values], 0, np.where(self.is_byte[ids.values], 1, 2))
        split = bool(((kind[:-2] == 1) & (kind[1:-1] == 0)).any()) if len(kind) > 2 else False
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            split = True
        if split:
            out = pa.array([self._decode(x) for x in ids.to_pylist()], pa.string())
        return out

    def _decode(self, ids: list[int]) -> str:
        """The text of one list of ids, by runs of byte tokens."""
        parts, run, seen = [], b"", False
        n = len(self.control)
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surfaces[i].as_py()
                seen = True
                continue
            parts.append(run.decode("utf-8", "textloom-each"))
            run = b""
            if i >= 0 and not self.control[i]:
                parts.append(self.surfaces[i if seen else i + n].as_py().decode())
                seen = True
        return "".join(parts)

def _each_byte(e: UnicodeError) -> tuple[str, int]:
    """Every byte that is no part of a character becomes U+FFFD."""
    assert isinstance(e, UnicodeDecodeError)
    return "�", e.start + 1


_held: dict[int, tuple[Vocabulary, Encoder]] = {}


def encoder_of(v: Vocabulary) -> Encoder:
    """The worker's encoder for a vocabulary, made once."""
    key = hash((v.pieces[-1], len(v.pieces), v.scores[-1]))
    if key not in _held or _held[key][0] != v:
        codecs.register_error("textloom-each", _each_byte)
        _held[key] = (v, Encoder(v))
    return _held[key][1]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded) of every whole text, the end id included."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one model file's vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                ids = encoder.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, encoder.decode_all(ids)], ["id", "ids", "decoded"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
