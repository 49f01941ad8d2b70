"""Exact byte-pair encoding with a public vocabulary, by dynamic programming over prefixes.

For every prefix of a piece of text there is one token with which its encoding ends. Candidates for a prefix are the
vocabulary's entries that are suffixes of it, found by an automaton over the vocabulary; the candidate fits if the encoding of
the prefix before it ends with a token that may stand next to it. Two tokens may stand next to each other if no merge
across their border comes before the merges that made them. Following the tokens back gives the ids, without ever
simulating merges.

Defined cases: null and empty texts have no ids; strings of special tokens are ordinary text; text length is not limited.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the vocabulary's published pattern of pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A line break before a non-blank is a piece of its own, and what stands on its sides is cut alike without it.
_CUT = regex.compile(r"\n(?=\S)")
_PIECES = regex.compile(PATTERN)
MOST_PIECES, MOST_LINE_CHARS, MOST_PAIRS = 400_000, 12_000_000, 2_000_000


def _byte_of() -> dict[str, int]:
    """The vocabulary file's letters for bytes: printable ones stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece of text -> ids, filled on demand; emptied when full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MOST_PIECES:
            self.clear()
        found = self.encode(piece)
        if len(piece) < 200:
            self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str = DEFAULT_PATH) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of()
        as_bytes = lambda t: bytes(byte_of[x] for x in t).decode("latin-1")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        usable = {a + b for a, b in merges} | set(byte_of)
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t in usable}
        self.length = {i: len(t) for t, i in self.ids.items()}
        #: The two tokens that a merge joins; a single byte is its own halves. Ids of merged tokens ascend in merge order.
        self.halves = {i: (i, i) for t, i in self.ids.items() if len(t) == 1}
        self.joint: dict[tuple[int, int], int] = {}
        before = -1
        for a, b in merges:
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            if made <= before:
                raise ValueError("ids don't ascend in the order of merges")
            before = made
            self.joint.setdefault(pair, made)
            self.halves.setdefault(made, pair)
        if set(map(len, (t for t in self.ids if len(t) == 1))) != {1} or len(self.halves) != len(self.ids):
            raise ValueError("not a byte-level vocabulary")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.piece)
        self.newline = np.array(self.ids["\n"], np.int32).reshape(1)
        self.lines: dict[str, np.ndarray] = {}
        self.line_chars = 0

    def border(self, left: int, right: int) -> bool:
        """Can ``right`` follow ``left`` in an encoding? Takes the merges on both sides of the border apart, the latest first, and
        looks for a merge across it that would have come before the one taken apart."""
        until = 1 << 30
        while True:
            across = self.joint.get((left, right))
            if across is not None and across < until:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                until, left = left, inner_left
            else:
                # of equal merges the left one comes first, so one across the border at the same rank is in time
                until, right = right + 1, inner_right

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece that the pattern cut."""
        raw = text.encode("utf-8").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        n, length, fits = len(raw), self.length, self.fits
        last = [-1] * (n + 1)
        for end, token in self.automaton.iter(raw):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length[token]
            if start == 0:
                last[end + 1] = token
            elif (before := last[start]) >= 0:
                pair = (before, token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= MOST_PAIRS:
                        fits.clear()
                    ok = fits[pair] = self.border(before, token)
                if ok:
                    last[end + 1] = token
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return tuple(reversed(out))

    def line(self, text: str) -> np.ndarray:
        found = self.lines.get(text)
        if found is None:
            found = np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, _PIECES.findall(text))), np.int32)
            if self.line_chars > MOST_LINE_CHARS:
                self.lines.clear()
                self.line_chars = 0
            if len(text) < 5000:
                self.lines[text] = found
                self.line_chars += len(text) + 20
        return found

    def parts(self, text: str) -> list[np.ndarray]:
        """The ids of a text in consecutive parts."""
        out = []
        for line in _CUT.split(text):
            out += (self.line(line), self.newline)
        return out[:-1]

    def encode(self, text: str | None) -> list[int]:
        return np.concatenate(self.parts(text)).tolist() if text else []


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, a row at least."""
    step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """``id, ids``: a row per document. ``path`` is that of the vocabulary file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                parts, ends = [], [0]
                for text in batch.column(1).to_pylist():
                    own = enc.parts(text) if text else []
                    parts += own
                    ends.append(ends[-1] + sum(map(len, own)))
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return documents.select(documents[id_column].cast("bigint").alias("id"), documents[text_column].alias("text")).mapInArrow(run, "id bigint, ids array<int>")


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """``id, n_tokens``: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                sizes = [sum(map(len, enc.parts(text))) if text else 0 for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    return documents.select(documents[id_column].cast("bigint").alias("id"), documents[text_column].alias("text")).mapInArrow(run, "id bigint, n_tokens bigint")
