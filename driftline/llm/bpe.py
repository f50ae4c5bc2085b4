"""Byte-level BPE encoding and decoding.

Bytes map to Latin-1 characters, so a pyahocorasick automaton of the vocabulary finds the longest token
at each place of a piece that encoding comes to; shorter ones are its prefixes. Encoding takes the longest match whose pair with
the previous token is compatible (the two tokens are what BPE makes of their joined bytes), falls
back to shorter ones, and backtracks when none is. A prefix of a piece has exactly one valid
encoding, so a place that led nowhere is never entered again and the work is linear. Pair
compatibility is decided by undoing merges at the border, and memoised.

Defined results: a null text counts as empty; an empty text has no ids; any text works, as all 256
single bytes are tokens; a long piece costs time and memory in proportion to its length.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import append_columns, kept

#: Encodings of short pieces are memoised by each Python worker, up to about so many bytes, twice over: a full memo is kept while the next one fills.
MEMO_BYTES, MEMO_LENGTH = 24 << 20, 48
#: Bytes of an entry of the memo besides its text and ids.
ENTRY_BYTES = 220
#: Pairs of tokens whose compatibility is decided by undoing merges at the border, and memoised (about 150 bytes each).
MEMO_PAIRS = 150_000
#: Ids that are decoded at once.
DECODE_STEP = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Shorter(dict):
    """The longest token that is a proper prefix of a token; -1 for none."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.ranks, self.tokens = encoder.ranks, encoder.tokens

    def __missing__(self, token: int) -> int:
        data = self.tokens[token]
        found = self[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return found


class Encoder(dict):
    """Encodes pieces; as a dict it memoises the ids of short ones."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.auto = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.auto.add_word(token.decode("latin-1"), (rank, len(token)))
        self.auto.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.shorter = Shorter(self)
        self.before: dict[str, tuple[int, ...]] = {}
        self.weight = 0
        self.split = regex.compile(pattern).findall

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins: (-1, -1) for a single byte, None if merging never makes the token."""
        try:
            return self.split_of[token]
        except KeyError:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            last = (-1, -1)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                joined = parts[best] + parts[best + 1]
                if joined not in self.ranks:
                    last = None
                    break
                last = self.ranks[parts[best]], self.ranks[parts[best + 1]]
                parts[best : best + 2] = [joined]
            self.split_of[token] = last
            return last

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side; left -1: whether a token is made at all.

        Merges are undone on both sides of the border, the latest first; the tokens fit if at no time a merge
        across the border came before the merge that was really made (of equal ones the left is made).
        """
        key = left, right
        fits = self.halves(right) is not None
        if fits and left >= 0:
            get, tokens, before = self.ranks.get, self.tokens, 1 << 60
            while True:
                across = get(tokens[left] + tokens[right])
                if across is not None and across < before:
                    fits = False
                    break
                inner, outer = self.halves(left)[1], self.halves(right)[0]
                if inner >= 0 and (left > right or outer < 0):
                    before, left = left, inner
                elif outer >= 0:
                    before, right = right + 1, outer
                else:
                    break
        self.fits[key] = fits
        return fits

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size, fits, latin, tokens, shorter = len(data), self.fits, data.decode("latin-1"), self.tokens, self.shorter
        longest = {end - match[1] + 1: match[0] for end, match in self.auto.iter_long(latin)}
        ids: list[int] = []
        dead: set[int] = set()
        pos, left, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = pos + len(tokens[token])
                ok = fits.get((left, token))
                if ok is None:
                    ok = self.compatible(left, token)
                if ok and end not in dead:
                    break
                token = shorter[token]
            else:
                dead.add(pos)
                token = ids.pop()
                pos -= len(tokens[token])
                left, token = ids[-1] if ids else -1, shorter[token]
                continue
            ids.append(token)
            if end == size:
                return tuple(ids)
            pos, left = end, token
            token = longest.get(pos, -1)
            if token < 0:
                token = longest[pos] = next(self.auto.iter_long(latin, pos))[1][0]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode())
        if len(piece) <= MEMO_LENGTH:
            if self.weight >= MEMO_BYTES:  # what is still in use comes back from the memo before
                self.before = dict(self)
                self.clear()
                self.weight = 0
            self[piece] = ids
            self.weight += ENTRY_BYTES + len(piece) + 8 * len(ids)
        if len(self.fits) > MEMO_PAIRS:
            self.fits.clear()
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, by rank, with where each starts and its size. Ranks that no token has are empty."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _encode_batch(path: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    """From texts to lists of ids."""
    bpe = encoder(path, pattern)
    kept["bpe"] = encoder.cache_clear

    def work(texts: pa.Array) -> pa.Array:
        offsets, parts = [0], [np.zeros(0, np.int32)]
        for value in texts.to_pylist():
            ids = bpe.encode(value) if value else []
            parts.append(np.array(ids, dtype=np.int32))
            offsets.append(offsets[-1] + len(ids))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))

    return work


def _decode_batch(path: str) -> Callable[[pa.Array], pa.Array]:
    """From lists of ids to bytes."""
    table, starts, sizes = token_bytes(path)

    def work(lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy().cumsum()
        parts = []
        for a in range(0, len(flat), DECODE_STEP):
            some = flat[a : a + DECODE_STEP]
            size = sizes[some]
            stop = np.cumsum(size)
            parts.append(table[np.repeat(starts[some] - stop + size, size) + np.arange(stop[-1])])
        data = np.concatenate(parts) if parts else table[:0]
        bounds = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], ends])]
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    return work


_IDS, _BYTES = T.ArrayType(T.IntegerType()), T.BinaryType()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the token ids of ``text`` as ``array<int>``; each match of ``pattern`` is encoded separately."""

    def make():
        ids_of = _encode_batch(path, pattern)
        return lambda batch: [ids_of(batch.column(batch.schema.get_field_index(text)))]

    return append_columns(df, [T.StructField(out, _IDS)], make, keep, "bpe")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "bytes", keep: list[str] | None = None) -> DataFrame:
    """Add the bytes that the token ids stand for; null ids count as none."""

    def make():
        bytes_of = _decode_batch(path)
        return lambda batch: [bytes_of(batch.column(batch.schema.get_field_index(ids)))]

    return append_columns(df, [T.StructField(out, _BYTES)], make, keep, "bpe")


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode``, in one Python worker for each task where two in a row would take two."""

    def make():
        ids_of, bytes_of = _encode_batch(path, pattern), _decode_batch(path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = ids_of(batch.column(batch.schema.get_field_index(text)))
            return [lists, bytes_of(lists)]

        return work

    return append_columns(df, [T.StructField(ids, _IDS), T.StructField(out, _BYTES)], make, keep, "bpe")
