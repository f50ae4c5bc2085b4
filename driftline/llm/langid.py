"""Language ID by prediction by partial matching (PPM).

For each language a byte context tree of contexts up to ``ORDER`` bytes is counted. The probability of
a byte in its longest known context is count / (total + distinct); if the byte was never seen there, the
code pays the escape distinct / (total + distinct) and goes on in the next shorter context, down to a
uniform code over 256 bytes (escape method C, no exclusion). The statistics are frozen after learning,
so the code length of a text is a sum over its bytes. The language with the shortest code wins; the
score is its posterior under equal priors.

Learning reads at most about ``SAMPLE`` labelled documents of each language (drawn by a hash of the
text, copies counting once; one at least), counted by Spark jobs; the model is bounded by that sample and is broadcast. Code lengths of every
context and byte known to any language are laid out in one hash table for each order, so texts are scored
by vectorised look-ups, every byte of every text.

Defined results: a null text or one without letters gets ``und`` with score 0; without any labelled
documents every text gets ``und``; equal code lengths go to the language first in order of name. What
stands before a text counts as line ends, in learning and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns, map_batches

ORDER = 3
#: Documents of each language that are learnt from, about.
SAMPLE = 1500
_DRAWS = 1_000_000
GROUP_BYTES = 1 << 20
_PAD = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte with its ORDER predecessors (4 bytes), and where each text's bytes start."""
    data = np.frombuffer(_PAD + _PAD.join(texts), dtype=np.uint8).astype(np.uint32)
    keys = data[ORDER:].copy()
    for i in range(1, ORDER + 1):
        keys |= data[ORDER - i : len(data) - i] << np.uint32(8 * i)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + ORDER)]).astype(np.int64)
    return keys, starts


def _text_keys(texts: list[bytes]) -> np.ndarray:
    """Keys of the texts' own bytes only."""
    keys, starts = _grams(texts)
    own = np.zeros(len(keys) + 1, dtype=np.int32)
    np.add.at(own, starts, 1)
    np.add.at(own, starts + [len(t) for t in texts], -1)
    return keys[np.cumsum(own[:-1]) > 0]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> "Model":
    """Count context trees on about ``sample`` documents of each language. Rows without text or label are left out."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # copies of a text count once and are drawn alike, or the sample would have no bound, or nothing in it; each label has one at least
    named = rows.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("draw", F.pmod("h", F.lit(_DRAWS)))
    sizes = {r["lang"]: r for r in named.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return Model([], {})
    below = F.create_map(*[F.lit(x) for k, r in sizes.items() for x in (k, max(int(_DRAWS * min(1.0, sample / r["n"])), r["least"] + 1))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(_DRAWS)) < below[F.col("lang")]).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby("lang"):
                keys, counts = np.unique(_text_keys([t.encode() for t in part["text"]]), return_counts=True)
                if name in found:
                    old, was = found[name]
                    keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    counts = np.bincount(at, weights=np.concatenate([was, counts])).astype(np.int64)
                found[name] = keys, counts
        for name, (keys, counts) in found.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": name, "gram": keys.astype(np.int64), "n": counts.astype(np.int64)}), preserve_index=False)

    grams = map_batches(drawn, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    return Model(langs, {k: grams[grams["lang"] == k] for k in langs})


class Table:
    """Open-addressed look-up of uint32 keys; -1 for what is absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.slot_key = np.zeros(1 << self.bits, dtype=np.uint32)
        self.slot_row = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, step = np.arange(len(keys), dtype=np.int32), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.slot_row[at] < 0
            self.slot_row[at[free]] = todo[free]
            self.slot_key[at[free]] = keys[todo[free]]
            todo = todo[self.slot_row[at] != todo]
            step += 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.where(self.slot_key[slot] == keys, self.slot_row[slot], -1)
        pending = np.flatnonzero((found < 0) & (self.slot_row[slot] >= 0))
        for step in range(1, self.steps):
            if not len(pending):
                break
            at = (slot[pending] + step) & ((1 << self.bits) - 1)
            hit = (self.slot_key[at] == keys[pending]) & (self.slot_row[at] >= 0)
            found[pending[hit]] = self.slot_row[at[hit]]
            pending = pending[~hit & (self.slot_row[at] >= 0)]
        return found


class Model:
    """Frozen statistics. For each order a table of contexts (escape bits) and of context and byte (bits), for all languages."""

    def __init__(self, langs: list[str], grams: dict[str, pd.DataFrame]):
        self.langs = langs
        self.orders: list[tuple[Table, np.ndarray, Table, np.ndarray]] = []  # context rows, escape bits; symbol rows, bits
        counts = {k: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for k, g in grams.items()}
        lower_bits = np.full((1, len(langs)), 8.0)  # order -1
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            cut = {}
            for k, (keys, n) in counts.items():
                own, at = np.unique(keys & mask, return_inverse=True)
                cut[k] = own, np.bincount(at, weights=n, minlength=len(own))
            symbols = np.unique(np.concatenate([c[0] for c in cut.values()])) if langs else np.zeros(0, np.uint32)
            contexts = np.unique(symbols >> np.uint32(8))
            if order:
                below = self.orders[-1]
                rows = below[2].rows(symbols & np.uint32((1 << (8 * order)) - 1))
                base = below[3][rows]  # a suffix of a known string is known
            else:
                base = np.repeat(lower_bits, len(symbols), axis=0)
            bits, escapes = np.array(base, dtype=np.float64), np.zeros((len(contexts), len(langs)))
            for j, k in enumerate(langs):
                own, n = cut[k]
                context, at = np.unique(own >> np.uint32(8), return_inverse=True)
                total, distinct = np.bincount(at, weights=n), np.bincount(at)
                escapes[np.searchsorted(contexts, context), j] = -np.log2(distinct / (total + distinct))
                bits[:, j] += escapes[np.searchsorted(contexts, symbols >> np.uint32(8)), j]
                bits[np.searchsorted(symbols, own), j] = -np.log2(n / (total + distinct)[at])
            self.orders.append((Table(contexts), escapes.astype(np.float32), Table(symbols), bits.astype(np.float32)))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language; texts are not empty."""
        keys, starts = _grams(texts)
        costs = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            contexts, escapes, symbols, bits = self.orders[order]
            own = keys[todo] & np.uint32((1 << (8 * (order + 1))) - 1)
            rows = symbols.rows(own)
            hit = rows >= 0
            costs[todo[hit]] += bits[rows[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                break
            rows = contexts.rows(own >> np.uint32(8))
            known = rows >= 0
            costs[todo[known]] += escapes[rows[known]]
        else:
            costs[todo] += 8.0
        ends = starts + [len(t) for t in texts]
        cuts = np.stack([starts, ends], axis=1).reshape(-1)
        costs = np.concatenate([costs, np.zeros((1, len(self.langs)), np.float32)])
        return np.add.reduceat(costs, np.minimum(cuts, len(keys)), axis=0, dtype=np.float64)[::2]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior, and bits a byte under that language (0 for ``und``)."""
        langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores, rates
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        group, size = [], 0
        for i in [*some, None]:
            if i is not None:
                group.append((i, texts[i].encode()))
                size += len(group[-1][1])
            if group and (i is None or size >= GROUP_BYTES):
                bits = self.bits([t for _, t in group])
                best = bits.argmin(axis=1)
                weight = np.exp2(bits.min(axis=1)[:, None] - bits)
                for (k, data), b, p, r in zip(group, best, 1 / weight.sum(axis=1), bits.min(axis=1)):
                    langs[k], scores[k], rates[k] = self.langs[b], float(p), float(r) / len(data)
                group, size = [], 0
        return langs, scores, rates


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte``; only ``text`` is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            langs, scores, rates = model.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]

        return work

    return append_columns(df, fields, make, keep)
