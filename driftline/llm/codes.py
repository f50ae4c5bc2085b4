"""Vector code compression: integer product codes with codebooks trained by exact k-means.

Components become floor(256 * x). A vector is cut into ``PARTS`` equal parts; each part position has a codebook of
``ENTRIES`` integer entries, which start as those parts of the vectors with the smallest ids. In each round the
codebooks are broadcast (their size is fixed: entries times components), Arrow batches work out all distances to
the entries by norm expansion and integer matrix products, and the sums of each entry's parts are merged by one
grouped shuffle: what reaches the driver is a codebook, whatever the number of vectors.

Exact: distances are int64 where they cannot overflow, else Python's integers; sums are added up as decimals. An error
beyond int64 is an error, not a wrong number.

Defined results: vectors null or with null or non-finite components are dropped; shorter vectors (empty ones too) count as
padded with zeros, up to a multiple of the parts; of rows with one id the smallest vector can start an entry; rows without id are coded
and start entries last; repeated rows are coded alike and weigh each; ties go to the lower entry; with fewer vectors than
entries there are fewer entries; no vectors give no rows. The label of a row may be null, which is a label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns, cut, map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells of a matrix of distances, and labels whose sums are broadcast.
CELLS, BROADCAST_LABELS, SALTS = 1 << 20, 200_000, 64
_LIMIT = 2**63 - 1


def fit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    return df.where(F.col(vector).isNotNull()).where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64 where squares of differences cannot overflow, else Python integers."""
    scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2**24:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        scaled = np.array([float(v).as_integer_ratio() for v in values.ravel()], dtype=object).reshape(*values.shape, 2)
        return scaled[..., 0] * SCALE // scaled[..., 1]
    return np.vectorize(int, otypes=[object])(scaled)


def quantise(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integer components, padded with zeros to ``width``."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = _whole(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lists), width), dtype=flat.dtype)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (rows by parts) and its squared distance: |x|^2 - 2 x.c + |c|^2."""
    wide = x.dtype == object or any(b.dtype == object for b in books)
    n, each = len(x), x.shape[1] // len(books)
    codes, errors = np.zeros((n, len(books)), dtype=np.int64), np.zeros((n, len(books)), dtype=object if wide else np.int64)
    for p, book in enumerate(books):
        own = x[:, p * each : (p + 1) * each]
        if wide:
            own, book = own.astype(object), book.astype(object)
        square = (book * book).sum(axis=1) if each else np.zeros(len(book), dtype=np.int64)
        step = max(1, CELLS // max(1, len(book)))
        for a in range(0, n, step):
            some = own[a : a + step]
            far = square - 2 * (some @ book.T) if each else np.zeros((len(some), len(book)), dtype=np.int64)
            best = far.argmin(axis=1)
            codes[a : a + step, p] = best
            errors[a : a + step, p] = far[np.arange(len(some)), best] + ((some * some).sum(axis=1) if each else 0)
    return codes, errors


def _seeds(fit: DataFrame, vec_id: str, vector: str, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks made of the vectors with the smallest ids."""
    ids = [r[0] for r in fit.select(vec_id).distinct().orderBy(F.col(vec_id).asc_nulls_last()).limit(entries).collect()]
    wanted = F.col(vec_id).isin([i for i in ids if i is not None])
    first = fit.where(wanted | F.col(vec_id).isNull() if None in ids else wanted).groupBy(F.col(vec_id).alias("_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("_v"))
    rows = [r["_v"] for r in first.orderBy(F.col("_id").asc_nulls_last()).collect()]
    x = quantise(pa.array(rows, pa.list_(pa.float64())), width)
    each = width // parts
    return [x[:, p * each : (p + 1) * each] for p in range(parts)]


def _round(fit: DataFrame, vector: str, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each used entry becomes the floor of the mean of its parts."""
    shared = fit.sparkSession.sparkContext.broadcast(books)
    each, parts = width // len(books), len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        entries = len(own[0])
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, each), dtype=object)
        for b in batches:
            x = quantise(b.column(0), width)
            codes, _ = assign(x, own)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                sums = np.zeros((entries, each), dtype=x.dtype)
                np.add.at(sums, codes[:, p], x[:, p * each : (p + 1) * each])  # a batch is far from overflow
                total[p] += sums
        p, e = np.nonzero(count)
        again = lambda v: pa.array(np.repeat(v, each + 1), pa.int32())
        values = [v for i, j in zip(p, e) for v in (int(count[i, j]), *map(int, total[i, j]))]
        at = [v for _ in p for v in (-1, *range(each))]
        if max(map(abs, values), default=0) > 10**37:
            raise OverflowError("sums of components are beyond 37 digits")
        for a in range(0, len(values), 20_000):
            s = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([again(p)[s], again(e)[s], pa.array(at[s], pa.int32()), pa.array(list(map(str, values[s])))], names=["part", "entry", "place", "value"])

    sums = map_batches(fit.select(F.col(vector).cast("array<double>").alias("x")), run, "part int, entry int, place int, value string")
    merged = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    by_place = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in merged.collect()}  # a codebook and its counts
    new = []
    for p, book in enumerate(books):
        rows = [[by_place[p, e, i] // by_place[p, e, -1] for i in range(each)] if (p, e, -1) in by_place else [int(v) for v in row] for e, row in enumerate(book)]
        small = all(abs(v) < 2**24 for row in rows for v in row)
        new.append(np.array(rows, dtype=np.int64 if small else object).reshape(len(book), each))
    shared.unpersist()
    return new


def train(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries by components) for each part position; empty ones where there are no vectors."""
    fit = fit_vectors(df, vector)
    longest = fit.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = _seeds(fit, vec_id, vector, width, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = _round(fit, vector, width, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default: all) with codes (an array: an entry for each part) and error of every fit vector."""
    if not len(books[0]):
        return df.limit(0).select(*(df.columns if keep is None else keep), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    shared = df.sparkSession.sparkContext.broadcast(books)
    width = len(books) * books[0].shape[1]
    plain = fit_vectors(df, vector).withColumn(vector, F.col(vector).cast("array<double>"))

    def make():
        def work(b: pa.RecordBatch) -> list[pa.Array]:
            codes, errors = assign(quantise(b.column(b.schema.get_field_index(vector)), width), shared.value)
            error = errors.sum(axis=1)
            if errors.dtype == object and max(error, default=0) > _LIMIT:
                raise OverflowError("an error is beyond 64 bits")
            return [pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array([int(v) for v in error], pa.int64())]

        return work

    return append_columns(plain, [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())], make, keep)


def decode(coded: DataFrame, books: list[np.ndarray], codes: str = "codes", out: str = "approximate") -> DataFrame:
    """Add the vector that the codes stand for: the entries' components over ``SCALE``."""
    if not len(books[0]):
        return coded.withColumn(out, F.array().cast("array<double>"))
    table = F.array(*[F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in row]) for row in book]) for book in books])
    return coded.withColumn("_books", table).withColumn(out, F.flatten(F.zip_with("_books", F.col(codes), lambda book, code: F.get(book, code)))).drop("_books")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add label_error: errors summed over equal labels. Few labels are broadcast; many meet by label and salt, so a hot label is many tasks."""
    sums = cut(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")), "left").drop("_label", "_salt", "_own")


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, codes, error, label_error and codebooks_sha256 of every fit row."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    books = train(rows)
    coded = cut(encode(rows, books, keep=["vec_id", "label"]), "codes")
    return with_label_error(coded).select("vec_id", "codes", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
