"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors and queries are grouped by pivots, a bounded sample of the vectors. A group is summed up by its size
and radius (and its largest norm), so the score of a query with any member is at most
``pivot . query + radius * |query|``. First each query is solved in the group where it promises most,
which gives it a bound: its k-th best score so far. Then it goes to those other groups only whose bound
reaches that score, and is solved there locally. Groups are cut into blocks of ``BLOCK`` vectors and
``QUERY_BLOCK`` queries, so a large group is many tasks. Equal vectors are collapsed first, by packed
partial lists of their k + 1 smallest ids, so a hot vector is one row.

Components become floor(64 * x); scores are exact: sums stay below 2**53 or are made with Python's integers.

Defined results: vectors null, empty, or holding null or non-finite components take no part, nor do rows
without id; shorter vectors count as padded with zeros; a repeated id counts once; ties go to the smaller
id; with fewer than k candidates all are returned; no vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, map_batches

K = 20
QUERY_EVERY = 20
#: Pivots grow with the root of the number of vectors, as far as so many bytes of them are broadcast.
PIVOT_BYTES = 64 << 20
#: Bytes of different vectors that a task holds before it hands them on.
HELD_BYTES = 32 << 20
#: Distances worked out at once.
CELLS = 4 << 20
BLOCK, QUERY_BLOCK = 4096, 8192
_EXACT = 2.0**53


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(len(vecs), -1)


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as float64 where these are exact, else as Python integers."""
    if not queries.size or not data.size or np.abs(queries).max() * np.abs(data).max() * data.shape[1] < _EXACT:
        return queries @ data.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(data).T


def quantise(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec: floor(64 * x) of the components as packed doubles, padded to one length."""
    fit = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    fit = fit.where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    fit = fit.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    size = fit.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = lists.value_lengths().to_numpy()
            out = np.zeros((len(lists), size))
            row = np.repeat(np.arange(len(lists)), lengths)
            out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(64 * lists.flatten().to_numpy()) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["vec_id", "vec"])

    return map_batches(fit, run, "vec_id long, vec binary")


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """vec and its ``ids`` smallest vec_ids; combined in each task before the shuffle, in a table of ``HELD_BYTES``, then streamed in order of vec."""

    def batches_of(items: list[tuple[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(items), 2000):
            part = items[a : a + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(x))[:ids] for _, x in part], pa.list_(pa.int64())), pa.array([v for v, _ in part], pa.binary())], names=["ids", "vec"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0
        for b in batches:
            for one, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = held.get(vec)
                if own is None:
                    own = held[vec] = []
                    size += len(vec) + 200
                own.append(one)
                if len(own) > 4 * ids:
                    own[:] = sorted(set(own))[:ids]
            if size > HELD_BYTES:
                yield from batches_of(list(held.items()))
                held, size = {}, 0
        yield from batches_of(list(held.items()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[bytes, list[int]]] = []
        for b in batches:
            for some, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if done and done[-1][0] == vec:
                    done[-1] = vec, sorted({*done[-1][1], *some})[:ids]
                else:
                    if len(done) >= 2000:
                        yield from batches_of(done)
                        done = []
                    done.append((vec, some))
        yield from batches_of(done)

    near = map_batches(vectors.select("vec_id", "vec"), combine, "ids array<long>, vec binary")
    return map_batches(near.repartition("vec").sortWithinPartitions("vec"), merge, "ids array<long>, vec binary")


def _solve(k: int):
    """Top k + 1 of a block of vectors for each query that came to it, no worse than the query's bound."""

    def run(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(queries):
            first = np.array([i[0] for i in data["ids"]], dtype=np.int64)
            ids = list(data["ids"])
            scores = _scores(_matrix(queries["qvec"]), _matrix(data["vec"]))
            for q, bound, row in zip(queries["qvec"], queries["bound"], scores):
                cutoff = np.sort(row)[-(k + 1)] if len(row) > k + 1 else row.min()
                if bound is not None and not pd.isna(bound):
                    cutoff = max(cutoff, bound)
                at = np.flatnonzero(row >= cutoff)
                at = at[np.lexsort((first[at], np.array([-x for x in row[at]])))][: k + 1]
                pairs = [(int(row[i]), int(v)) for i in at for v in ids[i]]
                pairs = sorted(pairs, key=lambda p: (-p[0], p[1]))[: k + 1]
                if pairs:
                    out.append((q, [s for s, _ in pairs], [v for _, v in pairs]))
        return pd.DataFrame(out, columns=["qvec", "scores", "ids"])

    return run


def _local(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Solve queries (qvec, bound, pivot) in the blocks of their pivots' groups; a row for each query and block."""
    # a row for each pivot: how many blocks its vectors and its queries are cut into
    parts = lambda df, of, name: df.groupBy("pivot").agg(F.ceil(F.count("*") / of).cast("int").alias(name))
    asked = parts(queries, QUERY_BLOCK, "qblocks")
    plan = cut(parts(data, BLOCK, "blocks").join(asked, "pivot"), "blocks").withColumnRenamed("pivot", "_pivot")
    own = lambda df: df.join(F.broadcast(plan), F.col("pivot") == F.col("_pivot")).drop("_pivot")
    some = own(data).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
    sent = own(queries).withColumn("qblock", F.pmod(F.xxhash64("qvec"), F.col("qblocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some, sent = some.drop("blocks", "qblocks"), sent.drop("blocks", "qblocks")
    keys = ["pivot", "block", "qblock"]
    return some.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_solve(k), "qvec binary, scores array<long>, ids array<long>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each query: qvec, score, vec_id, place."""
    rows = found.select("qvec", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("qvec", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"))
    order = Window.partitionBy("qvec").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)


def search(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``, its own id left out."""
    spark = df.sparkSession
    vectors = cut(quantise(df, vec_id, vector), "vectors")
    data = cut(distinct_vectors(vectors, k + 1), "distinct-vectors")
    asking = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")).distinct()
    n = data.count()
    width = data.select(F.max(F.octet_length("vec"))).first()[0] or 8
    wanted = max(1, min(math.isqrt(n) // 2, PIVOT_BYTES // width))
    sample = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(wanted).toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = spark.sparkContext.broadcast(_matrix(sample["vec"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        own = (p * p).sum(axis=1)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
            step = max(1, CELLS // len(p))
            pivot = np.concatenate([(own - 2 * (x[i : i + step] @ p.T)).argmin(axis=1) for i in range(0, len(x), step)])
            far = np.sqrt(((x - p[pivot]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot, pa.int32()), pa.array(far), pa.array(np.sqrt((x * x).sum(axis=1)))], names=["ids", "vec", "pivot", "far", "norm"])

    grouped = cut(map_batches(data, assign, "ids array<long>, vec binary, pivot int, far double, norm double"), "voronoi")
    summary = grouped.groupBy("pivot").agg(F.max("far").alias("radius"), F.max("norm").alias("norm")).orderBy("pivot").toPandas()
    groups = spark.sparkContext.broadcast((summary["pivot"].to_numpy(), summary["radius"].to_numpy(), summary["norm"].to_numpy()))

    def bounds(q: np.ndarray) -> np.ndarray:
        """The most that a query can score in each group, with room for rounding."""
        which, radius, norm = groups.value
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        most = np.minimum(q @ pivots.value[which].T + radius * size, norm * size)
        return most + np.abs(most) * 1e-9 + 1e-3

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            which = groups.value[0]
            step = max(1, CELLS // len(which))
            for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
                q = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
                most = bounds(q)
                best = most.argmax(axis=1)
                if first:
                    row, group = np.arange(len(q)), best
                    bound = pa.nulls(len(q), pa.int64())
                else:
                    have = np.array([-math.inf if x is None else x for x in b.column(1).to_pylist()])
                    wanted = most >= have[:, None]
                    wanted[np.arange(len(q)), best] = False
                    row, group = np.nonzero(wanted)
                    bound = b.column(1).take(pa.array(row))
                for i in range(0, len(row), 4000):
                    some = row[i : i + 4000]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), bound.slice(i, 4000), pa.array(which[group[i : i + 4000]], pa.int32())], names=["qvec", "bound", "pivot"])

        return run

    schema = "qvec binary, bound long, pivot int"
    distinct = cut(asking.select("qvec").distinct(), "queries")
    start = cut(_local(grouped, map_batches(distinct, send(True), schema), k), "first-answers")
    # the k-th best besides the query itself bounds the rest; fewer answers bound nothing
    bound = start.select("qvec", F.explode("scores").alias("score"))
    order = Window.partitionBy("qvec").orderBy(F.desc("score"))
    bound = bound.withColumn("place", F.row_number().over(order)).where(F.col("place") == k + 1).select("qvec", F.col("score").alias("bound"))
    again = cut(map_batches(distinct.join(bound, "qvec", "left"), send(False), schema), "replicas")
    best = _best(start.unionByName(_local(grouped, again, k)), k)
    pairs = asking.join(best, "qvec").where(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
