"""Spans of documents: merging them, joining them to the texts, and how many buckets a corpus needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, map_batches

#: Text for each bucket of packed entries; a task works on about two.
BUCKET_BYTES = 64 << 20
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000


def buckets_for(docs: DataFrame, text: str, each: int = BUCKET_BYTES) -> int:
    """One for ``each`` bytes of the texts, and at least two for each shuffle partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * parts, -(-size // each))


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id and its spans (from doc_id, low, high) in order and apart: pairs of int64, packed."""
    pair = F.array_sort(F.collect_set(F.struct("low", "high")))
    own = spans.groupBy("doc_id").agg(pair.alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pairs in b.column(1).to_pylist():
                low, high = (np.array([p[k] for p in pairs], dtype=np.int64) for k in ("low", "high"))
                reach = np.maximum.accumulate(high)
                first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
                out.append(np.stack([low[first], reach[np.append(first[1:], len(low)) - 1]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "spans"])

    return map_batches(own, run, "doc_id long, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame, doc_id: str, left: bool = True) -> tuple[DataFrame, str]:
    """Join of the texts with their spans (by broadcast where these are few, else by a shuffle of both), and the name of the new column.

    ``spans`` has doc_id and one more column, packed or an array.
    """
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"_spans{i}") not in docs.columns)
    own = next(c for c in spans.columns if c != "doc_id")
    found = cut(spans, "spans").select(F.col("doc_id").alias(f"{name}_id"), F.col(own).alias(name))
    weight = F.octet_length(name) if found.schema[name].dataType.typeName() == "binary" else 40 * F.size(name)
    rows, size = found.select(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return docs.join(F.broadcast(found) if small else found, F.col(doc_id) == F.col(f"{name}_id"), "left" if left else "inner").drop(f"{name}_id"), name
