"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from driftline.session import ship
from driftline.tables import cut, new_path

__all__ = ["append_columns", "cut", "kept", "map_batches", "new_path"]


#: Bytes in one Arrow batch, beside a last row that may be longer.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """The same bound for every operator, so plans that run later find what they were made for."""
    is_set = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BOUND))
    if is_set > BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


#: What modules keep in a Python worker between tasks: name -> how to let go of it.
kept: dict[str, Callable[[], None]] = {}


def release(using: str = "") -> None:
    """At the start of a task: let go of what other operators have kept in this worker, which Spark uses again for all of them."""
    for name in [n for n in kept if n != using]:
        kept.pop(name)()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)  # freed pages go back to the system


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, using: str = "") -> DataFrame:
    """``mapInArrow`` whose workers find this package, in batches of bounded bytes: texts may be long. A smaller bound of the session stays.

    ``using`` names what the function keeps between tasks; what others keep is let go.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(using)
        yield from run(batches)

    return df.mapInArrow(clean, schema)


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
    using: str = "",
) -> DataFrame:
    """Keep ``keep`` (default: all) and add Arrow columns made batch by batch.

    ``make`` runs once in each task and gives the function of a batch. A kept column with the name of
    a new one is replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + work(batch)
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return map_batches(df, run, schema, using)
