"""Shapefiles (lines and polygons) as tables, read by ranges of records.

The format pairs a geometry file with an attribute file by record number, and an index file of fixed width says where each record
of geometry lies. So a layer is cut into ranges of records; a task reads its part of the index, and by it its bytes of the other two
files. A layer without index is one range, whose task reads the files whole. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import ship

# Shape types with parts (plain, Z and M): fixed values of the format.
WITH_PARTS = (3, 5, 13, 15, 23, 25)
#: Records that a task reads.
RECORDS = 50_000


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file, from ``start`` on."""
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def size_of(path: str) -> int | None:
    """None if there is no such file."""
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    return info.size if info.type == pyarrow.fs.FileType.File else None


def geometry_range(base: str, first: int, last: int) -> bytes:
    """The records of .shp from ``first`` up to ``last``, found by the index."""
    index = np.frombuffer(read_bytes(f"{base}.shx", 100 + 8 * first, 8 * (last - first)), dtype=">i4").reshape(-1, 2).astype(np.int64)
    if not len(index):
        return b""
    start, end = 2 * int(index[:, 0].min()), int((2 * index[:, 0] + 8 + 2 * index[:, 1]).max())
    data = read_bytes(f"{base}.shp", start, end - start)
    if (np.diff(index[:, 0]) == index[:-1, 1] + 4).all():
        return data
    return b"".join(data[2 * int(o) - start : 2 * int(o) - start + 8 + 2 * int(n)] for o, n in index)  # records apart or out of order


def geometry_records(data: bytes, at: int = 100) -> Iterator[list[np.ndarray] | None]:
    """Parts of each record of .shp bytes (a file has a header of 100); None for a null shape."""
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = at + 8
        (kind,) = struct.unpack_from("<i", data, body)
        if kind in WITH_PARTS:
            parts, points = struct.unpack_from("<2i", data, body + 36)
            first = np.frombuffer(data, "<i4", parts, body + 44)
            xy = np.frombuffer(data, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
            yield np.split(xy, first[1:])
        else:
            yield None
        at = body + 2 * words


def attribute_fields(data: bytes) -> list[tuple[str, int]]:
    """Names and widths of a .dbf file."""
    out, at = [], 32
    while data[at] != 0x0D:
        out.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    return out


def attribute_records(data: bytes, head: bytes, first: int = 0) -> Iterator[list[str | None]]:
    """Trimmed texts (empty: None) of each record in ``data``, which starts with record ``first``; ``head`` is that of the file."""
    n, _, width = struct.unpack_from("<IHH", head, 4)
    fields = attribute_fields(head)
    for i in range(min(n - first, len(data) // width)):
        at, row = i * width + 1, []
        for _, size in fields:
            raw = data[at : at + size]
            try:
                value = raw.decode("utf-8").strip()
            except UnicodeDecodeError:
                value = raw.decode("latin-1").strip()
            row.append(value or None)
            at += size
        yield row


def read_shapefile(spark: SparkSession, base: str, records: int = RECORDS) -> DataFrame:
    """Attributes (as texts), ``parts`` and ``crs`` ('27700', '4326' or null) of ``<base>.shp``, ``.dbf``, ``.shx`` and ``.prj``.

    A layer that is not there raises what Spark's own readers raise.
    """
    ship(spark)
    if size_of(f"{base}.shp") is None:
        spark.read.format("binaryFile").load(f"{base}.shp")  # PATH_NOT_FOUND
    (length,) = struct.unpack_from("<H", read_bytes(f"{base}.dbf", 0, 32), 8)
    head = read_bytes(f"{base}.dbf", 0, length)
    names = [n for n, _ in attribute_fields(head)]
    crs = None
    if size_of(f"{base}.prj") is not None:
        text = read_bytes(f"{base}.prj").decode("latin-1").upper()
        crs = "27700" if "BRITISH" in text else "4326" if text.startswith("GEOGCS") else None
    index, (n,) = size_of(f"{base}.shx"), struct.unpack_from("<I", head, 4)
    known = index is not None
    n = min(n, (index - 100) // 8) if known else n
    step = records if known else max(1, n)
    ranges = spark.range(0, n, step, max(1, -(-n // step)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (width,) = struct.unpack_from("<H", head, 10)
        for first in (int(i) for frame in frames for i in frame["id"]):
            last = min(n, first + step)
            shapes = geometry_records(geometry_range(base, first, last), 0) if known else geometry_records(read_bytes(f"{base}.shp"))
            rows = []
            for number, (parts, row) in enumerate(zip(shapes, attribute_records(read_bytes(f"{base}.dbf", length + first * width, (last - first) * width), head, first)), first):
                shape = None if parts is None else [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]
                rows.append([*row, shape, number])
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=[*names, "parts", "_number"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*names, "parts", "_number"])

    schema = ", ".join([*(f"`{c}` string" for c in names), "parts array<array<struct<x: double, y: double>>>", "_number long"])
    record = F.struct(F.lit(base).alias("file"), F.lit(0).cast("long").alias("split"), F.col("_number").alias("row"))
    return ranges.mapInPandas(run, schema).where("parts is not null").withColumn("record", record).drop("_number").withColumn("crs", F.lit(crs).cast("string"))
