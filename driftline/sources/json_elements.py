"""Elements of large JSON documents, read in byte ranges by many tasks.

A document is a list, or an object some of whose members are lists; a file may be one line and larger than a task. Spark's
text source cuts files into splits at closing braces, wherever these stand. What a split starts in the middle of is found by prefix
sums over a table of splits:

1. each split says how depth and quotes change over it, for a start inside and outside a string;
2. summed up in order, that gives each split its true state at the start; with it, each split finds the commas and brackets that part
   elements, and gives those that lie in it whole, and fragments of those that go over its ends;
3. lists go on over splits, so their keys and ordinals are carried on by sums over the same table; fragments are put together by
   file, list and ordinal.

Only fragments are shuffled with their text. The scan is vectorised; a step of Python is taken for each element, not each byte.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.session import ship
from driftline.tables import cut

#: Bytes that are scanned at once; splits whose states are broadcast (some 20 TB of text).
CHUNK, BROADCAST_SPLITS = 4 << 20, 200_000
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
_NAMED = re.compile(rb'^\s*"((?:[^"\\]|\\.)*)"\s*:', re.S)
#: What a byte adds to the depth, and the bytes that change it or part elements.
_STEP = np.isin(np.arange(256), list(b"{[")).astype(np.int64) - np.isin(np.arange(256), list(b"}]"))
_MARK = (_STEP != 0) | (np.arange(256) == ord(","))


def structure(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Places of brackets and commas, how many quotes stand before each, the quotes in all, and whether what follows is escaped."""
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    after = False
    if len(slashes):
        heads = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)  # runs of backslashes: an odd one escapes what follows
        first, length = slashes[heads], np.diff(np.append(heads, len(slashes)))
        if escaped and first[0] == 0:
            length[0] -= 1  # the first one is escaped itself
            first[0] = 1
        end = first + length
        odd = end[length % 2 == 1]
        after = bool(len(odd) and odd[-1] == len(data))
        quotes = quotes[~np.isin(quotes, odd)]
    at = np.flatnonzero(_MARK[data])
    return at, np.searchsorted(quotes, at), len(quotes), after


def _chunks(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    for piece in pieces:
        for a in range(0, len(piece), CHUNK):
            yield piece[a : a + CHUNK]


def summary(pieces: Iterator[np.ndarray]) -> tuple[list[int], list[bool], str | None]:
    """Change of depth and string at the end, for a start outside and inside a string; and the first byte that is no space."""
    depth, total, escaped, root = [0, 0], 0, False, None
    for data in _chunks(pieces):
        if root is None:
            full = data[~np.isin(data, list(b" \t\r\n\xef\xbb\xbf"))]
            root = chr(full[0]) if len(full) else None
        at, before, quotes, escaped = structure(data, escaped)
        odd, step = (before + total) % 2 == 1, _STEP[data[at]]
        depth[0] += int(step[~odd].sum())
        depth[1] += int(step[odd].sum())
        total += quotes
    return depth, [total % 2 == 1, total % 2 == 0], root


class Elements:
    """Elements of the lists at depth ``want`` in a split; what is found before a list opens belongs to the one that the split starts in."""

    def __init__(self, depth: int, in_string: bool, want: int):
        self.depth, self.in_string, self.want = depth, in_string, want
        self.escaped, self.run, self.key, self.i, self.open = False, 0, None, 0, depth >= want
        self.text, self.lead = [], []
        self.keys: set[str] = set()

    def feed(self, data: np.ndarray) -> Iterator[tuple]:
        """(run, key, ordinal of the first, texts) of elements that end here one after the other; run 0 is the list that the split starts in."""
        at, before, quotes, self.escaped = structure(data, self.escaped)
        at = at[(before + self.in_string) % 2 == 0]
        self.in_string = (quotes + self.in_string) % 2 == 1
        step = _STEP[data[at]]
        depth = self.depth + np.cumsum(step)  # after each
        self.depth = int(depth[-1]) if len(depth) else self.depth
        some = (depth < self.want) | (depth == self.want) & (step >= 0)
        at, step, depth = at[some], step[some], depth[some]
        places, raw, last, done = at.tolist(), data.tobytes(), 0, 0
        for n in [*np.flatnonzero((step != 0) | (depth != self.want)).tolist(), len(places)]:
            if n > done and self.open:  # commas between elements
                texts = [raw[a:b] for a, b in zip([last, *(at[done : n - 1] + 1).tolist()], places[done:n])]
                texts[0] = b"".join(self.text) + texts[0]
                yield self.run, self.key, self.i, texts
                self.text, last = [], places[n - 1] + 1
                self.i += n - done
            if n == len(places):
                break
            done = n + 1
            p, d, s = places[n], int(depth[n]), int(step[n])
            if s > 0 and d == self.want:  # a list or an object opens
                lead = b"".join(self.lead) + raw[last:p]
                name = _KEY.search(lead) if self.want > 1 else None
                self.key = (json.loads(b'"' + name[1] + b'"') if name else "") if raw[p : p + 1] == b"[" else "{"
                if name:
                    self.keys.add(name[1].decode(errors="replace"))
                self.run, self.i, self.open, self.lead, self.text, last = self.run + 1, 0, True, [], [], p + 1
            elif self.open and s < 0 and d == self.want - 1:
                yield self.run, self.key, self.i, [b"".join(self.text) + raw[last:p]]
                self.text, last, self.open = [], p + 1, False
                self.i += 1
            elif not self.open and d == self.want - 1 - (s < 0) and s <= 0:  # a member that is no list ends
                lead = b"".join(self.lead) + raw[last:p]
                if name := _NAMED.search(lead):
                    self.keys.add(name[1].decode(errors="replace"))
                self.lead, last = [], p + 1
            elif s > 0 and d < self.want:
                self.lead, last = [], p + 1
        (self.text if self.open else self.lead).append(raw[last:])

    def end(self) -> Iterator[tuple]:
        """What has begun and not ended, likewise."""
        if self.open:
            yield self.run, self.key, self.i, [b"".join(self.text)]


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    for b in batches:
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = False
        for c in b.columns[:2]:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        text = b.column(b.num_columns - 1).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)
        heads = np.flatnonzero(new).tolist()
        for head, end in zip(heads, [*heads[1:], b.num_rows]):
            yield tuple(c[head].as_py() for c in b.columns[:n]), data[ends[head] : ends[end]]


def _by_split(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[np.ndarray]]]:
    """For each split (first two columns) the first ``n`` columns, and the bytes of the last one. Rows of a split come together and in order."""
    for key, group in itertools.groupby(_runs(batches, n), lambda r: r[0]):
        yield key, (r[1] for r in group)


def _texts(found: list[bytes | None]) -> pa.Array:
    """Texts as they are; what is no UTF-8 is replaced."""
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t if t is None else t.decode("utf-8", "replace") for t in found], pa.string())


def splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split (offset) and piece: the text up to a closing brace, which ends each (the last one of a file, too)."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.concat("value", F.lit("}")).cast("binary").alias("piece"))


def states(pieces: DataFrame) -> DataFrame:
    """file, split, depth and in_string at its start, root (the first byte of the file) and final depth of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), own in _by_split(batches, 2):
            depth, inside, root = summary(own)
            yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "d0": depth[0], "d1": depth[1], "s0": inside[0], "s1": inside[1], "root": root}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("s0", pa.bool_()), ("s1", pa.bool_()), ("root", pa.string())])
    rows = pieces.mapInArrow(run, "file string, split long, d0 long, d1 long, s0 boolean, s1 boolean, root string")
    line = Window.partitionBy("file").orderBy("split")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    # a split ends in a string if it flips an odd number of times: s0 does not depend on the start beyond that
    rows = rows.withColumn("in_string", F.coalesce(F.sum(F.col("s0").cast("int")).over(before) % 2 == 1, F.lit(False)))
    rows = rows.withColumn("change", F.when(F.col("in_string"), F.col("d1")).otherwise(F.col("d0")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0).cast("long")))
    whole = Window.partitionBy("file")
    rows = rows.withColumns({"root": F.first("root", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "final": F.sum("change").over(whole)})
    return rows.select("file", "split", "depth", "in_string", "root", "final")


def read_elements(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(elements, files). Elements: file, key (of the list; empty for a document that is a list), pos (place in the list) and text. Files: file, root, final (0 or less: complete) and keys of the members seen.

    Elements of objects' members that are no lists are left out.
    """
    ship(spark)
    pieces = splits(spark, path)
    known = cut(states(pieces), "splits")
    few = known.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    state = known.withColumnsRenamed({"file": "_file", "split": "_split"}).drop("final")
    same = (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split"))
    if few:  # rows stay where and as they were read
        rows = pieces.join(F.broadcast(state), same)
    else:
        rows = pieces.withColumn("_row", F.monotonically_increasing_id()).join(state, same).sortWithinPartitions("file", "split", "_row")
    rows = rows.select("file", "split", "depth", "in_string", "root", "piece")
    names = ["file", "split", "run", "key", "i", "whole", "text", "open", "keys"]
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("run", pa.int32()), ("key", pa.string()), ("i", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("open", pa.string()), ("keys", pa.list_(pa.string()))])

    def batch(file: str, split: int, blocks: list[tuple], whole: bool) -> pa.RecordBatch:
        """Blocks of elements; the text of those whose list and place are known here is ``text``, of others ``open``."""
        sizes = [len(b[3]) for b in blocks]
        run, n = np.repeat([b[0] for b in blocks], sizes), sum(sizes)
        i = np.concatenate([np.arange(b[2], b[2] + len(b[3])) for b in blocks])
        full = (run > 0) | (i > 0) if whole else np.zeros(n, dtype=bool)
        known = full & (run > 0)
        texts = [t for b in blocks for t in b[3]]
        split_up = [_texts([t if k == side else None for t, k in zip(texts, known.tolist())]) for side in (True, False)]
        key = pa.array([k for b in blocks for k in [b[1]] * len(b[3])], pa.string())
        columns = [pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(split, pa.int64()), n), pa.array(run, pa.int32()), key, pa.array(i, pa.int64()), pa.array(full), *split_up, pa.nulls(n, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split, depth, in_string, root), own in _by_split(batches, 5):
            found = Elements(depth, in_string, 1 if root == "[" else 2)
            out, size = [], 0
            for data in _chunks(own):
                for block in found.feed(data):
                    out.append(block)
                    size += sum(map(len, block[3]))
                    if size > CHUNK:
                        yield batch(file, split, out, True)
                        out, size = [], 0
            if out:
                yield batch(file, split, out, True)
            if rest := list(found.end()):
                yield batch(file, split, rest, False)
            last = [file, split, found.run, found.key, found.i, None, None, None, sorted(found.keys)]  # the state at the end
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(last, schema)], names=names)

    parts = cut(rows.mapInArrow(run, "file string, split long, run int, key string, i long, whole boolean, text string, open string, keys array<string>"), "elements")

    ends = parts.where("whole is null")
    line = Window.partitionBy("file").orderBy("split")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    # a list is carried on until another one opens; its ordinals go on from split to split
    ends = ends.withColumns({"list": F.sum((F.col("run") > 0).cast("int")).over(line), "key_in": F.last("key", ignorenulls=True).over(before)})
    own = Window.partitionBy("file", "list").orderBy("split")
    ends = ends.withColumn("total", F.sum("i").over(own))  # elements ended in this list up to the end of this split
    ends = ends.withColumn("base", F.coalesce(F.lag("total").over(line), F.lit(0).cast("long")))
    carried = ends.select(F.col("file").alias("_file"), F.col("split").alias("_split"), "key_in", "base")
    each = parts.where("open is not null").drop("text").withColumnRenamed("open", "text").join(carried, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    first = F.col("run") == 0
    each = each.select("file", "split", "whole", "text", F.when(first, F.col("key_in")).otherwise(F.col("key")).alias("key"), (F.col("i") + F.when(first, F.col("base")).otherwise(F.lit(0))).alias("pos")).where("key <> '{'")
    pieces_of = each.where("not whole").groupBy("file", "key", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text"))
    here = parts.where("text is not null and key <> '{'").select("file", "key", F.col("i").alias("pos"), "text")  # most: these meet no other table
    elements = here.unionByName(each.where("whole").select("file", "key", "pos", "text")).unionByName(pieces_of).where("text rlike '[^\\\\s]'")
    files = known.groupBy("file").agg(F.first("root").alias("root"), F.first("final").alias("final")).join(ends.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")), "file")
    return elements, files
