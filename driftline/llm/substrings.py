"""Substring deduplication on a de Bruijn graph of words.

Every k consecutive words are an edge from the node of their first k - 1 words to that of their last. An edge is a
repeat of a document where a document with a smaller id, its owner, has it too.

1. Nodes meet in buckets of a shuffle by their hash, each with the words before and after it, so that a bucket sees all
   edges into and out of its nodes. At a node, the path of a document does not branch if the edges on both sides
   are repeats of one owner at successive coordinates. Where a path branches or ends, the bucket gives the end
   of one path and the start of the next, with the coordinates of their source; nothing is sent for the nodes between.
2. Compaction. The ends of each document's nonbranching paths are joined along its coordinates: a row for each
   maximal repeated span, with its source.
3. Verification. The words at both coordinates of each span are read from the texts and compared (by 128-bit digests that
   travel instead of the words). A span that differs, as hashes can collide, is taken apart into windows, which are
   compared one by one; only what agrees is removed.

Scale: a node costs about eleven bytes in one shuffle. A hot node is no hot key: buckets hold packed arrays of many
nodes and are bounded in bytes (``BUCKET_TEXT`` of text for each); each chunk of input sends a row to a bucket. Path ends and
spans are few. Spans are broadcast to the texts only up to a checked size, else both sides are shuffled by id.

Defined results: a null text has no words; texts shorter than k words keep all; equal rows keep what one of
them keeps (ids are not smaller than themselves); a row without id takes no part and keeps all; where
texts differ under one id the spans of both apply to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns, cut, map_batches
from ._blobs import bytes_hash, hash_bytes, pack, pack_ids, unpack, unpack_ids
from ._hashing import Words, groups, mix, ngrams
from ._spans import buckets_for, merged_spans, with_spans

WORDS = 13
HASH_BYTES = 5
#: Text whose nodes share a bucket, and text that is packed together before it is sent to the buckets.
BUCKET_TEXT, CHUNK_BYTES = 16 << 20, 24 << 20
START, END = 0, 1
_SALT = np.uint64(0x6A09E667F3BCC909)


def _nodes(ids: list[int], texts: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Row number, position and hash of each node of texts of k words and more, and 16 bits of the words before and after it (0: none)."""
    words = Words(texts)
    own = words.hashes()
    h = ngrams(own, k - 1)
    some = np.diff(words.first)
    sizes = np.where(some >= k, some - (k - 2), 0)
    row = np.repeat(np.arange(len(ids)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = words.first[row] + within
    short = np.maximum(own >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    before = np.where(within > 0, short[at - 1], 0).astype(np.uint16)
    after = np.where(within < sizes[row] - 1, short[np.minimum(at + k - 1, len(own) - 1)], 0).astype(np.uint16)
    return row, within, h[at], before, after


def _send(k: int, buckets: int):
    """What each chunk of documents sends to each bucket."""

    def flush(found: list[tuple], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, pos, h, before, after = (np.concatenate(x) for x in zip(*found))
        bucket = (mix(h ^ _SALT) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        names, payloads = [], []
        for b in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[b] : bounds[b + 1]]
            r, p = row[own].astype(np.int64), pos[own].astype(np.int64)
            heads = np.flatnonzero(np.diff(r, prepend=-1))
            gap = np.diff(p, prepend=0)
            gap[heads] = p[heads]
            payloads.append(pack(pack_ids(ids[r[heads]]), np.diff(heads, append=len(r)), gap, before[own], after[own], hash_bytes(h[own], HASH_BYTES)))
            names.append(int(b))
        for a in range(0, len(names), 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 16], pa.int64()), pa.array(payloads[a : a + 16], pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t or b"") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) if i is not None)
        found, ids, size = [], [], 0
        for group in groups(rows):
            row, *rest = _nodes([i for i, _ in group], [t for _, t in group], k)
            found.append((row.astype(np.uint32) + np.uint32(len(ids)), rest[0].astype(np.uint32), *rest[1:]))
            ids += [i for i, _ in group]
            size += sum(len(t) for _, t in group)
            if size > CHUNK_BYTES:
                yield from flush(found, np.array(ids, dtype=np.int64))
                found, ids, size = [], [], 0
        if found:
            yield from flush(found, np.array(ids, dtype=np.int64))

    return run


def _positions(counts: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Positions from the gaps of each document's run."""
    total = np.cumsum(gap, dtype=np.int64)
    heads = np.cumsum(counts, dtype=np.int64) - counts
    return total - np.repeat(total[heads] - gap[heads], counts)


def _owners(code: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each edge the index of its first occurrence, by document and position."""
    order = np.lexsort((pos, doc, code))
    heads = np.flatnonzero(np.concatenate([[True], code[order[1:]] != code[order[:-1]]]))
    out = np.empty(len(code), dtype=np.int64)
    out[order] = np.repeat(order[heads], np.diff(heads, append=len(code)))
    return out


ENDS = "doc_id long, pos long, kind int, source long, source_pos long"


def path_ends(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """In a bucket: starts and ends of nonbranching repeated paths: document, first word of the edge, kind, coordinates of its source."""
    parts = []
    for payload in payloads:
        ids, counts, gap, before, after, h = unpack(payload)
        counts = counts.astype(np.int64)
        parts.append((np.repeat(unpack_ids(ids), counts), _positions(counts, gap.astype(np.int64)), before.astype(np.uint16), after.astype(np.uint16), bytes_hash(h, len(h) // len(gap))))
    doc, pos, before, after, h = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # nodes of two occurrences and more
    doc, pos, before, after, h = doc[order], pos[order], before[order], after[order], h[order]
    if not len(h):
        return (doc,) * 5
    node = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])]) << 16
    into, out = _owners(node | before, doc, pos), _owners(node | after, doc, pos)
    repeat_in, repeat_out = (before > 0) & (doc > doc[into]), (after > 0) & (doc > doc[out])
    through = repeat_in & repeat_out & (into == out)  # one source, at successive coordinates
    start, end = np.flatnonzero(repeat_out & ~through), np.flatnonzero(repeat_in & ~through)
    kind = np.concatenate([np.full(len(start), START), np.full(len(end), END)])
    at = np.concatenate([pos[start], pos[end] - 1])
    source = np.concatenate([out[start], into[end]])
    return np.concatenate([doc[start], doc[end]]), at, kind, doc[source], np.where(kind == START, pos[source], pos[source] - 1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one bucket at a time."""
    names = [c.split()[0] for c in ENDS.split(", ")]

    def solve(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, pos, kind, source, source_pos = path_ends(payloads)
        for a in range(0, len(doc), 50_000):
            s = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(pos[s]), pa.array(kind[s].astype(np.int32)), pa.array(source[s]), pa.array(source_pos[s])], names=names)

    bucket, held = None, []
    for b in batches:
        for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != bucket:
                if held:
                    yield from solve(held)
                bucket, held = name, []
            held.append(payload)
    if held:
        yield from solve(held)


def paths(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, pos, source, source_pos, n: maximal nonbranching paths of n edges that document ``source`` has too. docs: doc_id long, text."""
    buckets = buckets_for(docs, "text", BUCKET_TEXT)
    sent = map_batches(docs, _send(k, buckets), "bucket long, payload binary")
    dealt = sent.repartition(max(1, buckets // 2), "bucket").sortWithinPartitions("bucket")
    ends = map_batches(dealt, _meet, ENDS).distinct()  # a repeated row gives its ends again
    # a start meets the next end of its document; the window runs backwards, so both carry one value along
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == END, F.col("pos")), ignorenulls=True).over(back)
    return ends.withColumn("last", last).where((F.col("kind") == START) & F.col("last").isNotNull()).select("doc_id", "pos", "source", "source_pos", (F.col("last") - F.col("pos") + 1).alias("n"))


def _agreeing(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans (doc_id, pos, source, source_pos, size in words) whose words are those of their source."""
    name = F.xxhash64("doc_id", "pos", "source", "source_pos", "size")
    own = spans.select(F.col("doc_id").alias("id"), F.col("pos").alias("at"), "size", name.alias("span"), F.lit(0).alias("role"))
    theirs = spans.select(F.col("source").alias("id"), F.col("source_pos").alias("at"), "size", name.alias("span"), F.lit(1).alias("role"))
    wanted = own.union(theirs).groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("at", "size", "span", "role")).alias("spans"))
    texts, column = with_spans(docs.where("doc_id is not null and text is not null"), wanted, "doc_id", left=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            span, role, digest = [], [], []
            for t, asked in zip(b.column(at("text")).cast(pa.binary()).to_pylist(), b.column(at(column)).to_pylist()):
                words = t.split()  # bytes split at 0x20 and 0x09 to 0x0D
                for x in asked:
                    piece = words[x["at"] : x["at"] + x["size"]]
                    if len(piece) == x["size"]:
                        span.append(x["span"])
                        role.append(x["role"])
                        digest.append(hashlib.blake2b(b" ".join(piece), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(span, pa.int64()), pa.array(role, pa.int32()), pa.array(digest, pa.binary())], names=["span", "role", "digest"])

    read = map_batches(texts, run, "span long, role int, digest binary")
    both = read.groupBy("span", "digest").agg(F.min("role").alias("low"), F.max("role").alias("high")).where("low < high").select(F.col("span").alias("_span")).distinct()
    return spans.withColumn("_name", name).join(both, F.col("_name") == F.col("_span"), "left").select(*spans.columns, F.col("_span").isNotNull().alias("agrees"))


def repeated_spans(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, low, high: repeated spans of words, verified at their source. docs: doc_id long, text."""
    spans = cut(paths(docs, k).withColumn("size", F.col("n") + (k - 1)).drop("n"), "paths")
    checked = cut(_agreeing(docs, spans), "checked-paths")
    good = checked.where("agrees")
    bad = checked.where("not agrees")
    if not bad.isEmpty():
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - k)).alias("_step")
        windows = bad.select("*", step).select("doc_id", (F.col("pos") + F.col("_step")).alias("pos"), "source", (F.col("source_pos") + F.col("_step")).alias("source_pos"), F.lit(k).cast("long").alias("size"))
        good = good.unionByName(_agreeing(docs, cut(windows, "windows")).where("agrees"))
    return good.select("doc_id", F.col("pos").alias("low"), (F.col("pos") + F.col("size")).alias("high"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Add ``kept`` (the words left, joined by one space), ``n_words`` and ``n_removed``. Columns of these names are replaced."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both, spans = with_spans(docs, merged_spans(repeated_spans(own, k)), doc_id)
    fields = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            at = batch.schema.get_field_index
            kept, sizes, gone = [], [], []
            for t, s in zip(batch.column(at(text)).cast(pa.binary()).to_pylist(), batch.column(at(spans)).to_pylist()):
                words = (t or b"").split()  # bytes split at 0x20 and 0x09 to 0x0D
                sizes.append(len(words))
                if s:
                    out, last = [], 0
                    for a, b in np.frombuffer(s, dtype=np.int64).reshape(-1, 2).tolist():
                        out += words[last:a]
                        last = b
                    words = out + words[last:]
                kept.append(b" ".join(words))
                gone.append(sizes[-1] - len(words))
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]

        return work

    wanted = [c for c in (docs.columns if keep is None else keep) if c not in ("kept", "n_words", "n_removed")]
    return append_columns(both, fields, make, wanted)
