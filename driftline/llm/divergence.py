"""Source divergence audit by integer-dictionary encoding.

For every (lang, source) group: how far its distribution of terms lies from those of the other sources of its
language, and which terms it uses more than its language does.

1. Texts are read once. Tasks count terms by group (occurrences and documents) in a bounded table that is handed
   on when full; a shuffle by (lang, source, term) adds the counts up.
2. A language keeps its terms of ``min_docs`` documents and more. Sorted by range, they get integer ids that rise in
   UTF-8 order, and are cut into chunks of at most ``CHUNK`` terms: sorted arrays.
3. A task gets a chunk of terms and two blocks of groups: it finds the ids of their terms by searchsorted, makes
   a dense vector of counts for each group by bincount, turns counts into smoothed shares, and gives the part of each
   pair's distance and the ``top`` terms of each group that lie in the chunk. Distances are summed over the chunks.

No text, group or vocabulary is held whole anywhere: a task has ``CHUNK`` terms and twice ``GROUPS`` groups, whatever the size
of a source. Pairs of sources of a language are the result itself.

Exact: a share is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), by long division in int64, exact for a language below 9 * 10**15 terms.

Defined results: null texts, languages and sources count as empty strings; a group without terms has the smoothed
shares of no counts; a language that keeps no term has distances of 0 and no terms; a language of one source has no pairs; repeated
rows count each; ties go by item in UTF-8 order; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, map_batches

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a chunk, groups of a block, and entries that a task counts before it hands them on.
CHUNK, GROUPS, HELD = 1024, 256, 400_000
#: Bytes of a term: letters A-Z in lower case and all beyond ASCII; anything else parts terms. Fixed by the definition.
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of bytes beyond ASCII, A-Z in lower case."""
    return text.translate(_KEEP).split()


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and _KEEP[text[end]] != 0x20:
            end += 1
        yield terms(text[at:end])
        at = end


def _packed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (seen, docs) in held.items():
        found = [None, *seen]  # a group is known even without terms
        for a in range(0, len(found), 50_000):
            part = found[a : a + 50_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()).cast(pa.string()), pa.array([seen[t] if t else 0 for t in part], pa.int64()), pa.array([docs[t] if t else 0 for t in part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); each group also has a row with a null term."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for own_lang, own_source, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (own_lang, own_source) not in held:
                    held[own_lang, own_source] = (Counter(), Counter())
                    size += 1
                seen, in_docs = held[own_lang, own_source]
                before, own = len(seen), set()
                for part in _pieces(body):
                    seen.update(part)
                    own.update(part)
                in_docs.update(own)
                size += len(seen) - before
                if size >= HELD:
                    yield from _packed(held)
                    held, size = {}, 0
        yield from _packed(held)

    partial = map_batches(texts, run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def dictionary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n (in the language), id (rising in UTF-8 order) and chunk, for the kept terms."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    in_order = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return in_order.select("lang", "term", "n", F.monotonically_increasing_id().alias("id")).withColumn("chunk", F.floor(F.col("id") / CHUNK).cast("long"))


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly: long division by thousands."""
    below = (totals + SMOOTH * kept)[:, None]
    whole, rest = np.divmod(counts + SMOOTH, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def _vectors(terms_of: np.ndarray, entries: pa.Table, side: str, groups: int) -> np.ndarray:
    """Dense counts of the groups of a block over a chunk: ids by searchsorted, sums by bincount."""
    own = entries.filter(pc.equal(entries["side"], side))
    ids = np.searchsorted(terms_of, np.array(own["term"].to_pylist(), dtype=object))
    place = own["place"].to_numpy() * len(terms_of) + ids
    return np.bincount(place, own["n"].to_numpy(), groups * len(terms_of)).astype(np.int64).reshape(groups, -1)


def _solve(top: int):
    def run(key: tuple, frame: pa.Table, entries: pa.Table) -> pa.Table:
        if not frame.num_rows:
            return _OUT.empty_table()
        f = {c: frame[c][0].as_py() for c in frame.column_names}
        kept = np.array(f["terms"], dtype=object)
        names = {s: f[f"sources_{s}"] for s in "ab"}
        counts = {s: _vectors(kept, entries, s, len(names[s])) for s in "ab"}
        p = {s: shares(counts[s], np.array(f[f"totals_{s}"]), f["kept"]) for s in "ab"}
        a, b, value, item = [], [], [], []
        for i, name in enumerate(names["a"]):
            first = i + 1 if f["block_a"] == f["block_b"] else 0
            far = np.abs(p["b"][first:] - p["a"][i]).sum(axis=1)
            a += [name] * len(far)
            b += names["b"][first:]
            value += far.tolist()
        item += [None] * len(a)
        if f["block_a"] == f["block_b"]:
            whole = shares(np.array([f["n"]]), np.array([f["total"]]), f["kept"])[0]
            for i, name in enumerate(names["a"]):
                more = np.where(counts["a"][i] > 0, p["a"][i] - whole, 0)
                best = np.flatnonzero(more > 0)
                best = best[np.argsort(-more[best], kind="stable")][:top]  # ids are in UTF-8 order
                a += [name] * len(best)
                b += [None] * len(best)
                value += more[best].tolist()
                item += kept[best].tolist()
        return pa.table([[f["lang"]] * len(a), a, b, item, value], schema=_OUT)

    return run


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module."""
    counts = cut(count_terms(docs, text, lang, source), "term-counts")
    kept = cut(dictionary(counts, min_docs), "dictionary")
    own = counts.join(kept.select("lang", "term", "chunk"), ["lang", "term"])
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = cut(groups.withColumn("place", F.row_number().over(order) - 1), "groups").select("lang", "source", "total", F.floor(F.col("place") / GROUPS).cast("int").alias("block"), (F.col("place") % GROUPS).alias("place"))

    # a frame for each chunk and pair of blocks: the chunk's terms, the blocks' sources and totals
    sums = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    in_order = lambda name, *columns: F.array_sort(F.collect_list(F.struct(*columns))).alias(name)
    chunks = kept.groupBy("lang", "chunk").agg(in_order("t", "id", "term", "n")).select("lang", "chunk", F.col("t.term").alias("terms"), F.col("t.n").alias("n")).join(sums, "lang")
    blocks = groups.groupBy("lang", "block").agg(in_order("g", "place", "source", "total"))
    side = lambda s: blocks.select("lang", F.col("block").alias(f"block_{s}"), F.col("g.source").alias(f"sources_{s}"), F.col("g.total").alias(f"totals_{s}"))
    frames = chunks.join(side("a").join(side("b"), "lang").where("block_a <= block_b"), "lang")
    # entries go to every pair of blocks that holds theirs
    last = blocks.groupBy("lang").agg(F.max("block").alias("last"))
    placed = own.join(groups.select("lang", "source", "block", "place"), ["lang", "source"]).join(last, "lang")
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), "last")))
    sides = F.when(F.col("block") < F.col("with"), F.array(F.lit("a"))).when(F.col("block") > F.col("with"), F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    entries = placed.select("lang", "chunk", F.least("block", "with").alias("block_a"), F.greatest("block", "with").alias("block_b"), F.explode(sides).alias("side"), "place", "term", "n")
    keys = ["lang", "chunk", "block_a", "block_b"]
    found = cut(map_frames(frames, entries, keys, _solve(top)), "divergence")

    pairs = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source")
    every = names.join(names.withColumnRenamed("source", "other"), "lang").where("source <> other")
    both = pairs.unionByName(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    far = every.join(both, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    more = found.where("item is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return far.withColumn("rank", ranked).unionByName(more.withColumn("rank", ranked).where(F.col("rank") <= top))


def map_frames(frames: DataFrame, entries: DataFrame, keys: list[str], solve) -> DataFrame:
    """A result for each frame and the entries of its key."""
    from driftline.session import ship

    ship(frames.sparkSession)
    frames = frames.select(*[F.col(c).alias(c) for c in frames.columns])  # both sides come from the dictionary
    return frames.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(solve, "lang string, source string, other string, item string, value long")
