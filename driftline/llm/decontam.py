"""Benchmark decontamination, DataFrame functions only.

Size-partitioned MinHash containment search, then exact shingle containment.

1. Items are partitioned by the size class of their shingle sets. An item's sketch is its k smallest shingle
   hashes, with k = n - need + 1 fixed by its size, so a document that holds the wanted share of the item must hold one
   of the k at least. A partition is summed up by the least that any of its items needs and by its largest
   sketch value.
2. Of a document only those hashes are searched for that can be in a sketch: not above the largest sketch value
   of the partitions whose items can be inside a set of its size. They meet the sketches by hash; what meets is a candidate.
3. Candidates are verified on the texts: the shingles themselves, words and all, that both sets hold.

Scale: documents are read twice and nothing of them is shuffled but the few rows that hit a sketch. Sketches and
candidates are broadcast up to ``BROADCAST_ROWS`` rows; beyond, both sides are shuffled (by hash, then by row).

Defined results: null and empty texts have no shingles and match nothing; a text of fewer than five words is
one shingle of all of them; equal documents match alike, repeated rows count once; rows of one id (or without id) with
different texts are judged one by one, the largest share counts; equal items are items of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import cut

WORDS = 5
PERCENT = 75
BROADCAST_ROWS = 1_000_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def _once(value: Column, use) -> Column:
    """use(value) with value worked out once: one lambda argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Distinct hashes of the k-word shingles of lower-cased text."""
    hashes = lambda words: F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])), 1, F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.array_distinct(_once(_words(text), hashes))


def shingles(text: Column, k: int = WORDS) -> Column:
    """The distinct k-word shingles of lower-cased text themselves."""
    joined = lambda words: F.slice(F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, k), " ")), 1, F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.array_distinct(_once(_words(text), joined))


def sketches(items: DataFrame, item_id: str, text: str, k: int, percent: int) -> DataFrame:
    """item_id, item (its set's name), n_item, need, part (its size class) and sketch, for each different set of an item."""
    sets = items.select(F.col(item_id).alias("item_id"), F.xxhash64(text).alias("item"), F.array_sort(shingle_hashes(F.col(text), k)).alias("hs")).distinct()
    sized = sets.withColumn("n_item", F.size("hs").cast("long")).where("n_item > 0")
    sized = sized.withColumn("need", F.ceil(F.col("n_item") * percent / F.lit(100)).cast("long"))
    sized = sized.withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    return sized.select("item_id", "item", "n_item", "need", "part", F.slice("hs", 1, (F.col("n_item") - F.col("need") + 1).cast("int")).alias("sketch"))


def _search_limit(index: DataFrame, n_doc: Column) -> Column:
    """The largest hash that a set of ``n_doc`` is searched with: by partition of items, of which there is one for each power of two."""
    parts = index.groupBy("part").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("top")).collect()
    limits = [F.when(n_doc >= r["need"], F.lit(r["top"])) for r in parts]
    return F.greatest(*limits, F.lit(None), F.lit(None)).cast("long") if limits else F.lit(None).cast("long")


def candidates(docs: DataFrame, index: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, row (its text's name) and the item, for documents that hold a shingle of the item's sketch and are large enough."""
    sets = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), shingle_hashes(F.col(text), k).alias("hs"))
    sets = sets.select("doc_id", "row", F.size("hs").alias("n_doc"), "hs")
    limit = _search_limit(index, F.col("n_doc"))
    rows = sets.withColumn("limit", limit).select("doc_id", "row", "n_doc", F.explode(F.filter("hs", lambda h: h <= F.col("limit"))).alias("h"))
    searched = index.select("item_id", "item", "n_item", "need", F.explode("sketch").alias("h"))
    small = searched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(searched) if small else searched, "h").where("n_doc >= need")
    return met.select("doc_id", "row", "item_id", "item", "n_item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id) whose document holds at least ``percent`` of the item's shingles, with n_item, n_shared, containment."""
    kept = contaminated_rows(docs, items, doc_id, text, item_id, item_text, k, percent)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def contaminated_rows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (a hash of its text), item_id, n_item, n_shared: a row for each row of documents that holds enough of an item."""
    index = cut(sketches(items, item_id, item_text, k, percent), "item-sketches")
    found = cut(candidates(docs, index, doc_id, text, k), "candidates")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tests = items.select(F.col(item_id).alias("_item_id"), F.xxhash64(item_text).alias("_item"), shingles(F.col(item_text), k).alias("_item_shingles")).distinct()
    wanted = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("item_id", "item")).alias("_asked")).withColumnsRenamed({"doc_id": "_doc_id", "row": "_row"})
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("_text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    pairs = texts.select("doc_id", "row", shingles(F.col("_text"), k).alias("_shingles"), F.explode("_asked").alias("_a"))
    both = pairs.join(tests, (F.col("_a.item") == F.col("_item")) & F.col("_a.item_id").eqNullSafe(F.col("_item_id")))
    shared = both.select("doc_id", "row", F.col("_item_id").alias("item_id"), F.size("_item_shingles").cast("long").alias("n_item"), F.size(F.array_intersect("_shingles", "_item_shingles")).cast("long").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
