"""A training-corpus pipeline: language ID, near copies, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Columns of documents pass
through; the last stage returns tokens with the columns that tell documents apart. A document without text or letters goes at
the first stage; a document without id is never dropped as a copy. Decisions are taken for rows: where texts differ under one
id, each is judged by itself. Of equal rows one stays. Extra columns pass through, whatever their names; lang, source and
n_chars may be absent.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontam, jaccard, langid, queries, secrets
from driftline.tables import cut

#: Ids to drop are broadcast up to so many; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Texts whose language has a posterior below this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are among ``rows`` (doc_id, row: the hash of a text)."""
    gone = cut(rows.select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct(), "dropped-rows")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = (F.xxhash64(docs["text"]) == F.col("_gone_row")) & docs["doc_id"].eqNullSafe(F.col("_gone_id"))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found; those of no language go."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    known = docs.select("doc_id", "text", lang).where(~F.coalesce(queries.held_out(F.col("doc_id")), F.lit(False)))
    model = langid.learn(known)
    own = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}  # columns may have the names of the new ones
    found = langid.predict(docs.withColumnsRenamed(own), model)
    clear = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return clear.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id; one row of repeated rows."""
    found = cut(jaccard.near_copies(docs).where("doc_id is not null").select("doc_id", "row", "group", "component_id"), "near-copies")
    own = found.where("doc_id = component_id and group is not null")
    # texts under one id that are copies of each other
    several = own.groupBy("group").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select(F.col("group").alias("_group"), "first")
    beside = own.join(several, (F.col("group") == F.col("_group")) & (F.col("row") > F.col("first")))
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id", "row").union(beside.select("doc_id", "row")))
    repeated = not found.groupBy("doc_id", "row").count().where("count > 1").isEmpty()
    if not repeated:
        return kept
    # rows without id stay; of the others one for each id and text
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.contaminated_rows(docs, items).select("doc_id", "row"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; lengths follow."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding them."""
    path = public_tokenizers.path(queries.RANKS)
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    both = bpe.round_trip(docs.select(*names, "text"), path, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select(*names, F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("byte-level BPE", tokens),
]

#: Language ID and BPE have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
