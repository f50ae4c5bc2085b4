"""Nulls, empty and very long texts, repeats, several texts under one id, clashing columns and empty tables, for the operators whose other tests have none."""

import hashlib
import random

import brute
import public_tokenizers
from pyspark.sql import functions as F

from driftline.llm import bpe, decontam, queries, substrings, suffixes, topk

rng = random.Random(53)


def words(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


PASSAGE = words(100)
LONG = " ".join([words(20_000), PASSAGE, words(20_000)])
FOUR = f"{words(9)} {PASSAGE}"
ROWS = [(1, None), (1, PASSAGE), (2, ""), (3, LONG), (4, FOUR), (4, FOUR), (5, words(30)), (5, words(30)), (None, PASSAGE), (None, None), (7, "  \t\n ")]
CLASHING = "doc_id long, text string, spans string, kept int, n_words string, n_bytes string, ids string, _spans0 string, _id string, row string"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", 1, "w", "b", "i", "x", "y", "z") for i, t in rows], CLASHING).repartition(5)


def key(rows):
    return sorted(rows, key=str)


def test_bpe(spark):
    path = public_tokenizers.path(queries.RANKS)
    both = bpe.decode(bpe.encode(table(spark), path, public_tokenizers.PATTERN), path, out="decoded")
    out = key((r.doc_id, len(r.ids), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in both.collect())
    assert out == key((i, n, h) for i, n, _, h in brute.bpe_rows(ROWS, path, public_tokenizers.PATTERN))
    assert both.columns.count("ids") == 1 and "spans" in both.columns
    assert bpe.decode(bpe.encode(table(spark).limit(0), path, public_tokenizers.PATTERN), path).count() == 0
    broken = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.bytes) for r in bpe.decode(broken, path).collect()] == [b"", b""]


def test_substrings(spark):
    out = substrings.remove_repeats(table(spark))
    assert "spans" in out.columns and out.where("spans <> 's'").count() == 0
    got = key((r.doc_id, r.n_words, r.n_removed) for r in out.collect())
    # the passage of documents 3 and 4 is in document 1; a row without id takes no part
    n = lambda t: len((t or "").split())
    assert got == key((i, n(t), 100 if i in (3, 4) else 0) for i, t in ROWS)
    assert substrings.remove_repeats(table(spark).limit(0)).count() == 0


def test_collisions_are_not_removed(spark, monkeypatch):
    """With hashes of one byte nearly every node meets others: the comparison of words decides."""
    monkeypatch.setattr(substrings, "HASH_BYTES", 1)
    docs = [(i, f"{words(25)} {PASSAGE if i % 3 == 0 else words(40)} {words(25)}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect())
    assert got == sorted(brute.window_rows(docs))


def test_suffixes(spark):
    out = suffixes.remove_repeats(table(spark))
    size = len(PASSAGE.encode())
    assert size >= 400 and "spans" in out.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert got[2] == [(0, 0)] and got[7] == [(5, 0)] and all(removed == 0 for _, removed in got[None] + got[5])
    assert (size, size) in got[1] and (0, 0) in got[1] and got[4][0][1] == got[4][0][0] == got[4][1][1]  # repeated rows lose all
    (n, removed), = got[3]
    assert n == len(LONG.encode()) and size <= removed <= size + 8  # what stands around the passages may agree by chance
    assert suffixes.remove_repeats(table(spark).limit(0)).count() == 0


def test_planted_passages_are_caught(spark):
    """Passages of 400 bytes and more in other texts go; texts without any are left alone."""
    planted = [words(rng.randint(90, 200)) for _ in range(8)]
    docs = [(i, f"{words(60)} {planted[i % 8]} {words(40)}" if i < 40 else words(150)) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for operator, name in ((suffixes, "n_bytes"), (substrings, "n_words")):
        found = {r.doc_id: r.n_removed for r in operator.remove_repeats(df).collect()}
        first = 8 if operator is substrings else 0  # the first document of a passage keeps its words
        assert all(found[i] > 0 for i in range(first, 40)) and all(found[i] == 0 for i in range(40, 80)), name


def test_topk(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 0.0]), (40, [1.0, 0.0]), (5, [2.0, 2.0]), (None, [9.0, 9.0]), (7, None), (8, []), (9, [float("inf"), 0.0]), (11, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df).collect()]
    asked = {}
    for q, _, v, s in sorted(out):
        asked.setdefault(q, []).append((v, s))
    assert set(asked) == {20, 40} and all(v != q for q, found in asked.items() for v, _ in found)
    assert asked[40][0] == (5, 64 * 128) and (11, 64 * 64) in asked[40] and [s for _, s in asked[40]] == sorted((s for _, s in asked[40]), reverse=True)
    assert topk.search(df.limit(0)).count() == 0


def test_decontamination_by_row(spark):
    item = words(40)
    half = item.split()
    first, second = " ".join(half[:22]), " ".join(half[18:])  # neither holds three quarters
    docs = [(1, f"{words(9)} {first}"), (1, f"{second} {words(9)}"), (None, first), (None, second), (None, item), (2, item), (2, item), (3, None), (4, f"{words(5_000)} {item} {words(5_000)}")]
    df = table(spark, docs)
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "y"), (None, item, "z"), (3, None, "n"), (4, "", "e")], "item_id long, text string, doc_id string")
    out = key((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.contaminated(df, bench).collect())
    assert out == key((d, i, 36, 36) for d in (None, 2, 4) for i in (None, 1, 2))
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_the_search_decides(spark, monkeypatch):
    """Candidates come from the sketches alone: without them nothing is found."""
    item = words(40)
    docs, bench = table(spark, [(1, f"{words(9)} {item}")]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 1
    made = decontam.sketches
    monkeypatch.setattr(decontam, "sketches", lambda *a: made(*a).withColumn("sketch", F.transform("sketch", lambda h: F.lit(7).cast("long"))))
    assert decontam.contaminated(docs, bench).count() == 0
