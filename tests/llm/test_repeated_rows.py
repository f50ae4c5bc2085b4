"""Substring dedup where rows of one id lie in different partitions, and so in different chunks."""

import random

from driftline.llm import substrings

rng = random.Random(11)


def words(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_rows_of_one_id(spark):
    first, second, own = words(40), words(40), [words(10) for _ in range(3)]
    a, b = f"{first} {own[0]}", f"{own[1]} {words(30)} {second}"
    docs = [(0, f"{first} {own[2]} {second}"), (1, a), (1, a), (2, a), (2, b), (3, own[0])]
    shared = spark.createDataFrame(spark.sparkContext.parallelize(docs, len(docs)), "doc_id long, text string")  # a partition for each row
    assert shared.rdd.getNumPartitions() == len(docs)
    out = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(shared, keep=["doc_id"]).collect())
    # of id 2, the repeats of a (all of it, document 1 has it) and of b (words 40 to 80) go from both
    expected = [(0, 90, 0, docs[0][1]), (1, 50, 40, own[0]), (1, 50, 40, own[0]), (2, 50, 50, ""), (2, 80, 80, ""), (3, 10, 0, own[0])]
    assert out == sorted(expected)
