"""License scan by diagonal voting, DataFrame functions only.

Templates are the phrases that name a license and the sentences by which license texts are known.

1. All rolling word k-grams of the texts are hashed (k is 2, and 3 for templates of three words and more) and meet the k-grams of
   the templates by a join on the hash; the words of both are compared there and then.
2. Where the k-gram at word i of a text is that at word j of a template, the diagonal i - j gets the vote j. Votes are
   aggregated by text, template and diagonal.
3. Neighbouring diagonals (``SHIFT`` words at most) of a template are merged: words put in or left out move what follows to the next diagonal.
4. Spans are verified: a phrase needs every vote of one diagonal, which is that its words stand there one after the other; a longer
   template needs ``PERCENT`` of its words covered by what agreed on the merged diagonals.

Scale: texts are read where they lie and only the k-grams that agree with a template are shuffled. Templates are a broadcast table
of this module or of the caller's, held to ``TEMPLATE_GRAMS`` k-grams; more are joined by a shuffle. The windows that merge diagonals hold the votes of
one text and template.

Defined results: null and empty texts have no words and no spans; words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in
lower case; rows of one id with different texts are judged one by one, equal rows alike; templates of one word are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import cut

SHIFT, PERCENT, LONGEST = 3, 75, 3
TEMPLATE_GRAMS, BROADCAST_ROWS = 200_000, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words (as the scan sees them) that stand for a license; a phrase must stand as it is, a text may differ a little."""

    label: str
    words: str
    phrase: bool = False


# Names of licenses: fixed values.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
# Sentences of the published license texts, punctuation left out: fixed values.
TEXTS = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = PHRASES + TEXTS


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _hash(k: int, of, i: Column) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(of, i + j) for j in range(k)])


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, label, phrase, its words, size (k), place and h (hash) of every k-gram of the templates."""
    if any(len(t.words.split()) < 2 for t in templates):
        raise ValueError("a template needs two words at least")
    rows = spark.createDataFrame([(i, t.label, t.phrase, t.words.split()) for i, t in enumerate(templates)], "template int, label string, phrase boolean, template_words array<string>")
    own = F.col("template_words")
    rows = rows.withColumn("size", F.least(F.size(own), F.lit(LONGEST))).withColumn("place", F.explode(F.sequence(F.lit(0), F.size(own) - F.col("size"))))
    return rows.withColumn("h", F.coalesce(*[F.when(F.col("size") == k, _hash(k, own, F.col("place"))) for k in range(2, LONGEST + 1)]))


def votes(docs: DataFrame, grams: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (a hash of the text), the template, a diagonal and the template's places that agree on it."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), words(F.col(text)).alias("own"))
    sizes = [r[0] for r in grams.select("size").distinct().orderBy("size").collect()]  # 2 and 3 at most
    rolling = F.transform("own", lambda w, i: F.array(*[_hash(k, F.col("own"), i) for k in sizes]))
    rows = own.select("doc_id", "row", F.posexplode(rolling).alias("i", "hs")).select("doc_id", "row", "i", F.explode("hs").alias("h"))
    few = grams.limit(TEMPLATE_GRAMS + 1).count() <= TEMPLATE_GRAMS
    met = rows.join(F.broadcast(grams) if few else grams, "h")
    keys = ["doc_id", "row", "template", "label", "phrase", "template_words", "size"]
    return met.groupBy(*keys, (F.col("i") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))


def _covered(votes: Column, size: Column, agrees=None) -> Column:
    """How many words of the template lie in the k-grams of votes (diagonal, places); with ``agrees`` only those that it accepts."""
    at = lambda v: F.flatten(F.transform(v["places"], lambda p: F.sequence(p, p + size - 1)))
    own = lambda v: at(v) if agrees is None else F.filter(at(v), lambda t: agrees(v["diagonal"], t))
    return F.size(F.array_distinct(F.flatten(F.transform(votes, own))))


def _enough(covered: Column, words_of: Column, phrase: Column) -> Column:
    return covered * 100 >= F.size(words_of) * F.when(phrase, 100).otherwise(PERCENT)


def merged(found: DataFrame) -> DataFrame:
    """Spans of texts: votes on neighbouring diagonals together, as far as they cover enough of the template."""
    line = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(line) > SHIFT), F.lit(True))
    found = found.withColumn("_new", apart.cast("int")).withColumn("cluster", F.sum("_new").over(line))
    keys = ["doc_id", "row", "template", "label", "phrase", "template_words", "size", "cluster"]
    spans = found.groupBy(*keys).agg(F.collect_list(F.struct("diagonal", "places")).alias("votes"), F.min(F.col("diagonal") + F.array_min("places")).alias("start"), F.max(F.col("diagonal") + F.array_max("places") + F.col("size")).alias("end"))
    return spans.where(_enough(_covered(F.col("votes"), F.col("size")), F.col("template_words"), F.col("phrase")))


def _verified(own: Column, spans: Column) -> Column:
    """The spans whose words are those of their template, with how much of it they cover."""
    same = lambda s: lambda diagonal, t: F.get(own, diagonal + t) == F.get(s["template_words"], t)
    checked = F.transform(spans, lambda s: F.struct(s["label"].alias("label"), s["phrase"].alias("phrase"), s["start"].alias("start"), s["end"].alias("end"), _covered(s["votes"], s["size"], same(s)).alias("covered"), s["template_words"].alias("template_words")))
    kept = F.filter(checked, lambda s: _enough(s["covered"], s["template_words"], s["phrase"]))
    return F.transform(kept, lambda s: F.struct(s["label"].alias("label"), s["phrase"].alias("phrase"), s["start"].alias("start"), s["end"].alias("end"), (s["covered"] / F.size(s["template_words"])).alias("coverage")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words and spans, an array of (label, phrase, start, end, coverage) by start; words from 0, end exclusive."""
    found = merged(votes(docs, template_grams(docs.sparkSession, templates), doc_id, text))
    by_text = cut(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("label", "phrase", "start", "end", "votes", "size", "template_words")).alias("spans")), "license-spans")
    few = by_text.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (by_text.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS // 8
    by_text = by_text.withColumnsRenamed({"doc_id": "_doc_id", "row": "_row"})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(by_text) if few else by_text, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    both = F.struct(words(F.col("_text")).alias("own"), F.col("spans").alias("spans"))
    out = F.get(F.transform(F.array(both), lambda b: F.struct(F.size(b["own"]).cast("long").alias("n_words"), F.when(b["spans"].isNotNull(), F.array_sort(_verified(b["own"], b["spans"]), lambda x, y: (x["start"] - y["start"]).cast("int"))).alias("spans"))), 0)
    empty = F.array().cast("array<struct<label:string,phrase:boolean,start:int,end:int,coverage:double>>")
    return rows.select("doc_id", out.alias("o")).select("doc_id", "o.n_words", F.coalesce("o.spans", empty).alias("spans"))


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of the phrases), base_labels, labels and score (the largest coverage) of a scan."""
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
