"""All five stages on a table of nulls, repeats, extra and absent columns, against plain Python."""

import random

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from driftline.llm import queries, secrets

rng = random.Random(41)
WORDS = {"de": ["der", "und", "straße", "nicht", "über", "haus", "wasser", "heute"], "en": ["the", "and", "street", "not", "over", "house", "water", "today"]}


def text(lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "en", "s", "er"]) for _ in range(n))


ITEM = text("en", 30)
COPY = text("de", 60)


def documents():
    rows = [(i, text(k, rng.randint(20, 80)), k if i % 3 else None) for i, k in enumerate(["de", "en"] * 15)]
    rows += [(100, COPY, "de"), (101, COPY + " ende", "de"), (102, COPY, None), (103, COPY.upper(), "de")]  # a group
    rows += [(110, f"{text('en', 15)} {ITEM} {text('en', 10)}", "en"), (111, text("en", 40) + ' api_key = "Zx81kkQpq9Lm2" and on', "en")]
    rows += [(120, None, "de"), (121, "", "en"), (122, "12 34 !!", None)]
    rows += [(130, text("en", 40), "en")] * 2  # a row that is repeated
    rows += [(140, f"{text('en', 12)} {ITEM}", "en"), (140, text("de", 50), "de")]  # two texts under one id, one contaminated
    twice = text("de", 50)
    rows += [(150, twice, "de"), (150, twice + " ende", "de")]  # two texts under one id, near copies of each other
    rows += [(None, text("de", 44), "de")]
    return rows


ROWS = documents()


def expected(rows, kept_by_language):
    rows = [r for r in rows if r[1] and kept_by_language(r[1])]
    named = list(enumerate(rows))
    groups = brute.components([(n, r[1]) for n, r in named])
    first = {}
    for n, (i, t, _) in named:
        if i is not None:
            best = first.get(groups[n][1])
            first[groups[n][1]] = min(best, (i, n)) if best else (i, n)
    near = [r for n, r in named if r[0] is None or first[groups[n][1]][0] == r[0] and sum(1 for m, q in named if m < n and q[0] == r[0] and groups[m][1] == groups[n][1] and q[1] == r[1]) == 0]
    items = [(1, ITEM)]
    clean = [r for r in near if not list(brute.leak_rows([(0, r[1])], items))]
    return clean


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "char_length(text) as n_chars", "1 as score", "'x' as row", "'y' as ids").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        kept[name] = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect())
    languages = [t for _, t in kept["language ID"]]
    assert sorted(languages) == sorted(r[1] for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))
    wanted = expected(ROWS, lambda t: t in set(languages))
    got = kept["benchmark decontamination"]
    # of two near copies under one id either may stay
    pick = lambda rows: sorted((i, t) for i, t in rows if i != 150)
    assert pick(got) == pick(((r[0] if r[0] is not None else -1), r[1]) for r in wanted)
    assert sum(i == 150 for i, _ in got) == 1 and sum(i == 130 for i, _ in got) == 1 and [t for i, t in got if i == 140] and all(i != 110 for i, _ in got)
    redacted = dict(kept["secret scans"])
    assert "Zx81kkQpq9Lm2" not in redacted[111] and "[SECRET]" in redacted[111] and not any(secrets.scan_text(t) for _, t in kept["secret scans"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert all(r.round_trip for r in out)
    path = public_tokenizers.path(queries.RANKS)
    counts = sorted(n for _, n, _, _ in brute.bpe_rows([(0, t) for _, t in kept["secret scans"]], path, public_tokenizers.PATTERN))
    assert sorted(r.n_tokens for r in out) == counts


def test_run_and_absent_columns(spark, sf, tmp_path):
    ran = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert len(ran) > 20
    few = spark.read.parquet(f"{sf}/documents.parquet").select("text", "doc_id", "lang")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(ran)
    few.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
