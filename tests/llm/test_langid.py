"""Code lengths against PPM written down plainly, on small data."""

import math
import random
from collections import Counter

import pytest

from driftline.llm import langid

rng = random.Random(31)
WORDS = {"de": ["der", "und", "straße", "nicht", "über", "haus"], "en": ["the", "and", "street", "not", "over", "house"], "fr": ["le", "et", "rue", "pas", "où", "maison"]}


def text(lang, n=25):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


LABELLED = [(i, text(k), k) for i, k in enumerate(list(WORDS) * 12)]


def tree(texts, order=langid.ORDER):
    """How often each byte came after each context of up to ``order`` bytes; line ends stand before a text."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        data = b"\n" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    return counts


def code_length(counts, t, order=langid.ORDER):
    """Bits of a text: escape method C without exclusion; a context that never came costs nothing."""
    data, bits = b"\n" * order + t.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8.0
    return bits


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.createDataFrame(LABELLED, "doc_id long, text string, lang string"))


def test_code_lengths(model):
    trees = {k: tree({t for _, t, lang in LABELLED if lang == k}) for k in WORDS}
    texts = [text(k, n) for k in WORDS for n in (1, 7, 60)] + ["zzz qqq", "12 der le", "日本語 und", "x", "\n\n", "the the the straße"]
    found = model.bits([t.encode() for t in texts])
    langs, scores, rates = model.predict(texts)
    for t, row, lang, score, rate in zip(texts, found, langs, scores, rates):
        expected = [code_length(trees[k], t) for k in model.langs]
        assert row.tolist() == pytest.approx(expected, rel=1e-5, abs=1e-3), t
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        best = min(range(3), key=lambda i: expected[i])
        assert lang == model.langs[best] and score == pytest.approx(1 / sum(2 ** (min(expected) - x) for x in expected), abs=1e-3)
        assert rate == pytest.approx(min(expected) / len(t.encode()), rel=1e-4)


def test_ties_and_rows(spark, model):
    same = langid.learn(spark.createDataFrame([(1, "abc", "xx"), (2, "abc", "aa")], "doc_id long, text string, lang string"))
    assert same.predict(["abc"]) [0] == ["aa"] and same.predict(["abc"])[1] == pytest.approx([0.5])
    rows = [(1, None, "s", "l"), (1, "", "s", "l"), (2, text("de"), "s", "l"), (2, text("en"), "s", None), (None, "der und " * 200_000, None, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, lang_pred string")  # columns named like the new ones
    out = langid.predict(df, model, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "de"), (1, "und"), (1, "und"), (2, "de"), (2, "en")]
    assert all(0.0 <= r.score <= 1.0 for r in out)
    assert langid.predict(df.limit(0), model).count() == 0


def test_repeated_texts_do_not_starve_a_label(spark, monkeypatch):
    """A label of few texts in many copies is learnt from all of them; one of many texts from one at least."""
    seen = []
    real = langid.map_batches

    def spy(df, *a, **k):
        if df.columns == ["text", "lang"]:
            seen.append({(r.text, r.lang) for r in df.collect()})
        return real(df, *a, **k)

    monkeypatch.setattr(langid, "map_batches", spy)
    few = [text("de", 8) + f" {i}" for i in range(30)]
    rows = [(few[i % 30], "de") for i in range(6000)] + [(f"{text('en', 4)} {i}", "en") for i in range(200)]
    langid.learn(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample=40)
    drawn = seen[0]
    assert {t for t, k in drawn if k == "de"} == set(few) and 0 < len([1 for _, k in drawn if k == "en"]) < 120
    langid.learn(spark.createDataFrame(rows, "text string, lang string"), sample=0)
    assert {k for _, k in seen[1]} == {"de", "en"} and len(seen[1]) < 6
