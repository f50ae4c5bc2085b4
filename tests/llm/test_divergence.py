"""Divergence audit against plain counting, with small chunks, blocks and tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from driftline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    upper = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(upper))) for text, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted(s for k, s in counts if k == lang)

        def share(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            far = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, p[s][t] - whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", far, None), ("term", more, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(n=400, seed=2):
    rng = random.Random(seed)
    words = ["Haus", "HAUS", "straße", "été", "Σοφία", "word", "a", "ab", "b", "zz", "don't", "x1y", "\x00q", "日本"]
    rows = [(" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30))), rng.choice(["de", "en", None]), rng.choice([f"s{i}" for i in range(9)] + [None])) for _ in range(n)]
    rows += [(None, "de", "s0"), ("", "fr", "only"), ("rare words here", "it", "a"), ("others", "it", "b"), ("z" * 3_000_000 + " word", "de", "s1")]
    return rows + rows[:50]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("chunk, groups, held", [(3, 2, 7), (1, 100, 10**6), (1024, 3, 50)])
def test_audit(spark, monkeypatch, chunk, groups, held):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = made()
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5), min_docs=30, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == plain(rows, 30, 4)


def test_long_texts_in_pieces():
    text = ("Wort " * 300_000 + "ß" * 5_000_000 + " ende").encode()
    assert sum(divergence._pieces(text), []) == divergence.terms(text)


def test_clashing_columns_and_empty(spark):
    rows = made(60)
    frame = spark.createDataFrame([(t, k, s, "x", 1, 2, 3, "y") for t, k, s in rows], "text string, lang string, source string, term string, n int, docs int, chunk int, other string")
    assert rows_of(divergence.audit(frame, min_docs=5)) == plain(rows, 5, 50)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_are_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    counts = rng.integers(0, 2**40, (3, 50))
    totals = counts.sum(axis=1) + 2**52
    assert divergence.shares(counts, totals, 50).tolist() == [[1 + 10**9 * (int(c) + 5) // (int(t) + 250) for c in row] for row, t in zip(counts, totals)]
