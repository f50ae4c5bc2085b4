"""The prefix-tree join against all pairs, and its small cases."""

import random

import brute
import numpy as np
import pytest

from driftline.llm import jaccard

rng = random.Random(17)


def linked(a, b, percent):
    o = len(set(a) & set(b))
    return 100 * o >= percent * (len(a) + len(b) - o)


def roots(m, pairs):
    root = list(range(m))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [y if r == x else r for r in root]
    return [min(i for i in range(m) if root[i] == root[j]) for j in range(m)]


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_trie_join(percent):
    for _ in range(60):
        base = rng.sample(range(1000), rng.randint(1, 40))
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = [t for t in base if rng.random() < 0.93] + rng.sample(range(1000, 2000), rng.choice([0, 0, 1, 3, 12]))
            sets.append(np.array(sorted(set(own or [5])), dtype=np.uint64))
        expected = {(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i].tolist(), sets[j].tolist(), percent)}
        found = jaccard.trie_join(sets, percent)
        assert {(max(p), min(p)) for p in found} == expected and len(found) == len(expected)
        forest = jaccard.trie_join(sets, percent, forest=True)
        assert roots(len(sets), forest) == roots(len(sets), expected) and len(forest) == len(sets) - len(set(roots(len(sets), expected)))


def test_rows_of_one_id(spark):
    """Nulls, texts and repeated rows under one id; no id; an empty table; a column named like one of ours."""
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join(words[:38]), " ".join(reversed(words))
    rows = [(1, a), (1, None), (2, b), (2, b), (3, ""), (3, "one two"), (4, "one TWO"), (5, c), (5, a), (None, a), (6, "x " * 100_000)]
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, node string, row int")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_copies(df).collect())
    assert out == sorted([(1, 36, 1), (1, 0, 1), (2, 34, 1), (2, 34, 1), (3, 0, 3), (3, 1, 3), (4, 1, 3), (5, 36, 5), (5, 36, 1), (0, 36, None), (6, 1, 6)])
    assert jaccard.near_copies(df.limit(0)).count() == 0


def test_chain_and_common_passage(spark):
    """A chain of revisions, each near the next only, and many texts around one passage, near and not near each other."""
    words = [f"c{i}" for i in range(60)]
    docs = []
    for i in range(40):
        words = words[2:] + [f"n{i}a", f"n{i}b"]
        docs.append((1000 - i, " ".join(words)))
    passage = [f"p{i}" for i in range(60)]
    for i in range(150):
        docs.append((i, " ".join(passage + [f"own{i}_{j}" for j in range(i % 30)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(df).collect())
    assert got == sorted((i, *v) for i, v in brute.components(docs).items())


def thue_morse(n, first):
    out = first
    while len(out) < n:
        out += "".join("ab"[c == "a"] for c in out)
    return out[:n]


def test_words_of_a_structure_that_defeats_polynomials(spark):
    """Words whose bytes are complementary Thue-Morse sequences are alike to any polynomial modulo a power of two."""
    from driftline.llm._hashing import Words

    for n in (1024, 2048, 4096):
        pair = [thue_morse(n, c).encode() for c in "ab"]
        a, b = Words(pair).hashes()
        assert a != b
        rows = [(2 * n, f"{pair[0].decode()} one two three four"), (2 * n + 1, f"{pair[1].decode()} one two three four")]
        got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {2 * n: 2 * n, 2 * n + 1: 2 * n + 1}


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from driftline.llm import _hashing

    texts = [b"aa bb  aa", b"", b"cc aa " * 50, b"x" * 5000]
    before = _hashing.Words(texts).hashes().tolist()
    monkeypatch.setattr(_hashing, "PLACED_WORDS", 3)
    assert _hashing.Words(texts).hashes().tolist() == before and before[0] == before[2] != before[1]


def _near(rng, n, edits):
    """Two sets of about n shingles that differ in up to ``edits``."""
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return [np.unique(np.concatenate([base[rng.permutation(n)[: n - int(rng.integers(0, edits + 1))]], rng.integers(0, 1 << 63, int(rng.integers(0, edits + 1)), dtype=np.uint64)])) for _ in range(2)]


def test_bounds_and_sketches_lose_no_link():
    rng, linked, passed, apart_ = np.random.default_rng(3), 0, 0, 0
    for _ in range(1500):
        n = int(rng.integers(8, 600))
        a, b = _near(rng, n, n // 8)
        common = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(jaccard.sketch(s), np.uint8)[None] for s in (a, b))
        differ = len(a) + len(b) - 2 * common
        assert jaccard.apart_at_least(x, y)[0] <= differ
        link = 100 * common >= jaccard.PERCENT * (differ + common)
        fits = jaccard.apart_at_least(x, y)[0] <= len(a) + len(b) - 2 * jaccard.overlap_of(len(a), len(b))
        prefixes = [s[: len(s) - jaccard.need(len(s)) + min(jaccard.extra(len(s)), jaccard.need(len(s)))] for s in (a, b)]
        shared = len(np.intersect1d(*prefixes))
        if link:
            linked += 1
            assert fits and shared >= jaccard.least_shared(len(a), len(b))
        else:
            apart_ += 1
            passed += fits
    assert linked > 300 and apart_ > 300 and passed < apart_ / 3


def test_pairs_of_different_components(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_CELLS", 100)
    rng = np.random.default_rng(4)
    for _ in range(20):
        m = int(rng.integers(2, 60))
        n, comp, room = np.sort(rng.integers(20, 40, m)), rng.integers(0, 4, m), rng.integers(1, 9, m)
        found = sorted(tuple(sorted(p)) for i, j in jaccard.apart(n, comp, room) for p in zip(i.tolist(), j.tolist()))
        fits = lambda i, j: min(n[i], n[j]) * 100 >= jaccard.PERCENT * max(n[i], n[j])  # noqa: B023, E731
        able = lambda i, j: comp[i] != comp[j] and min(room[i], room[j]) >= jaccard.least_shared(n[i], n[j])  # noqa: B023, E731
        assert len(set(found)) == len(found)
        assert [p for p in found if fits(*p)] == [(i, j) for i in range(m) for j in range(i + 1, m) if able(i, j) and fits(i, j)]


def test_known_components_are_not_joined_again():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i:], base[:i][:-2]])) for i in range(3, 9)]
    assert len(jaccard.trie_join(sets, forest=True)) == 5
    assert jaccard.trie_join(sets, forest=True, of=[7] * 6) == []
    joined = jaccard.trie_join(sets, forest=True, of=[1, 1, 1, 2, 2, 2])
    assert len(joined) == 1 and {i < 3 for i in joined[0]} == {True, False}


def test_few_pairs_of_a_large_family_are_verified(spark, monkeypatch):
    """Copies of a text that are too far from each other to link, and from the rest of its family."""
    seen = []
    real = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda docs, rows, pairs, *a: seen.append(pairs.count()) or real(docs, rows, pairs, *a))
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(240):
        own, edits = list(words), 2 if i < 200 else 18
        for at in rng.choice(400, edits, replace=False):
            own[at] = f"x{i}_{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert found == brute_components(texts)
    assert sum(seen) < 3000


def brute_components(texts):
    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for t in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return dict(enumerate(least))
