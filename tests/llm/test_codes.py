"""Product codes against k-means in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from driftline.llm import codes


def plain(rows, parts, entries, rounds):
    fit = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in fit), default=0) // parts) * parts
    fit = [(i, v + [0] * (width - len(v)), k) for i, v, k in fit]
    each = width // parts
    cut = lambda v: [tuple(v[p * each : (p + 1) * each]) for p in range(parts)]
    first = {}
    for i, v, _ in sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    seeds = [cut(v) for v in list(first.values())[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in fit:
                own.setdefault(nearest(cut(v)[p], books[p]), []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else books[p][e] for e in range(len(books[p]))]
    out, sums = [], {}
    for i, v, k in fit:
        code = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(far(x, books[p][c]) for p, (x, c) in enumerate(zip(cut(v), code)))
        sums[k] = sums.get(k, 0) + error
        out.append((i, code, error, k))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[k], digest) for i, c, e, k in out), key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<double>, label int, codes string, error int").repartition(5)
    return sorted(((r.vec_id, r.codes, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(frame).collect()), key=str)


def made(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.01, 1, 3]) for _ in range(width)], rng.choice([0, 1, None])) for i in rng.sample(range(10 * n), n)]
    rows += [(7, None, 1), (8, [0.5] * (width - 1) + [None], 1), (9, [float("nan")] * width, 1), (11, [float("inf")] * width, None)]
    return rows + rows[:5]


@pytest.mark.parametrize("n, width", [(300, 32), (90, 16), (20, 48)])
def test_against_plain(spark, n, width):
    rows = made(n, width, n)
    assert found(spark, rows) == plain(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)


def test_uneven_lengths_and_missing_ids(spark):
    rows = made(80, 16, 1) + [(None, [1.0] * 16, 0), (None, [2.0] * 16, 0), (5000, [0.25] * 5, 2), (5001, [], 2), (5002, [1.0] * 20, None), (5000, [0.125] * 5, 2)]
    assert found(spark, rows) == plain(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)


def test_large_components_stay_exact(spark):
    rows = [(i, [(-1) ** i * 2.0**20 * (i + 1) / 3] * 16, 1) for i in range(70)]
    assert found(spark, rows) == plain(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)


def test_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_hot_label_beyond_the_broadcast(spark, monkeypatch):
    rows = made(120, 16, 6)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert found(spark, rows) == plain(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)


def test_decode(spark):
    rows = made(100, 16, 3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = codes.train(frame)
    for r in codes.decode(codes.encode(frame, books), books).collect():
        x = np.floor(np.array(r.embedding) * 256)
        assert ((x - np.array(r.approximate) * 256) ** 2).sum() == r.error
