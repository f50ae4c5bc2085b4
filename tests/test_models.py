"""Boosting against the same trees in plain NumPy, and the model queries' tree counts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import boosting, models
from driftline.plans import queries

N = 5


def plain(x, y, w, keys, settings, edges):
    """One forest, a node at a time, over raw values; gradients in the same fixed point."""
    mean = (w * y).sum() / w.sum()
    base = float(np.log(mean / (1 - mean))) if settings.logistic else float(mean)
    margin, gains = np.full(len(y), base), {}
    for t in range(settings.trees):
        g, h = boosting.gradients(margin, y, w, settings.logistic)
        rows = np.flatnonzero(boosting.drawn(keys, t, settings))
        columns = boosting.columns_of(t, x.shape[1], settings)
        value = np.zeros(len(y))

        def grow(train, every, depth):
            gs, hs = g[train].sum() / boosting.UNIT, h[train].sum() / boosting.UNIT
            best = (boosting.LEAST_GAIN, None)
            for f in columns if depth < settings.depth else ():
                v = x[train, f]
                for threshold in [*edges[f], np.inf]:
                    for missing_left in (False, True):
                        left = np.where(np.isnan(v), missing_left, v <= threshold)
                        lg, lh = g[train[left]].sum() / boosting.UNIT, h[train[left]].sum() / boosting.UNIT
                        rg, rh = gs - lg, hs - lh
                        if lh >= settings.min_weight and rh >= settings.min_weight:
                            gain = lg**2 / (lh + settings.l2) + rg**2 / (rh + settings.l2) - gs**2 / (hs + settings.l2)
                            if gain > best[0]:
                                best = (gain, (f, threshold, missing_left))
            if best[1] is None:
                value[every] = -settings.step * gs / (hs + settings.l2)
                return
            f, threshold, missing_left = best[1]
            gains.setdefault(f, []).append(best[0])
            side = lambda r: np.where(np.isnan(x[r, f]), missing_left, x[r, f] <= threshold)
            grow(train[side(train)], every[side(every)], depth + 1)
            grow(train[~side(train)], every[~side(every)], depth + 1)

        grow(rows, np.arange(len(y)), 0)
        margin = margin + value
    return margin, {f: float(np.mean(v)) for f, v in gains.items()}


def table(spark, n=400, seed=1, binary=False):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.integers(0, 4, n), rng.uniform(0, 9, n).round(1), rng.integers(0, 2, n), rng.normal(0, 1, n)])
    x[rng.random(n) < 0.3, 0] = np.nan
    x[rng.random(n) < 0.1, 2] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.3, n)
    y = (y > np.median(y)).astype(float) if binary else y
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, e double, y double, fold int").repartition(4)


def columns():
    return {c: F.col(c) for c in "abcde"}


def keys_of(df, x, y):
    """The hash of each row, in the order of x."""
    own = df.select(*[F.col(c).cast("double") for c in "abcde"], "y", F.xxhash64(*[F.col(c) for c in "abcde"], "y", F.lit(-1)).alias("key")).collect()
    found = {(tuple(None if v is None else v for v in r[:5]), r[5]): r[6] for r in own}
    return np.array([found[tuple(None if np.isnan(v) else float(v) for v in r), float(t)] for r, t in zip(x, y)], dtype=np.int64).view(np.uint64)


@pytest.mark.parametrize("binary", [False, True])
def test_against_numpy(spark, monkeypatch, binary):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)  # many blocks
    monkeypatch.setattr(boosting, "RECENT", 4)
    x, y, df = table(spark, binary=binary)
    settings = boosting.Settings(trees=12, depth=3, step=0.3, logistic=binary, min_weight=3.0)
    weight = F.when(F.col("y") > 0, F.lit(1.5)).otherwise(F.lit(1.0)) if binary else None
    forest = boosting.train(df, columns(), F.col("y"), settings, weight)[0]
    edges = boosting.edges_of(df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate("abcde")]), list("abcde"))
    margin, gains = plain(x, y, np.where(y > 0, 1.5, 1.0) if binary else np.ones(len(y)), keys_of(df, x, y), settings, edges)
    assert forest.margin(x) == pytest.approx(margin, abs=1e-9)
    assert forest.gains() == pytest.approx({c: gains.get(i, 0.0) for i, c in enumerate("abcde")}, rel=1e-9)
    scored = boosting.predict(df, [forest], columns(), "m").select("a", "m").collect()
    assert sorted(r.m for r in scored) == pytest.approx(sorted(margin), abs=1e-9)
    again = boosting.train(df.repartition(1), columns(), F.col("y"), settings, weight)[0]
    assert again.to_dict() == forest.to_dict() == boosting.Forest.from_dict(forest.to_dict()).to_dict()  # however rows are dealt out


def test_folds_in_the_same_jobs(spark):
    """Models trained together equal models trained on the other folds' rows alone."""
    _, _, df = table(spark, 300, 5)
    settings = boosting.Settings(trees=4, depth=2, step=0.3, rows=1.0, columns=1.0)
    forests = boosting.train(df, columns(), F.col("y"), settings, fold=F.col("fold"), held_out=[0, 1, None, 7])
    assert forests[2].to_dict() == forests[3].to_dict()
    for k in (0, 1):
        own = np.array([[np.nan if v is None else v for v in r] for r in df.where(f"fold <> {k}").select(*"abcde", "y").collect()])
        x, y = own[:, :5], own[:, 5]
        assert forests[k].base == pytest.approx(y.mean())
        residual = ((forests[k].margin(x) - y) ** 2).mean()
        assert residual < 0.9 * y.var()
    assert forests[0].to_dict() != forests[1].to_dict()


def test_few_jobs_and_the_same_trees(spark, monkeypatch):
    """A few blocks are one task's, with a job for many trees; the trees are those of a job for each level."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    _, _, df = table(spark, 250, 4)
    settings, context = boosting.Settings(trees=6, depth=3, step=0.3, min_weight=3.0), spark.sparkContext
    context.setJobGroup("few-jobs", "")
    alone = boosting.train(df, columns(), F.col("y"), settings, fold=F.col("fold"), held_out=[0, 1, None])
    context.setJobGroup("others", "")
    assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) < 3 * settings.trees
    monkeypatch.setattr(boosting, "ALONE_TREES", 4)
    again = boosting.train(df, columns(), F.col("y"), settings, fold=F.col("fold"), held_out=[0, 1, None])
    monkeypatch.setattr(boosting, "ALONE_BLOCKS", 0)
    levels = boosting.train(df, columns(), F.col("y"), settings, fold=F.col("fold"), held_out=[0, 1, None])
    assert [f.to_dict() for f in alone] == [f.to_dict() for f in again] == [f.to_dict() for f in levels]


def test_features_that_share_a_byte():
    """Bins come back from bytes, and sums of a feature from sums of its byte; a feature that parts nothing takes no room."""
    rng = np.random.default_rng(1)
    edges = [np.array([0.0]), np.array([]), np.array([0.0, 1.0]), np.arange(254.0), np.array([]), np.array([0.0])]
    x = np.column_stack([rng.integers(0, 2, 500), np.full(500, np.nan), rng.integers(0, 3, 500), rng.integers(0, 255, 500), np.ones(500), rng.integers(0, 2, 500)]).astype(float)
    for i in (2, 3, 5):
        x[rng.random(500) < 0.2, i] = np.nan
    bins, g = boosting.binned(x, edges), rng.integers(-9, 9, 500)
    codes = boosting.Codes.of(edges, [int((~np.isnan(x[:, i])).sum()) for i in range(6)], 500)
    rows = codes.encode(bins)
    assert len(codes.cells) == 2 and codes.asked([1, 2, 4]) == [2] and codes.asked([1, 4]) == [1]
    for f in (0, 2, 3, 5):
        byte = codes.place[f][0]
        both = np.stack([np.bincount(rows[byte], v, codes.cells[byte]) for v in (g, np.ones(500))]).astype(np.int64)[:, None]
        own = codes.sums(f, both)[0, 0]
        n = len(edges[f]) + 1
        assert own.tolist() == [int(g[bins[:, f] == b].sum()) for b in [*range(n), 255]]
        for missing_left in (False, True):
            assert (codes.left(f, 0, missing_left)[rows[byte]] == np.where(bins[:, f] == 255, missing_left, bins[:, f] <= 0)).all()


def test_empty_and_constant(spark):
    _, _, df = table(spark, 30, 2)
    assert boosting.train(df.limit(0), columns(), F.col("y"), boosting.Settings(trees=3))[0].trees == []
    flat = boosting.train(df.withColumn("y", F.lit(2.0)), columns(), F.col("y"), boosting.Settings(trees=2))[0]
    assert flat.base == 2.0 and not any((t.feature >= 0).any() for t in flat.trees)


def test_leave_one_out(spark):
    """Folds and r, by SQL over the predictions."""
    rng = np.random.default_rng(3)
    rows = [(f"v{i % 4}" if i % 9 else None, "raw", True, float(abs(rng.normal(5, 4))), float(rng.uniform(1, 90)), float(rng.uniform(0, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "volunteer string, glh_layer string, matched boolean, deviation_m double, glh_accuracy_m double, glh_speed_mps double").withColumn("deviation_m", F.col("deviation_m") + F.col("glh_accuracy_m") / 4)
    scored, bundles = models.leave_one_out(df, trees=20, step=0.2)
    assert len(bundles) == 5
    own = scored.select("volunteer", "fold", "deviation_m", "predicted_deviation_m").toPandas()
    assert own.groupby("volunteer", dropna=False)["fold"].nunique().eq(1).all() and len(own) == 400
    found = {r.fold: r for r in models.calibration(scored).collect()}
    sql = "select fold, count(*) as n, 400 - count(*) as rest, corr(ln(1 + predicted_deviation_m), ln(1 + deviation_m)) as r from own group by 1 union all select null, count(*), 0, corr(ln(1 + predicted_deviation_m), ln(1 + deviation_m)) from own"
    for fold, n, rest, r in duckdb.sql(sql).fetchall():
        assert (found[fold].n_test, found[fold].n_train) == (n, rest) and found[fold].r_log == pytest.approx(r, abs=1e-9)
    assert found[None].r_log > 0.5
    grouped, hashed = models.leave_one_out(df, trees=1, folds=3)
    assert len(hashed) == 3 and {r.fold for r in grouped.select("fold").distinct().collect()} <= {0, 1, 2}


class Asked(Exception):
    pass


@pytest.mark.parametrize("binary", [False, True])
def test_sums_of_the_smaller_children_tell_the_others(binary, monkeypatch):
    rng, n = np.random.default_rng(8), 3000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)])
    edges = [np.sort(rng.normal(size=30)), np.arange(4.0), np.sort(rng.normal(size=200))]
    codes = boosting.Codes.of(edges, [n] * 3, n)
    settings = boosting.Settings(depth=4, min_weight=1.0, logistic=binary)
    y, w = (x[:, 0] + rng.normal(size=n) > 0.5).astype(float), np.ones(n)
    bins = codes.encode(boosting.binned(x, edges))
    cut_ = lambda s: (0, bins[:, s], y[s], w[s], np.zeros(n, np.int32)[s], None)
    rows = [boosting._Rows(cut_(s), None, rng.random(n)[s] < 0.9, np.zeros(n)[s], settings) for s in (slice(0, 1000), slice(1000, n))]
    summed, real, before, tree = [], boosting._Rows.sums, {}, boosting.Tree.empty(settings.depth)
    monkeypatch.setattr(boosting._Rows, "sums", lambda self, nodes, *a: summed.append(int(np.isin(self.node, nodes).sum())) or real(self, nodes, *a))
    bytes_, levels, some = list(range(len(codes.cells))), 0, 0

    def splits(ask):
        nonlocal levels, some
        summed.clear()
        sums = boosting._halved(rows, tree, ask[0], bytes_, codes, before)
        levels, some = levels + 1, some + sum(summed)
        if levels > 1:
            assert 2 * sum(summed) <= sum(int(np.isin(r.node, ask[0]).sum()) for r in rows)
        for k, whole in enumerate(zip(*(real(r, ask[0], bytes_, codes) for r in rows))):
            assert (sums[k] == sum(whole)).all()
        return [s for byte, both in zip(bytes_, sums) for s in boosting._splits((0, byte), both, [0, 1, 2], codes, settings)]

    boosting._levels({0: tree}, edges, settings, splits)
    assert levels == settings.depth
    ends = np.concatenate([r.ends(tree, b, codes) for r, b in zip(rows, (bins[:, :1000], bins[:, 1000:]))])
    assert (ends == tree.coded(bins, codes)).all()


@pytest.mark.parametrize("name, trees", [("gbt_predict", 600), ("classifier_predict", 400), ("feature_importance", 600), ("leave_one_out", 600)])
def test_trees(spark, monkeypatch, name, trees):
    def asked(prepared, columns, y, settings, *a, **k):
        raise Asked(settings.trees)

    monkeypatch.setattr(boosting, "train", asked)
    monkeypatch.setattr(queries, "_corrected", lambda spark, d, v=2: spark.createDataFrame([("v", True, 5.0, 4.0, "a"), ("v", True, 3.0, 9.0, "b")], "volunteer string, matched boolean, deviation_m double, corrected_deviation_m double, glh_layer string"))
    with pytest.raises(Asked, match=f"^{trees}$"):
        queries.QUERIES[name](spark, "unused")
