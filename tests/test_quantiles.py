"""Percentiles by ranks against NumPy, and what a large group costs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import quantiles

SHARES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def found(spark, groups, buckets):
    rows = [(g, float(v) if v is not None else None) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = quantiles.percentiles(df, ["g"], {f"p{int(100 * s)}": (F.col("v"), s) for s in SHARES}, buckets)
    return {r.g: [r[f"p{int(100 * s)}"] for s in SHARES] for r in out.collect()}


@pytest.mark.parametrize("buckets", [2, 7, quantiles.BUCKETS])
def test_against_numpy(spark, buckets):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.uniform(-5, 5, 501), "tied": rng.integers(0, 3, 400), "one": [7.25], "two": [1.0, 2.0], "same": [3.0] * 300,
        None: rng.normal(0, 1e-3, 200), "wide": [-1e308, -1.0, 0.0, 1e-300, 5.0, 1e308], "steps": 10.0 ** np.arange(-30, 31), "hot": [4.0] * 500 + list(rng.uniform(3, 5, 250)),
    }
    got = found(spark, {**groups, "gaps": [None, float("nan"), 1.0, None], "none": [None, float("nan")]}, buckets)
    assert set(got) == {*groups, "gaps"} and got["gaps"] == [1.0] * len(SHARES)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(np.array(values, dtype=float), SHARES).tolist() if g != "wide" else [-1e308, -0.75, 5e-301, (0.5 * 5.0 + 0.5 * 1e308), 0.05 * 5.0 + 0.95 * 1e308, 1e308], rel=1e-12), g


def test_infinite_values_rank(spark):
    got = found(spark, {"x": [-math.inf, 1.0, 2.0, 3.0, math.inf]}, 16)["x"]
    assert got[0] == -math.inf and got[1:3] == [1.0, 2.0] and got[-1] == math.inf


def test_large_group(spark, monkeypatch):
    """One group of 10**7 different values: the answer of Spark's own percentile, from shuffles of buckets only."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7_919_317) % n / 3.0).alias("v"))
    rounds = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    row = quantiles.percentiles(df, ["g"], {"a": (F.col("v"), 0.5), "b": (F.col("v"), 0.999)}).first()
    assert (row.a, row.b) == pytest.approx(((n - 1) * 0.5 / 3.0, (n - 1) * 0.999 / 3.0), rel=1e-12)
    assert len(rounds) <= 3
