"""Exact percentiles of groups of any size, by refining histograms.

No group is gathered anywhere. The range of each wanted rank is cut into ``BUCKETS`` equal buckets; one aggregate, combined on
the map side, counts them and finds the least and the most value in each; the bucket that holds the rank, between its own least and
most value, is the next range. A range of one value is the answer, so a value that fills a bucket ends it, and empty stretches and outliers
cost nothing. A round always parts the least value from the most; a billion even values take three.

Values are written once, narrow; rounds read them and shuffle ``BUCKETS`` rows for each task and open range at most. The driver sees
whether a range is open, no values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import no_nan
from driftline.tables import cut

BUCKETS = 4096


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """The bucket of a value between lo and hi: halves, so that a wide range does not overflow; lo is always in the first and hi in the last."""
    width = hi / 2 - lo / 2
    inner = F.when((width > 0) & (width < F.lit(float("inf"))), F.floor((v / 2 - lo / 2) / width * buckets)).otherwise(F.lit(buckets // 2))
    return F.when(v == lo, 0).when(v == hi, buckets - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), inner))).cast("int")


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], buckets: int = BUCKETS) -> DataFrame:
    """``by`` and a column for each of ``wanted``: name -> (value, share). Values between two ranks are linear in the share.

    Null is a group; null and NaN values are none; a group without values has null; infinite values rank as they are. Groups without any value at all are left out.
    """
    names = list(wanted)
    values = {str(v): v for v, _ in wanted.values()}  # each different value once
    what = {text: i for i, text in enumerate(values)}
    keys = [f"_k{i}" for i in range(len(by))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("what"), no_nan(v.cast("double")).alias("v")) for i, v in enumerate(values.values())]))
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], each.alias("x")).select(*keys, "x.what", "x.v").where("v is not null")
    rows = cut(rows, "values")
    keys = [*keys, "what"]

    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(what[str(v)]).alias("of"), F.lit(float(p)).alias("share")) for i, (v, p) in enumerate(wanted.values())])
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = whole.withColumn("p", F.explode(places)).where("p.of = what").withColumn("at", (F.col("n") - 1) * F.col("p.share"))
    asked = cut(asked.select(*keys, F.col("p.i").alias("i"), "at", "lo", "hi"), "asked")
    ranks = asked.select(*keys, F.explode(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))).alias("rank"), "lo", "hi")
    ranges = ranks.distinct().withColumn("below", F.lit(0).cast("long"))
    done: list[DataFrame] = []
    while True:
        ranges = cut(ranges, "ranges")
        done.append(ranges.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        ranges = ranges.where("lo < hi")
        if ranges.isEmpty():
            break
        ranges = _narrow(rows, ranges, keys, buckets)
    found = reduce(DataFrame.unionByName, done)

    rk = [f"_r{i}" for i in range(len(keys))]
    at = lambda name: found.select(*[F.col(k).alias(r) for k, r in zip(keys, rk, strict=True)], F.col("rank").alias("_rank"), F.col("v").alias(name))
    low, high = at("low"), at("high")
    both = asked.join(low, _same(keys, rk) & (F.floor("at").cast("long") == F.col("_rank"))).drop(*rk, "_rank")
    both = both.join(high, _same(keys, rk) & (F.ceil("at").cast("long") == F.col("_rank"))).drop(*rk, "_rank")
    share = F.col("at") - F.floor("at")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share)
    out = both.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)])
    return out.withColumnsRenamed(dict(zip(keys, by)))


def with_groups(summary: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """A table of groups with the percentiles of the same groups; null is a group."""
    own = [f"_g{i}" for i in range(len(by))]
    return summary.join(found.withColumnsRenamed(dict(zip(by, own))), _same(by, own), "left").drop(*own)


def _narrow(rows: DataFrame, ranges: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The ranges after one round: for each rank, the least and the most value of the bucket that holds it."""
    own = [f"_o{k}" for k in keys]
    open_ = ranges.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "lo", "hi", "below").distinct()
    inside = rows.join(open_, _same(keys, own) & F.col("v").between(F.col("lo"), F.col("hi")))
    counted = inside.groupBy(*own, "lo", "hi", "below", _bucket(F.col("v"), F.col("lo"), F.col("hi"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    line = Window.partitionBy(*own, "lo").orderBy("bucket")
    counted = counted.withColumn("to", F.col("below") + F.sum("n").over(line)).withColumn("from", F.col("to") - F.col("n"))
    counted = counted.select(*own, F.col("lo").alias("_lo"), "from", "to", "least", "most")
    met = ranges.join(counted, _same(keys, own) & (F.col("lo") == F.col("_lo")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    return met.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("from").alias("below"))
