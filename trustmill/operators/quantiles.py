"""Exact quantiles of any number of values, by order statistics from narrowing histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved

BINS = 1024
#: A pass leaves a target with the values of one bin; more passes than this mean a defect.
MAX_PASSES = 80


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, share, quantile), linear between neighbours as numpy's default. Nulls and NaN don't count; infinite values are
    not allowed; groups without values are left out.

    For each wanted place in the order, values between two bounds are counted in BINS bins; the bin that holds the place
    gives the next bounds, its own least and largest value, until these are equal. No task or row ever holds a column.
    """
    keys = by or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(1))).select(*keys, F.col(value).cast("double").alias("v"))
    rows = saved(rows.where("v IS NOT NULL AND NOT isnan(v)"))
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if not first.where("lo = double('-Infinity') OR hi = double('Infinity')").isEmpty():
        raise ValueError(f"{value} has infinite values")
    at = (F.col("n") - 1) * F.col("share")
    wanted = first.select("*", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share"))
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    targets = saved(wanted.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")).distinct())
    done = []
    for _ in range(MAX_PASSES):
        done.append(targets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        targets = targets.where("lo < hi")
        if targets.isEmpty():
            break
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        met = rows.join(targets, keys).where("v >= lo AND v <= hi")
        bins = met.groupBy(*keys, "rank", "below", bin_of.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up = Window.partitionBy(*keys, "rank").orderBy("bin")  # BINS rows at most
        bins = bins.withColumn("to", F.col("below") + F.sum("m").over(up))
        held = bins.where("rank < to AND rank >= to - m")
        targets = saved(held.select(*keys, "rank", "lo", "hi", (F.col("to") - F.col("m")).alias("below")))
    else:
        raise RuntimeError(f"quantiles did not settle in {MAX_PASSES} passes")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = saved(found.distinct())
    out = wanted.select(*keys, "share", F.floor(at).alias("_low"), F.ceil(at).alias("_high"), (at - F.floor(at)).alias("_part"))
    for side in ("low", "high"):
        own = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rank"), F.col("v").alias(f"_v{side}"))
        same = F.col(f"_{side}") == F.col("rank")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(own, same).drop("rank", *[f"_{k}" for k in keys])
    return out.select(*by, "share", (F.col("_vlow") + (F.col("_vhigh") - F.col("_vlow")) * F.col("_part")).alias("quantile"))
