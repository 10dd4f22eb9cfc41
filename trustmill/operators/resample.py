"""Cluster bootstrap with paired draws: resamples are integer weights of clusters, never copies of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.functions.hashing import hash32
from trustmill.functions.storage import saved
from trustmill.operators.metrics import delta_to, method_scores, ranking_metrics
from trustmill.operators.prefix import numbered


def draws(clusters: DataFrame, cluster: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, cluster, weight): G draws with replacement from G clusters, for each resample; by hashes, so that any
    engine draws the same. Shared by all methods, which makes their differences paired."""
    index = numbered(clusters.select(cluster).distinct(), [cluster], "_i", start=0)
    g = index.count()
    if not g:
        return index.select(F.lit(0).alias("resample"), cluster, F.lit(0).cast("long").alias("weight")).limit(0)
    spark = clusters.sparkSession
    ids = spark.range(resamples * g).select(F.floor(F.col("id") / g).cast("int").alias("resample"), (F.col("id") % g).alias("_d"))
    picked = ids.select("resample", (hash32(F.lit(seed), F.col("resample"), F.col("_d")) % g).alias("_i"))
    return picked.groupBy("resample", "_i").agg(F.count("*").alias("weight")).join(index, "_i").select("resample", cluster, "weight")


def replicates(df: DataFrame, weights: DataFrame, by: list[str], cluster: str, error: str = "error", score: str = "score") -> DataFrame:
    """(by, resample, n, errors, aurc, auroc, auprc) of every resample."""
    small = df.groupBy(*by, cluster, F.col(score).alias("score"), F.col(error).alias("error")).agg(F.count("*").alias("_rows"))
    weighted = small.join(F.broadcast(weights) if weights.count() < 200_000 else weights, cluster).withColumn("weight", F.col("weight") * F.col("_rows"))
    return ranking_metrics(weighted, [*by, "resample"], weight="weight")


def replicates_of(df: DataFrame, weights: DataFrame, by: list[str], cluster: str, statistic: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """The values of any statistic in every resample: statistic(rows, keys, weight) aggregates rows, each counting
    `weight` times, over keys (by and resample)."""
    return statistic(df.join(weights, cluster), [*by, "resample"], "weight")


def intervals(reps: DataFrame, by: list[str], columns: list[str], level: float = 95) -> DataFrame:
    """(by, <c>_low, <c>_high): linear-interpolation percentiles over the resamples where c is defined."""
    tail = (1 - level / 100) / 2
    out = [F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for c in columns for side, q in (("low", tail), ("high", 1 - tail))]
    return reps.groupBy(*by).agg(*out)


def paired_difference(reps: DataFrame, by: list[str], reference: str, column: str = "aurc", method: str = "method") -> DataFrame:
    """reps plus delta_<column> to the reference method in the same resample."""
    ref = reps.where(F.col(method) == reference).select(*by, "resample", F.col(column).alias("_ref"))
    return reps.join(ref, [*by, "resample"]).withColumn(f"delta_{column}", F.col(column) - F.col("_ref")).drop("_ref")


def joint_mean(reps: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Averages over what is not kept (seeds) inside each resample: percentiles come after."""
    return reps.groupBy(*keep, "resample").agg(*[F.avg(c).alias(c) for c in columns])


def one_per_cluster(df: DataFrame, cluster: str, order: list[str]) -> DataFrame:
    """The first row of each cluster."""
    first = F.min(F.struct(*order, *[c for c in df.columns if c not in order]))
    return df.groupBy(cluster).agg(first.alias("_f")).select(*[F.col(f"_f.{c}").alias(c) if c != cluster else F.col(cluster) for c in df.columns])


def cluster_sensitivity(df: DataFrame, by: list[str], cluster: str, order: list[str], methods: dict[str, str], reference: str, weights: DataFrame, error: str = "error") -> DataFrame:
    """(by, method, n, aurc, delta_aurc, delta_aurc_low, delta_aurc_high): methods (name -> score column) compared on the first
    row of each cluster alone, with intervals of the difference to the reference over resamples of the clusters."""
    first = saved(one_per_cluster(df, cluster, order))
    scored = method_scores(first, [*by, cluster, error], methods)
    whole = delta_to(ranking_metrics(scored, [*by, "method"], error), by, "aurc", reference).select(*by, "method", "n", "aurc", "delta_aurc")
    reps = paired_difference(replicates(scored, weights, [*by, "method"], cluster, error), by, reference)
    return whole.join(intervals(reps, [*by, "method"], ["delta_aurc"]), [*by, "method"])
