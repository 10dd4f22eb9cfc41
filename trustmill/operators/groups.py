"""Groups of related items: links from digests and reviews, exclusions across domains, numbered components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.operators.components import connected_components
from trustmill.operators.prefix import code, numbered


def collect_links(manifest: DataFrame, reviews: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(links (a, b, reason), exclusions (path, reason)) from a manifest (path, dataset, sha256) and reviewed pairs
    (path_a, path_b, decision; 'unsure' counts as 'duplicate').

    Copies in the source are linked to their smallest path. A source file with a copy, or a reviewed duplicate, outside
    the source is excluded instead; a review's reason replaces a copy's. Pairs outside the source don't matter.
    """
    # saved, so that the join can split a digest that very many files hold
    by_sha = manifest.groupBy("sha256").agg(F.min(F.when(F.col("dataset") == source, F.col("path"))).alias("head"), F.max((F.col("dataset") != source).cast("int")).alias("outside"), F.count("*").alias("n"))
    by_sha = saved(by_sha.where("n > 1"))
    members = manifest.where(F.col("dataset") == source).join(by_sha, "sha256")
    copies = members.where("outside = 0 AND path <> head").select(F.col("head").alias("a"), F.col("path").alias("b"), F.lit("exact copy").alias("reason"))
    out_copy = members.where("outside = 1").select("path", F.lit("exact copy").alias("reason"), F.lit(1).alias("_rank"))
    side = lambda p: manifest.select(F.col("path").alias(p), F.col("dataset").alias(f"_{p}"))
    same = reviews.where(F.col("decision").isin("duplicate", "unsure")).join(side("path_a"), "path_a").join(side("path_b"), "path_b")
    reason = F.concat(F.lit("reviewed "), F.col("decision"))
    inner = same.where((F.col("_path_a") == source) & (F.col("_path_b") == source)).select(F.col("path_a").alias("a"), F.col("path_b").alias("b"), reason.alias("reason"))
    mixed = same.where((F.col("_path_a") == source) != (F.col("_path_b") == source))
    out_rev = mixed.select(F.when(F.col("_path_a") == source, F.col("path_a")).otherwise(F.col("path_b")).alias("path"), reason.alias("reason"), F.lit(2).alias("_rank"))
    out = out_copy.unionByName(out_rev).groupBy("path").agg(F.max(F.struct("_rank", "reason")).alias("x")).select("path", F.col("x.reason").alias("reason"))
    return copies.unionByName(inner), out


def link_counts(links: DataFrame, reasons: list[str]) -> DataFrame:
    """(reason, links): how many links each reason gave, zeros included."""
    axis = links.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, reasons))).alias("reason"))
    return axis.join(links.groupBy("reason").agg(F.count("*").alias("links")), "reason", "left").na.fill(0, ["links"])


def build_groups(pool: DataFrame, links: DataFrame, key: str = "path", letter: str = "g") -> DataFrame:
    """(key, group_id, size): components of the links with both ends in the pool, numbered by their smallest key;
    items without a link are groups of one."""
    ids = pool.select(key)
    inside = links.select("a", "b").join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")
    found = connected_components(inside, "a", "b", hubs=True)
    rooted = saved(ids.join(found, ids[key] == found["node"], "left").select(key, F.coalesce("component", key).alias("root")))
    roots = numbered(rooted.groupBy("root").agg(F.count("*").alias("size")), ["root"], "_number")
    return rooted.join(roots, "root").select(key, code(F.col("_number"), letter).alias("group_id"), "size")


def group_label(members: DataFrame, label: str) -> DataFrame:
    from trustmill.operators.audit import modal_value

    return modal_value(members, ["group_id"], label)
