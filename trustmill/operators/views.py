"""View expansion: one row becomes an original and seeded variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.functions.hashing import stable_seed, uniform, view_id

#: kind -> (column, low, high) of its parameter.
VIEWS = {
    "brightness": ("brightness_factor", 0.7, 1.3),
    "contrast": ("contrast_factor", 0.7, 1.3),
    "blur": ("blur_sigma", 0.3, 1.5),
    "noise": ("noise_sigma", 0.01, 0.08),
}


def create_views(df: DataFrame, path: str, replicates: int = 3, root_seed: int = 42, views: dict = VIEWS) -> DataFrame:
    """df times 1 + len(views) * replicates rows, with view_id, view_type, replicate_index, rng_seed (null for the
    original) and one parameter column per view, uniform by hash between its bounds and null elsewhere."""
    kinds = [("original", 0), *[(v, r) for v in views for r in range(replicates)]]
    out = df.select("*", F.inline(F.array(*[F.struct(F.lit(v).alias("view_type"), F.lit(r).alias("replicate_index")) for v, r in kinds])))
    p, v, r = F.col(path), F.col("view_type"), F.col("replicate_index")
    made = v != "original"
    out = out.withColumns({"view_id": view_id(p, v, r), "rng_seed": F.when(made, stable_seed(F.lit(root_seed), p, v, r))})
    return out.withColumns({c: F.when(v == kind, F.lit(lo) + uniform(F.lit(root_seed), p, v, r) * F.lit(hi - lo)) for kind, (c, lo, hi) in views.items()})


def view_violations(views: DataFrame, path: str, expected: int, split: str | None = None) -> DataFrame:
    """One row: originals with a wrong number or order of views, repeated view ids, originals over several splits."""
    per = views.groupBy(path).agg(F.count("*").alias("n"), F.countDistinct("view_type", "replicate_index").alias("kinds"), *([F.countDistinct(split).alias("splits")] if split else [F.lit(1).alias("splits")]))
    ids = views.groupBy("view_id").count().where("count > 1").agg(F.count("*").alias("repeated_ids"))
    bad = per.agg(F.count_if((F.col("n") != expected) | (F.col("kinds") != expected)).alias("wrong_sets"), F.count_if(F.col("splits") > 1).alias("crossing_splits"))
    return bad.crossJoin(ids)  # one row each
