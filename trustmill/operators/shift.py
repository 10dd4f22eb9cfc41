"""Feature shift between a source and a target: standardised distances, nearest neighbours, principal components."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.operators.metrics import ranking_metrics
from trustmill.operators.quantiles import exact_quantiles


def column_stats(df: DataFrame, features: str, floor: float = 1e-6) -> DataFrame:
    """(dim, mean, std): population standard deviation, 1 where it is below the floor."""
    long = df.select(F.posexplode(features).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    out = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < floor, 1.0).otherwise(F.col("std")))


def standardised(df: DataFrame, stats: DataFrame, features: str, out: str = "z") -> DataFrame:
    """df plus z-scored features; stats has one row per dimension."""
    table = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    z = F.zip_with(features, "_s", lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return df.crossJoin(F.broadcast(table)).withColumn(out, z).drop("_s")  # one row


def centre_distance(z: str) -> Column:
    """|z| / sqrt(dimensions)."""
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x) / F.size(z))


def shifted_share(target: DataFrame, z: str = "z") -> DataFrame:
    """Share of dimensions whose target mean is more than one source deviation away."""
    means = target.select(F.posexplode(z).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    return means.agg(F.avg((F.abs("m") > 1).cast("double")).alias("shifted_share"))


#: Pivots, rows of either side that meet in a task, and rows of them that are compared at once.
PIVOTS, BLOCK, TILE = 256, 50_000, 2000


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def nearest_distance(a: DataFrame, b: DataFrame, key: str, z: str = "z", exclude_self: bool = False, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, nearest): smallest Euclidean distance of each row of a to the rows of b, exactly; with exclude_self, to those
    of other keys. Rows without a key or vector are left out; without a row to compare with there is no result. Rows of a
    that share a key share the smallest of their distances.

    Rows of b near to one of a few pivots, themselves rows of b, form a cell. Each row of a first meets the cell of its own
    pivot, which gives a bound. By the triangle inequality, from its distances to the pivots and the cells' radii, it then
    needs other cells only where something closer may be. Both sides are dealt into blocks by cell, large ones into several;
    a row of a is sent once to each block with a cell that it needs, and compared with these cells. How much that prunes is
    up to the data; at worst all blocks meet, and every row is sent once a block of the other side.
    """
    spark = a.sparkSession
    rows = lambda df: df.select(F.col(key).alias("k"), F.col(z).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    left, right = rows(a), rows(b)
    kind = left.schema["k"].dataType.simpleString()
    drawn = right.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    if not drawn:
        return left.select(F.col("k").alias(key), F.lit(None).cast("double").alias("nearest")).limit(0)
    centres = np.array([r["v"] for r in drawn])
    held = spark.sparkContext.broadcast(centres)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _apart(np.stack(pdf["v"].to_numpy()), held.value)
                yield pdf.assign(cell=d.argmin(1), r=d.min(1))

    celled = lambda df: saved(df.mapInPandas(to_cells, f"k {kind}, v array<double>, cell int, r double").withColumn("_n", F.monotonically_increasing_id()))
    left, right = celled(left), celled(right)

    def blocks(df: DataFrame) -> tuple[np.ndarray, ...]:
        """(rows, rows in cells before, first block, last block, radius) of each cell; a cell without rows has no blocks."""
        n, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
        for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).collect():  # one row a pivot
            n[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
        before = np.cumsum(n) - n
        return n, before, before // block, np.where(n > 0, (before + n - 1) // block, -1), radius

    a_cells, b_cells = blocks(left), blocks(right)
    of_cell = lambda numbers: F.element_at(F.from_json(F.lit(json.dumps(numbers.tolist())), "array<bigint>"), F.col("cell") + 1)
    place = lambda cells: F.floor((of_cell(cells[1]) + F.pmod(F.xxhash64("_n"), of_cell(cells[0]))) / block).cast("int")
    left, right = left.withColumn("x", place(a_cells)).select("k", "v", "cell", "x"), right.withColumn("y", place(b_cells)).select("k", "v", "cell", "y")
    with_cell = lambda df, cells, to: df.where(of_cell(cells[0]) > 0).withColumn(to, F.explode(F.sequence(of_cell(cells[2]).cast("int"), of_cell(cells[3]).cast("int"))))

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        best = np.full(p.num_rows, np.inf)
        if p.num_rows and q.num_rows:
            x, y = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (p, q))
            own, other, cell = p.column("k").to_pandas().to_numpy(), q.column("k").to_pandas().to_numpy(), np.asarray(q.column("cell"))
            wanted = np.unpackbits(np.array([np.frombuffer(c, np.uint8) for c in p.column("cells").to_pylist()]), axis=1)
            for c in np.unique(cell):
                mine, there = np.flatnonzero(wanted[:, c]), np.flatnonzero(cell == c)
                for i, j in ((mine[s : s + TILE], there[t : t + TILE]) for s in range(0, len(mine), TILE) for t in range(0, len(there), TILE)):
                    some, near = x[i], y[j]
                    d = some @ near.T
                    d *= -2
                    d += (near * near).sum(1)
                    if exclude_self:
                        d[own[i][:, None] == other[j][None, :]] = np.inf
                    at = d.argmin(1)
                    # the product loses digits where rows are close; the nearest one is measured again
                    again = np.where(np.isinf(d[np.arange(len(i)), at]), np.inf, np.sqrt(((some - near[at]) ** 2).sum(1)))
                    best[i] = np.minimum(best[i], again)
        found = np.flatnonzero(np.isfinite(best))
        return pa.table({"k": p.column("k").take(pa.array(found)), "d": best[found]})

    def met(p: DataFrame, q: DataFrame) -> DataFrame:
        """(k, d) of rows (k, v, cells, x, y) with the rows (k, v, cell, x, y) of b sent to the same place."""
        return p.groupBy("x", "y").cogroup(q.groupBy("x", "y")).applyInArrow(lambda t, u: meet(t, u), f"k {kind}, d double")

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            one = np.arange(len(centres))[None, :] == pdf["cell"].to_numpy()[:, None]
            yield pdf.assign(cells=[m.tobytes() for m in np.packbits(one, axis=1)])[["k", "v", "cells", "x", "y"]]

    sent = f"k {kind}, v array<double>, cells binary, x int, y int"
    found = saved(met(with_cell(left, b_cells, "y").mapInPandas(masked, sent), with_cell(right, a_cells, "x")).groupBy("k").agg(F.min("d").alias("bound")))
    radius, many = b_cells[4], int(b_cells[3].max()) + 1
    holds = (b_cells[2][None, :] <= np.arange(many)[:, None]) & (np.arange(many)[:, None] <= b_cells[3][None, :])
    between, most = _apart(centres, centres), float(np.sqrt((centres * centres).sum(1)).max())

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            bound, cell = pdf["bound"].fillna(np.inf).to_numpy(), pdf["cell"].to_numpy()
            x = np.stack(pdf["v"].to_numpy())
            d, scale = _apart(x, held.value), np.sqrt((x * x).sum(1)) + most
            at = d[np.arange(len(d)), cell]
            # a row of cell j is at least this far: by the cell's radius, and by the plane between the pivots
            far = d - radius[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[cell] > 1e-4 * scale[:, None], (d * d - (at * at)[:, None]) / (2 * between[cell]), -np.inf)
            need = (np.maximum(far, plane) <= (bound + 1e-7 * scale)[:, None]) & (radius >= 0)[None, :]
            need[np.arange(len(d)), cell] = False
            cells = np.array([m.tobytes() for m in np.packbits(need, axis=1)], object)
            for y in range(many):
                to = np.flatnonzero((need & holds[y]).any(1))
                if len(to):
                    yield pd.DataFrame({"k": pdf["k"].to_numpy()[to], "v": pdf["v"].to_numpy()[to], "cells": cells[to], "x": pdf["x"].to_numpy()[to], "y": np.int32(y)})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in needed(batches):
            yield pdf[["x", "y"]].drop_duplicates()

    bounded = saved(left.join(found.withColumnRenamed("k", "_k"), F.col("k") == F.col("_k"), "left").select("k", "v", "x", "cell", "bound"))
    pairs = saved(bounded.mapInPandas(places, "x int, y int").distinct())
    more = met(bounded.mapInPandas(needed, sent), right.join(pairs, "y").select("k", "v", "cell", "x", "y"))
    out = found.select("k", F.col("bound").alias("d")).union(more)
    return out.groupBy("k").agg(F.min("d").alias("nearest")).withColumnRenamed("k", key)


def shift_summary(scored: DataFrame, domain: str, distance: str, source: str = "source") -> DataFrame:
    """One row: median, p5 and p95 of a distance in both domains, the target's share beyond the source's p95, and the
    AUROC of the distance as a detector of the target."""
    src = F.col(domain) == source
    rows = saved(scored.select(F.when(src, "source").otherwise("target").alias("side"), F.col(distance).alias("score")))
    q = exact_quantiles(rows, ["side"], "score", [0.05, 0.5, 0.95])
    pick = lambda side, p: F.max(F.when((F.col("side") == side) & (F.col("share") == p), F.col("quantile"))).alias(f"{side}_p{int(p * 100)}")
    stats = saved(q.agg(*[pick(side, p) for side in ("source", "target") for p in (0.05, 0.5, 0.95)]))
    beyond = rows.crossJoin(F.broadcast(stats)).where("side = 'target'").agg(F.avg((F.col("score") > F.col("source_p95")).cast("double")).alias("beyond_p95"))
    auroc = ranking_metrics(rows.select((F.col("side") == "target").cast("int").alias("error"), "score"), []).select("auroc")
    return stats.crossJoin(beyond).crossJoin(auroc)  # one row each


MOMENTS = "n long, s binary, ss binary"


def principal_components(df: DataFrame, key: list[str], features: str, source_only, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, pc1.., pck) of all rows on the components of the centred source rows, and the explained shares.

    Every partition adds up its sums of outer products, 64 tasks add up those of the partitions, and the driver gets at
    most 64 matrices of dims x dims. Signs are fixed so that the largest loading of a component is positive.
    """
    src = df.where(source_only)
    if (first := src.select(F.size(features)).first()) is None:
        raise ValueError("no source rows to find components of")
    dims = first[0]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[features].to_numpy()).astype(float)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "ss": [ss.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(dims), np.zeros(dims * dims)
        for pdf in batches:
            n += int(pdf["n"].sum())
            s = sum(map(np.frombuffer, pdf["s"]), s)
            ss = sum(map(np.frombuffer, pdf["ss"]), ss)
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "ss": [ss.tobytes()]})

    sums = src.select(features).mapInPandas(moments, MOMENTS).withColumn("_p", F.spark_partition_id())
    parts = sums.repartition(64, "_p").drop("_p").mapInPandas(added, MOMENTS).collect()
    n = sum(p["n"] for p in parts)
    mean = sum(np.frombuffer(p["s"]) for p in parts) / n
    cov = sum(np.frombuffer(p["ss"]).reshape(dims, dims) for p in parts) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    shares = (values[::-1][:k] / values.sum()).tolist()
    dot = lambda w: F.aggregate(F.zip_with(features, F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(x)).alias("w")) for m, x in zip(mean, w, strict=True)]), lambda x, c: (x.cast("double") - c["m"]) * c["w"]), F.lit(0.0), lambda a, x: a + x)
    return df.select(*key, *[dot(top[:, i]).alias(f"pc{i + 1}") for i in range(k)]), shares
