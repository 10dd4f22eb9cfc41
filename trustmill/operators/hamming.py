"""Pairs of 64-bit hashes within any Hamming distance, by multi-index hashing or block by block.

The bits are cut into bands. Two hashes within the distance are close in at least one band, by a radius that follows
from the number of bands. So each band value that occurs is joined with those that occur in its ball, the values that
differ from it in at most so many bits; hashes meet in equi-joins on band values, and are then compared in full. Few wide
bands enumerate large balls and find few candidates, many narrow ones the other way round: the number of bands is the
one with the least rows in all, estimated for the hashes at hand.

At distances where bands select little, and among few hashes, even that number makes more rows than a comparison of all
pairs costs. Rows are then dealt into blocks, and each two blocks meet in a task that compares them bit by bit: what is
shuffled is every row once a block, and not every candidate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trustmill.functions.storage import saved

BITS = 64
#: The largest ball that is enumerated, and the values of all bands up to which they are sent to every task.
LARGEST_BALL, BROADCAST_VALUES = 20_000, 1 << 20
#: Rows of a block, blocks at least, and pairs of rows in blocks that are compared in the time of one row of a join.
BLOCK, LEAST_BLOCKS, PAIRS_A_ROW = 50_000, 6, 200
#: Hashes of either block that are compared at once, and pairs that a task holds before it passes them on.
TILE, PORTION = (8, 16_384), 200_000


@dataclass(frozen=True)
class Band:
    """Bits start to start + width - 1 of a hash, and the distance in them that one of the bands must keep."""

    start: int
    width: int
    radius: int

    def ball(self) -> int:
        return sum(comb(self.width, i) for i in range(self.radius + 1))

    def masks(self) -> list[int]:
        return [sum(1 << i for i in some) for k in range(self.radius + 1) for some in combinations(range(self.width), k)]


def bands(distance: int, many: int) -> list[Band]:
    """Bands such that any two hashes within the distance are within the radius of at least one: were all beyond, the
    distances of the bands, at least radius + 1 each, would add up to more than distance. Bands of no use are left out."""
    cuts = [BITS * i // many for i in range(many + 1)]
    each, more = divmod(distance + 1, many)
    return [Band(cuts[i], cuts[i + 1] - cuts[i], each - 1 + (i < more)) for i in range(many) if each - 1 + (i < more) >= 0]


def rows_made(plan: list[Band], n: int) -> float:
    """Ball keys and candidate pairs that a plan makes of n hashes, as if these were random."""
    return sum(min(n, 2**b.width) * b.ball() + n * n / 2 * b.ball() / 2**b.width for b in plan)


def best_bands(distance: int, n: int) -> list[Band]:
    """The plan with the fewest rows. Bands have at most 32 bits, so a value fits a long wherever it lies."""
    plans = [bands(distance, many) for many in range(2, min(distance + 1, 32) + 2)]
    fit = [p for p in plans if all(b.ball() <= LARGEST_BALL for b in p)]
    return min(fit, key=lambda p: rows_made(p, n))


def value(high: Column, low: Column, band: Band) -> Column:
    """The bits of a band; bits 0 to 31 of a hash are high's, the others low's (each half's least bit first)."""
    parts, at = [], 0
    for start, half in ((0, high), (32, low)):
        first, last = max(band.start, start), min(band.start + band.width, start + 32)
        if first < last:
            bits = F.shiftright(half, first - start).bitwiseAND(F.lit((1 << (last - first)) - 1).cast("long"))
            parts.append(F.shiftleft(bits, at) if at else bits)
            at += last - first
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def distance_of(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def in_blocks(distance: int, n: int) -> bool:
    """Whether n rows are compared block by block, since the best bands would cost more."""
    return rows_made(best_bands(distance, n), n) * PAIRS_A_ROW >= n * n / 2


def _close(codes: np.ndarray, first: np.ndarray, second: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance of codes[i] and codes[j]) of the close pairs of two lists of places, about PORTION at a time; of a
    list and itself (first is second) each pair once."""
    found, many = [], 0
    x, y, (high, wide) = codes[first], codes[second], TILE
    room = [np.empty(high * wide, kind) for kind in (np.uint64, np.uint8, bool)]
    for s in range(0, len(x), high):
        for t in range(s if first is second else 0, len(y), wide):
            shape = len(x[s : s + high]), len(y[t : t + wide])
            bits, apart, near = (b[: shape[0] * shape[1]].reshape(shape) for b in room)
            np.bitwise_xor(x[s : s + high, None], y[None, t : t + wide], out=bits)
            at = np.flatnonzero(np.less_equal(np.bitwise_count(bits, out=apart), distance, out=near))
            if len(at):
                i, j = np.divmod(at, apart.shape[1])
                i, j, d = i + s, j + t, apart.ravel()[at]
                if first is second:
                    once = i < j
                    i, j, d = i[once], j[once], d[once]
                found.append((first[i], second[j], d.astype(np.int32)))
                many += len(i)
                if many >= PORTION:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, many = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found, strict=True)))


def _met(rows: DataFrame, n: int, distance: int, out: Callable, schema: StructType) -> DataFrame:
    """out(rows of two blocks, their close pairs) of each two blocks and each block with itself."""
    many = max(LEAST_BLOCKS, -(-n // BLOCK))
    dealt = rows.where("h IS NOT NULL AND l IS NOT NULL").withColumn("_i", F.pmod(F.xxhash64(*rows.columns), F.lit(many)).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        codes, own = (column("h").astype(np.uint64) << np.uint64(32)) | column("l").astype(np.uint64), column("_i")
        first, second = np.flatnonzero(own == column("_x")[0]), np.flatnonzero(own == column("_y")[0])
        yield from out(table, _close(codes, first, first if column("_x")[0] == column("_y")[0] else second, distance))

    return dealt.withColumns({"_x": F.least("_i", "_j"), "_y": F.greatest("_i", "_j")}).groupBy("_x", "_y").applyInArrow(run, schema)


def block_pairs(rows: DataFrame, distance: int, n: int) -> DataFrame:
    """(c_a and c_b for each column c but h and l, distance): every two of n rows (h, l, ...) within the distance, once, the
    ends in any order. Equal hashes are pairs too."""
    kept = [f for f in rows.schema if f.name not in ("h", "l")]
    schema = StructType([StructField(f"{f.name}_{side}", f.dataType) for side in "ab" for f in kept] + [StructField("distance", IntegerType())])

    def out(table: pa.Table, found: Iterator) -> Iterator[pa.RecordBatch]:
        table = table.select([f.name for f in kept])
        for i, j, d in found:
            ends = [c.combine_chunks() for places in (i, j) for c in table.take(pa.array(places)).columns]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(d)], schema.names)

    return _met(rows, n, distance, out, schema)


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place of each place's set, once the sets of i and j are joined."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def block_links(rows: DataFrame, distance: int, n: int) -> DataFrame:
    """(v_a, v_b): fewer pairs than block_pairs of n rows (v, h, l) that join the same rows: of each two blocks, the smallest
    row of a set that they join with every other of it."""
    kind = rows.schema["v"].dataType

    def out(table: pa.Table, found: Iterator) -> Iterator[pa.RecordBatch]:
        root = np.arange(table.num_rows)
        for i, j, _ in found:
            root = _merged(root, i, j)
        low = np.flatnonzero(root != np.arange(len(root)))
        ends = [table.column("v").take(pa.array(places)).combine_chunks() for places in (root[low], low)]
        yield pa.RecordBatch.from_arrays(ends, ["v_a", "v_b"])

    return _met(rows, n, distance, out, StructType([StructField("v_a", kind), StructField("v_b", kind)]))


def close_pairs(hashes: DataFrame, distance: int, plan: list[Band] | None = None) -> DataFrame:
    """(va, vb, distance), va < vb, each pair once, from distinct hashes (v, h, l): v of any ordered type, h and l the
    halves as longs. A band value that very many hashes share is a key of a join over saved rows, which can be split. With
    a plan bands are taken in any case."""
    if plan is None:
        n = hashes.count()
        if in_blocks(distance, n):
            return block_pairs(hashes.select("v", "h", "l"), distance, n).select(F.least("v_a", "v_b").alias("va"), F.greatest("v_a", "v_b").alias("vb"), "distance")
        plan = best_bands(distance, n)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), value(F.col("h"), F.col("l"), b).alias("x")) for i, b in enumerate(plan)])
    banded = saved(hashes.select("v", "h", "l", F.inline(keys)))
    values = saved(banded.select("i", "x").distinct())
    balls = []
    for i, band in enumerate(plan):
        masks = F.from_json(F.lit(json.dumps(band.masks())), "array<bigint>")
        balls.append(values.where(F.col("i") == i).select("i", "x", F.explode(masks).alias("_m")).select("i", "x", F.col("x").bitwiseXOR(F.col("_m")).alias("y")))
    there = values.select("i", F.col("x").alias("y"))
    if sum(2**b.width for b in plan) <= BROADCAST_VALUES:
        there = F.broadcast(there)
    near = saved(reduce(DataFrame.union, balls).join(there, ["i", "y"], "left_semi"))
    a = banded.select(F.col("v").alias("va"), F.col("h").alias("ha"), F.col("l").alias("la"), "i", "x")
    b = banded.select(F.col("v").alias("vb"), F.col("h").alias("hb"), F.col("l").alias("lb"), "i", F.col("x").alias("y"))
    apart = distance_of(F.col("ha"), F.col("la"), F.col("hb"), F.col("lb"))
    met = a.join(near, ["i", "x"]).join(b, ["i", "y"]).where((F.col("va") < F.col("vb")) & (apart <= distance))
    # of several bands that bring a pair together the first counts
    inside = lambda k: F.bit_count(value(F.col("ha"), F.col("la"), plan[k]).bitwiseXOR(value(F.col("hb"), F.col("lb"), plan[k]))) <= plan[k].radius
    first = reduce(lambda rest, k: F.when(inside(k), k).otherwise(rest), reversed(range(len(plan))), F.lit(-1))
    return met.where(F.col("i") == first).select("va", "vb", apart.cast("int").alias("distance"))
