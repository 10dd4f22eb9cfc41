"""Sharding: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every row belongs to a block (a pseudo-random bucket of rows). For blocks of known sizes, the matrix of how many rows
each block sends to each shard is drawn from the multivariate hypergeometric law, so it is distributed as under a
uniform permutation of all rows and its column sums are the exact shard sizes. Rows are permuted inside their block,
dealt to shards by their rank, exchanged, and permuted again inside the shard. Ranks are taken in blocks and in
pieces of shards, never over a whole shard, so no task grows with the input.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import literal_rows, table

N_SHARDS = 24
#: Rows of a block or a piece while these are few; beyond MAX_PARTS of them, blocks and pieces grow instead, because
#: the driver draws one matrix row per block.
PART_ROWS, MAX_PARTS = 8192, 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw of how many of `draws` items, taken without replacement, are good: inversion from the mode
    outwards, so that it takes about one standard deviation of steps at any population size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    log = math.lgamma
    p_mode = math.exp(
        log(good + 1) - log(mode + 1) - log(good - mode + 1)
        + log(bad + 1) - log(draws - mode + 1) - log(bad - draws + mode + 1)
        - log(good + bad + 1) + log(draws + 1) + log(good + bad - draws + 1)
    )
    u = rng.random() - p_mode
    left, right, p_left, p_right = mode, mode, p_mode, p_mode
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Row sums are block_sizes; column sums differ by one at most, and which shards get one more is drawn too."""
    rng, total = random.Random(seed), sum(block_sizes)
    left = [total // n_shards] * n_shards
    for s in rng.sample(range(n_shards), total % n_shards):
        left[s] += 1
    matrix = []
    for size in block_sizes:
        row, rest, todo = [], sum(left), size
        for room in left:
            x = hypergeometric(rng, room, rest - room, todo)
            row.append(x)
            rest -= room
            todo -= x
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def parts(rows: float, most: int = MAX_PARTS) -> int:
    return min(max(1, math.ceil(rows / PART_ROWS)), max(1, most))


def shuffle_to_shards(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = 0) -> DataFrame:
    """rows plus shard (0 to n_shards-1) and slot (gapless from 0 in each shard).

    Any columns and rows are taken, nulls and repeated rows included: a row is told apart by its place in the saved
    input. Columns named shard or slot are replaced; none may begin with an underscore. An empty input gives an empty
    result. Driver: one count per block, MAX_PARTS at most.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    # saved once: places, and with them all random keys, stay as they are when tasks are run again
    keyed = saved(keyed)
    n_blocks = parts(keyed.count())
    draw = lambda salt, *more: F.xxhash64(F.lit(seed), F.lit(salt), F.col("_row"), *more)
    keyed = keyed.withColumn("_block", F.pmod(draw("block"), F.lit(n_blocks)).cast("int"))
    sizes = {r["_block"]: r["count"] for r in keyed.groupBy("_block").count().collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in order], n_shards, seed)
    starts, offset = [], [0] * n_shards
    for b, row in zip(order, matrix, strict=True):
        ends, at = [], 0
        for x in row:
            ends.append(at := at + x)
        starts.append({"_block": b, "_ends": ends})
    dealt = F.broadcast(literal_rows(spark, json.dumps(starts), "_block int, _ends array<bigint>"))  # n_blocks rows
    local = Window.partitionBy("_block").orderBy(draw("first"), "_row")
    sent = keyed.withColumn("_rank", F.row_number().over(local)).join(dealt, "_block")
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    # the second permutation: pieces of a shard by leading bits of the sorting key, ranks inside a piece
    n_pieces = parts(sum(sizes.values()) / n_shards, MAX_PARTS // n_shards)
    sent = sent.withColumn("_key", draw("second"))
    sent = sent.withColumn("_piece", F.pmod(draw("piece"), F.lit(n_pieces)).cast("int"))
    if n_pieces == 1:
        slot = F.row_number().over(Window.partitionBy("shard").orderBy("_key", "_row")) - 1
        return sent.withColumn("slot", slot.cast("long")).drop("_row", "_block", "_ends", "_rank", "_key", "_piece")
    sent = saved(sent)
    pieces = sent.groupBy("shard", "_piece").count()  # n_shards x n_pieces rows
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("shard", "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", "_row")) - 1
    out = sent.withColumn("_inside", inside).join(F.broadcast(pieces), ["shard", "_piece"])
    return out.withColumn("slot", (F.col("_before") + F.col("_inside")).cast("long")).drop("_row", "_block", "_ends", "_rank", "_key", "_piece", "_inside", "_before")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order inside each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for each row of `documents`. A null text has no bytes; repeated rows and rows with null ids are placed
    each for itself; other columns are ignored; an empty table gives an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_to_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
