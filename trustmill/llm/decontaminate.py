"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the token positions of a short span and ignores the others, so a seed survives a substitution at
an ignored position. Seeds of all benchmark positions and masks are joined with those of all training positions. A hit
fixes an alignment of a document with an item; aligned tokens around it are then compared one by one, and a document
is contaminated by an item if, somewhere, 80 % of REACH aligned tokens (of the whole item, if shorter) agree.

A phrase that very many items share would align each document that holds it with all of them. At such seeds an item is
met only by the tokens around the seed that few items have there, or, for what all these items have in common, by
the signature of its common tokens, where that alone suffices (common_pairs).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import table

REACH, AGREE = 24, 0.8
#: (mask, least and most tokens of the items, at most REACH counting, that it serves). For every number of tokens, each
#: pattern of substitutions that AGREE allows leaves a seed of one of its masks intact; a test tries all patterns.
MASKS = [((0, 1, 2, 3, 4), 8, REACH), ((0, 1, 2, 4, 5), 8, REACH), ((0, 1, 3, 6, 7), 8, 14)]
MASKS += [((0, 1, 2, 3), 4, 7), ((0, 1, 3, 4), 5, 7), ((0, 2, 3, 4), 5, 5), ((0, 1, 2, 4), 5, 5)]
#: Items of so few tokens must agree in all of them.
WHOLE = 4
MASKS += [((0, 1, 2), 3, 3), ((0, 1), 2, 2), ((0,), 1, 1)]
#: Above this many distinct benchmark seeds, the join shuffles both sides instead of broadcasting the seeds.
BROADCAST_SEEDS = 1_000_000
#: A seed at more benchmark positions than this, as of a phrase that many items share, doesn't make pairs by itself.
COMMON = 100


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks_for(lengths: set[int]) -> list[tuple[tuple[int, ...], int, int]]:
    """The entries of MASKS that items of these numbers of tokens need."""
    return [(mask, lo, hi) for mask, lo, hi in MASKS if any(lo <= min(n, REACH) <= hi for n in lengths)]


def _seeds(df: DataFrame, masks: list[tuple[tuple[int, ...], int, int]]) -> DataFrame:
    """df with column tokens becomes df with seeds: for position i and mask m of M, entry Mi + m; null where it doesn't fit."""
    # explode them by posexplode_outer: a filter inferred from posexplode would be pushed below these columns, and so
    # repeat the hashing inside the lambda, element by element
    df = df.withColumn("_h", F.transform("tokens", lambda t: F.xxhash64(t)))
    n = F.size("_h")
    at = lambda i, mask: F.when(i + mask[-1] < n, F.xxhash64(F.lit(str(mask)), *[F.get("_h", i + k) for k in mask]))
    seeds = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*[at(i, mask) for mask, _, _ in masks])))
    return df.withColumn("seeds", F.when(n > 0, seeds)).drop("_h")


def _around(df: DataFrame, at: str) -> DataFrame:
    """df plus near: of the tokens at most REACH - 1 places from position `at`, (r, hash), those outside the text left out."""
    df = df.withColumn("_h", F.transform("tokens", lambda t: F.xxhash64(t)))
    near = F.transform(F.sequence(F.lit(1 - REACH), F.lit(REACH - 1)), lambda r: F.struct(r.alias("r"), F.get("_h", F.col(at) + r).alias("t")))
    return df.withColumn("near", F.filter(near, lambda x: x["t"].isNotNull())).drop("_h", "tokens")


def common_pairs(found: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, n, shift): the alignments at common seeds that can be an overlap; none that is one is
    lost. found: (doc_id, text_key, p, seed, tokens) of documents; held: (item_id, n, q, seed, tokens) of items.

    Around a seed, a token at a place is rare if COMMON items or fewer have it there. An overlap agrees in a rare token,
    and then a join on seed, place and token finds it, with COMMON items a token at most; or all tokens that agree are
    common, and then the common tokens of both sides suffice by themselves. Rows with the same common tokens are one
    signature, and signatures of a seed are compared instead of rows.
    """
    found, held = saved(_around(found, "p")), saved(_around(held, "q"))
    tokens = lambda df, *more: df.select("*", F.explode("near").alias("_x")).select(*more, F.col("_x.r").alias("r"), F.col("_x.t").alias("t"))
    counts = saved(tokens(held, "seed").groupBy("seed", "r", "t").agg(F.count("*").alias("df")))
    rare, common = counts.where(F.col("df") <= COMMON).drop("df"), counts.where(F.col("df") > COMMON).drop("df")
    usual = saved(common.groupBy("seed").agg(F.collect_list(F.struct("r", "t")).alias("usual")))
    signed = lambda df: saved(df.join(usual, "seed").withColumn("mine", F.array_sort(F.array_intersect("near", "usual"))).drop("usual"))
    found, held = signed(found), signed(held)
    reach = F.least(F.col("n"), F.lit(REACH))
    # what both sides' common tokens can't make up must be rare ones
    place, pair = ["seed", "r", "t"], ["seed", "doc_id", "text_key", "p", "item_id", "n", "q", "a", "b"]
    met = tokens(found, "doc_id", "text_key", "p", "seed", F.size("mine").alias("a")).join(tokens(held, "item_id", "n", "q", "seed", F.size("mine").alias("b")).join(rare, place), place)
    met = met.groupBy(*pair).agg(F.count("*").alias("_rare")).where(F.col("_rare") >= F.ceil(F.lit(AGREE) * reach) - F.least("a", "b"))
    by_token = met.select("doc_id", "text_key", "item_id", "n", (F.col("p") - F.col("q")).alias("shift"))
    left, right = found.withColumn("near", F.col("mine")).drop("mine"), held.withColumn("near", F.col("mine")).drop("mine")
    kinds = lambda df, *more: df.groupBy("seed", "near", *more).agg(F.count("*").alias("_rows")).drop("_rows")
    meet = kinds(left).withColumnRenamed("near", "a").join(kinds(right, reach.alias("reach")).withColumnRenamed("near", "b"), "seed")
    need = F.ceil(F.lit(AGREE) * F.col("reach"))
    meet = meet.where((F.size("a") >= need) & (F.size("b") >= need)).withColumn("same", F.transform(F.array_intersect("a", "b"), lambda x: x["r"])).where(F.size("same") >= need)
    best = F.array_max(F.transform("same", lambda r: F.size(F.filter("same", lambda o: (o >= r) & (o < r + REACH)))))
    meet = saved(meet.where(best >= need).select("seed", "a", "b", "reach"))
    by_signature = left.withColumnRenamed("near", "a").join(meet, ["seed", "a"]).join(right.withColumnRenamed("near", "b").withColumn("reach", reach), ["seed", "b", "reach"])
    return by_token.union(by_signature.select("doc_id", "text_key", "item_id", "n", (F.col("p") - F.col("q")).alias("shift")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id): which document holds which item, once each.

    Null and empty texts on either side hold nothing. Null ids are kept (null-safe joins); repeated rows give one row.
    Texts of any length are searched whole; an empty table on either side gives an empty one; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens_of(F.col(item_text)).alias("tokens"))
    lengths = items.select(F.least(F.size("tokens"), F.lit(REACH)).alias("n")).distinct().collect()
    masks = masks_for({r["n"] for r in lengths}) or MASKS[:1]
    m = len(masks)
    seeds = _seeds(items, masks).select("item_id", F.size("tokens").alias("n"), F.posexplode_outer("seeds").alias("q", "seed"))
    serves = F.array(*[F.least("n", F.lit(REACH)).between(lo, hi) for _, lo, hi in masks])
    seeds = seeds.where(F.get(serves, F.col("q") % m) & F.col("seed").isNotNull())
    seeds = saved(seeds.select("item_id", "n", F.floor(F.col("q") / m).cast("int").alias("q"), "seed"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("text_key"), tokens_of(F.col("text")).alias("tokens"))
    placed = _seeds(own, masks).select("doc_id", "text_key", F.posexplode_outer("seeds").alias("p", "seed"))
    common = saved(seeds.groupBy("seed").agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON).select("seed"))
    shared = not common.isEmpty()
    own_seeds = seeds.join(common, "seed", "left_anti") if shared else seeds
    right = F.broadcast(own_seeds) if seeds.count() <= BROADCAST_SEEDS else own_seeds
    at = F.floor(F.col("p") / m).cast("int")
    hits = placed.join(right, "seed").select("doc_id", "text_key", "item_id", "n", (at - F.col("q")).alias("shift"))
    if shared:
        same_doc = lambda x: F.col("doc_id").eqNullSafe(x["_id"]) & F.col("text_key").eqNullSafe(x["_key"])
        texts = own.distinct().select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "tokens")
        found = saved(placed.join(common, "seed").select("doc_id", "text_key", at.alias("p"), "seed").distinct())
        found = found.join(texts, same_doc(texts)).drop("_id", "_key")
        named = items.select(F.col("item_id").alias("_item"), "tokens").distinct()
        held = seeds.join(common, "seed").distinct().join(named, F.col("item_id").eqNullSafe(F.col("_item"))).where(F.size("tokens") == F.col("n")).drop("_item")
        hits = hits.union(common_pairs(found, held))
    # a whole item at one place is enough; a longer one is tried at all alignments
    # one key per document; its alignments are bounded by its own hits
    hits = hits.groupBy("doc_id", "text_key", "item_id", "n", F.when(F.col("n") > WHOLE, F.col("shift")).alias("_s")).agg(F.min("shift").alias("shift"))
    lined = saved(hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("lines")))
    lined = lined.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "lines")
    near = own.join(lined, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")))
    # an alignment carries the tokens under its item only, not the document's
    at = F.col("line.shift")
    under = F.slice("tokens", F.greatest(at, F.lit(0)) + 1, F.col("line.n") + F.least(at, F.lit(0)))
    near = near.select("doc_id", "text_key", "tokens", F.explode("lines").alias("line"))
    near = near.select("doc_id", "text_key", under.alias("tokens"), "line.item_id", F.least(at, F.lit(0)).alias("shift"))
    wanted = items.select(F.col("item_id").alias("_item"), F.col("tokens").alias("_wanted"))
    near = near.join(wanted, F.col("item_id").eqNullSafe(F.col("_item")))
    same = F.transform("_wanted", lambda t, j: F.when(F.coalesce(F.get("tokens", F.col("shift") + j) == t, F.lit(False)), 1).otherwise(0))
    near = near.select("doc_id", "text_key", "item_id", same.alias("same"), F.least(F.size("_wanted"), F.lit(REACH)).alias("reach"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("reach") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("reach")), F.lit(0), lambda a, x: a + x)))
    return near.where(best >= F.ceil(F.lit(AGREE) * F.col("reach"))).select("doc_id", "text_key", "item_id").distinct()


def _keyed(docs: DataFrame, found: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    own = docs.withColumns({"_id": F.col(id_col), "_key": F.xxhash64(F.col(text_col).cast("string"))})
    right = found.withColumnsRenamed({"doc_id": "_id2", "text_key": "_key2"})
    return own.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_key").eqNullSafe(F.col("_key2")), how).drop("_id", "_key", "_id2", "_key2")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item; repeated rows go or stay together. Other columns are passed on; none may be
    named _id, _key, _id2 or _key2."""
    found = saved(overlaps(docs, benchmark, id_col, text_col).select("doc_id", "text_key").distinct())
    return _keyed(docs, found, "left_anti", id_col, text_col)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of `benchmark` each row of `documents` holds. Null and empty texts hold none; rows with null ids and
    repeated rows are kept and judged by their texts; other columns are ignored; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = _keyed(docs, saved(found), "left", "doc_id", "text").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
    )
    return out.withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long")))


def re_split(text: str | None) -> list[str]:
    """For tests: the tokens of a text."""
    import re

    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str]]) -> dict[int, list[int]]:
    """For tests: doc_id to the sorted item_ids, by trying every alignment."""
    split = re_split
    want = {i: split(t) for i, t in items}
    out = {}
    for d, t in docs:
        have = split(t)
        hit = []
        for i, item in want.items():
            reach = min(len(item), REACH)
            for shift in range(-len(item) + 1, len(have)):
                same = [0 <= shift + j < len(have) and have[shift + j] == w for j, w in enumerate(item)]
                if sum(same) and max(sum(same[s : s + reach]) for s in range(len(item) - reach + 1)) >= math.ceil(AGREE * reach):
                    hit.append(i)
                    break
        out[d] = sorted(hit, key=lambda i: (i is None, i))
    return out
