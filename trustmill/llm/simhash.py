"""SimHash near-dedup by multi-index hashing.

A document's fingerprint takes, bit by bit, the majority over the hashes of its word shingles. To find all pairs of
fingerprints at two or fewer differing bits, a fingerprint is cut into three segments of 22, 21 and 21 bits, and filed
in three tables under the ordered segment pairs (1,2), (2,3) and (3,1). With at most two differing bits, either two
segments agree, and the table of that pair has an exact match; or one segment agrees and the other two differ in one
bit each, and then the table that begins with the agreeing segment has a match in the ball of radius one around the
second. So each fingerprint probes three exact keys and one key per bit of its second segments (only the bits that it
lacks: its partner finds the others). Keys have 42 bits or more, matches are verified on all 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import small_batches, table
from trustmill.llm.substring_dedup import mix
from trustmill.operators.components import connected_components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: (shift, width) of the segments.
SEGMENTS = [(42, 22), (21, 21), (0, 21)]


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `width` words, A-Z lower-cased, joined by one space; of all words if there are fewer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(start[: n - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits: each set where over half of the hashes have it; 0 for no hash."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and blank texts have fingerprint zero. Texts of any
    length are read whole, in bounded pieces of their hashes; one row per row of docs, repeated ones included; other
    columns are ignored."""

    small_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


def _key(fp: Column, i: int) -> tuple[Column, int]:
    """Key of table i, and how many of its low bits are the second segment."""
    (s1, w1), (s2, w2) = SEGMENTS[i], SEGMENTS[(i + 1) % 3]
    part = lambda s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    return F.lit(i << 48).cast("long").bitwiseOR(F.shiftleft(part(s1, w1), w2)).bitwiseOR(part(s2, w2)), w2


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a <> b: all pairs of the distinct fingerprints in column fp at 1 to max_bits (2 at most) differing bits."""
    if not 1 <= max_bits <= 2:
        raise ValueError("three segments with balls of radius one find pairs at up to two bits")
    fp = F.col("fp")
    exact = [F.struct(_key(fp, i)[0].alias("key"), F.lit(True).alias("exact")) for i in range(3)]
    near = []
    for i in range(3):
        key, width = _key(fp, i)
        near += [F.when(key.bitwiseAND(F.lit(1 << b).cast("long")) == 0, F.struct(key.bitwiseOR(F.lit(1 << b).cast("long")).alias("key"), F.lit(False).alias("exact"))) for b in range(width)]
    tables = distinct.select(fp.alias("b"), F.explode(F.array(*[x["key"] for x in exact])).alias("key"))
    probes = distinct.select(fp.alias("a"), F.inline(F.filter(F.array(*exact, *near), lambda x: x.isNotNull())))
    met = probes.join(tables, "key").where("(exact AND a < b OR NOT exact)").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits))
    return met.select("a", "b").distinct()


def near_duplicates(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps (doc_id, fp) plus component_id: the smallest doc_id reachable over links, itself included.

    Copies meet in one row per distinct fingerprint before anything is joined. A component whose ids are all null has
    a null component_id. An empty table gives an empty result.
    """
    fps = saved(fps)
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(saved(links(distinct, max_bits)), "a", "b")
    root = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = saved(root).groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(root.join(named, "root").select("fp", "component_id"), "fp")


#: Near copies: shingles of five words, similarity of 0.8 or more.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 fingerprints differ in about ten bits, too many for small balls. So near copies are also sought
#: in LANES sketches, each of the 2 and of the 4 shingles that come first in an order of its own: two documents with a
#: similarity of 0.8 share a 2-shingle key in a lane with probability 0.64, and miss all lanes with 1e-7.
LANES = 16
#: So many nodes under each key that holds several components meet all others there, before the exact join of the rest.
LEADERS = 8
#: Parity sketch: one bit per slot, set where an odd number of shingles fall into the slot. Each shingle that only one of
#: two documents holds flips one bit, so the bits that differ are never more than such shingles.
PARITY_BITS = 1024

SKETCHES = "id long, key long, digest binary, fp long, n int, odd array<long>, keys array<long>"


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    slots = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((slots & 1).astype(np.uint8)).view(np.int64)


def _lane_keys(hashes: np.ndarray) -> list[int]:
    keys = []
    for lane in range(LANES):
        order = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & (2**64 - 1)))
        first = np.sort(np.partition(order, 3)[:4] if len(order) > 4 else order)
        for k in (2, 4):
            keys.append(xxhash.xxh64_intdigest(first[:k].tobytes() + bytes([k, lane])))
    return keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        digests, fps, sizes, odd, keys = [], [], [], [], []
        for t in batch.column(2):
            # similarity is of sets, so repeats of a shingle count nowhere here
            distinct = np.unique(shingle_hashes(t.as_py(), COPY_SHINGLE))
            digests.append(xxhash.xxh3_128_digest(distinct.tobytes()))
            fps.append(fingerprint(distinct))
            sizes.append(len(distinct))
            odd.append(parity_sketch(distinct))
            keys.append(np.array(_lane_keys(distinct) if len(distinct) else [], np.uint64).view(np.int64))
        columns = [pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, longs), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "key", "digest", "fp", "n", "odd", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), COPY_SHINGLE)).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _may_be_similar() -> Column:
    """Whether documents of na and nb distinct shingles, with parity sketches oa and ob, can be similar enough: no pair
    that is fails this. A similarity of s leaves (1 - s) / (1 + s) of all shingles to one document alone."""
    alone = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")) & (alone <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("na") + F.col("nb")) + 1e-6)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("both") >= SIMILARITY * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _edges_between(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of members (node, root) that are similar enough and have different roots.

    An exact prefix-filter join. Shingles are ordered by how many texts hold them; those that only one component holds
    come first, as no pair sought shares them. The first shingle that a pair shares lies so early in both orders that
    enough can follow: among the first 1 - s of the larger set, and the first 1 - 2s / (1 + s) of the smaller. Boilerplate
    comes last and gets into a prefix only where it nearly suffices for a similarity of s by itself. Under a shingle,
    components meet before their members do, so members of one component are never paired.
    """
    rooted = saved(sets.join(members, "node").select("node", "root", F.size("shingles").alias("n"), "shingles"))
    each = rooted.select("node", "root", "n", F.explode("shingles").alias("h"))
    # saved, so that joins can split a shingle that very many texts hold
    shared = saved(each.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "df"))
    least = lambda share: F.ceil(F.lit(share) * F.col("n") - 1e-6)
    ranked = each.join(shared, "h").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order")).where(F.size("order") >= least(SIMILARITY))
    ranked = ranked.select("node", "root", "n", F.size("order").alias("m"), F.posexplode("order").alias("p", "t"))
    # left: how many shingles, this one included, can still be shared
    placed = saved(ranked.select("node", "root", "n", F.col("t.h").alias("h"), (F.col("m") - F.col("p")).alias("left")).where(F.col("left") >= least(SIMILARITY)))
    half = SIMILARITY / (1 + SIMILARITY)
    smaller = placed.where(F.col("left") >= least(2 * half))
    # of the members of a component under a shingle: the largest `left`, the range of sizes; no pair fails these that fits
    held = lambda df, x: df.groupBy("h", F.col("root").alias(f"root_{x}")).agg(F.max("left").alias(f"most_{x}"), F.min("n").alias(f"low_{x}"), F.max("n").alias(f"high_{x}"))
    meet = held(placed, "a").join(held(smaller, "b"), "h").where("root_a <> root_b AND low_b <= high_a")
    meet = meet.where((F.least("most_a", "most_b") >= F.lit(half) * (F.col("low_a") + F.col("low_b")) - 1e-6) & (F.col("high_b") >= SIMILARITY * F.col("low_a"))).select("h", "root_a", "root_b")
    side = lambda df, x: df.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "left")])
    met = saved(meet).join(side(placed, "a"), ["h", "root_a"]).join(side(smaller, "b"), ["h", "root_b"])
    met = met.where("n_b < n_a OR n_b = n_a AND node_b < node_a").where(F.least("left_a", "left_b") >= F.lit(half) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    return _similar(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), rooted)


def _merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, root) after the components at the two ends of each edge (a, b) have become one: only components are
    searched, not their nodes again. A root is the smallest node of its component."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = edges.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b").select("root_a", "root_b").distinct()
    found = connected_components(between, "root_a", "root_b").withColumnRenamed("node", "root")
    return saved(nodes.join(found, "root", "left").select("node", F.coalesce("component", "root").alias("root")))


def _torn(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, node, root) of the keys whose nodes are in several components."""
    rooted = saved(crowded.join(nodes, "node").select("k", "node", "root"))
    keys = saved(rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k"))
    return saved(rooted.join(keys, "k", "left_semi"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, keeper, keeper_key) of every row in a group of near copies, key being a hash of the text: the row, and
    the one that stays, with the smallest id (null ids last, ties by key). Rows alone are left out.

    Texts with the same set of shingles are one node. Candidates come from links of fingerprints at two bits or fewer
    and from the lanes, where every node meets the smallest one under its key. Pairs that the parity sketches don't rule
    out are verified on the exact similarity of their whole texts. Where nodes under a key of three or more are still in
    different components, a few of them meet all others in the same way; keys that are torn even then are searched for
    all similar pairs across components, by an exact join.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    sketches = saved(own.mapInArrow(_sketches, SKETCHES))
    at = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    firsts = [F.first(c).alias(c) for c in ("fp", "n", "odd", "keys")]
    alike = sketches.groupBy("digest").agg(F.min(at).alias("at"), *firsts, F.count("*").alias("copies"))
    alike = saved(alike.withColumn("node", F.monotonically_increasing_id()))
    keyed = saved(alike.select("node", F.explode("keys").alias("k")))
    heads = keyed.groupBy("k").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("held"))
    heads = saved(heads.where("leader < last").drop("last"))
    by_lane = keyed.join(heads.select("k", "leader"), "k").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    by_fp = saved(alike.groupBy("fp").agg(F.min("node").alias("least")))
    same_fp = alike.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    named = lambda x: by_fp.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node"))
    close = links(by_fp.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    pairs = by_lane.union(same_fp).union(close).distinct()
    side = lambda x: alike.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    near = saved(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_be_similar()).select("a", "b"))
    crowded = saved(keyed.join(heads.where("held > 2").select("k"), "k", "left_semi"))
    # texts are dealt once, and only of nodes that are in a pair or under a crowded key
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).union(crowded.select("node")).distinct()
    wanted = alike.join(wanted, "node").select("node", F.col("at.id").alias("_id"), F.col("at.key").alias("_key"))
    texts = own.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "text")
    sets = saved(texts.dropDuplicates(["node"]).mapInArrow(_sets, "node long, shingles array<long>"))
    edges = _similar(near, sets)
    nodes = _merged(alike.select("node", F.col("node").alias("root")), edges)
    # sketches travel with the nodes of torn keys, so that a pair that they rule out is never made
    torn = _torn(crowded, nodes).join(alike.select("node", "n", "odd"), "node")
    torn = saved(torn.select("k", F.col("node").alias("b"), "root", F.col("n").alias("nb"), F.col("odd").alias("ob")))
    draw = lambda r: F.min(F.struct(F.xxhash64("root" if r % 2 else "b", F.lit(r)).alias("h"), F.col("b").alias("a"), F.col("root").alias("root_a"), F.col("nb").alias("na"), F.col("ob").alias("oa")))
    leaders = saved(torn.groupBy("k").agg(F.array(*[draw(r) for r in range(LEADERS)]).alias("drawn")).select("k", F.inline("drawn")).drop("h").distinct())
    met = torn.join(leaders, "k").where(F.col("root") != F.col("root_a")).where(_may_be_similar())
    met = saved(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = _merged(nodes, _similar(met, sets))
    rest = saved(_edges_between(_torn(crowded, nodes).select("node", "root").distinct(), sets))
    if not rest.isEmpty():
        nodes = _merged(nodes, rest)
    grouped = saved(alike.join(nodes, "node").select("digest", "at", "copies", "root"))
    keepers = saved(grouped.groupBy("root").agg(F.min("at").alias("keeper"), F.sum("copies").alias("rows")).where("rows > 1"))
    stays = grouped.join(keepers, "root").select("digest", F.col("keeper.id").alias("keeper"), F.col("keeper.key").alias("keeper_key"))
    return sketches.select("id", "key", "digest").join(stays, "digest").drop("digest")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each group of near copies stays: the one with the smallest id.

    Null, empty and blank texts are copies of each other; texts of fewer than five words are alike if all their words
    are. Rows are told apart by id and text, so different texts under one id are judged each for itself; of rows equal
    in both, one stays. Null ids come last. An empty table gives an empty one. Texts of any length are taken whole; other
    columns are passed on, those named _id and _key excepted, which must not exist.
    """
    own = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(F.col(text_col).cast("string"))})
    members = saved(copy_groups(docs, id_col, text_col))
    stays = F.col("id").eqNullSafe(F.col("keeper")) & (F.col("key") == F.col("keeper_key"))
    gone = members.where(~stays).select("id", "key").distinct()
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key"))
    # the list grows with the input: one plan for all sizes
    rest = own.join(saved(gone).hint("merge"), same, "left_anti")
    again = saved(members.where(stays).groupBy("id", "key").count().where("count > 1").select("id", "key"))
    if again.isEmpty():
        return rest.drop("_id", "_key")
    once = rest.join(again, same, "left_semi").dropDuplicates(["_id", "_key"])
    return rest.join(again, same, "left_anti").unionByName(once).drop("_id", "_key")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of `documents`. Null and blank texts have fingerprint zero; texts of any length
    are taken whole; repeated rows share a fingerprint; a component whose ids are all null has a null id; other columns are
    ignored; an empty table gives an empty one."""
    out = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]], max_bits: int = MAX_BITS) -> dict[int, tuple[str, int]]:
    """For tests: doc_id to (fingerprint, component_id), by comparing all pairs."""
    fp = {d: fingerprint(shingle_hashes(t)) for d, t in rows}
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fp[d]:016x}", find(d)) for d in fp}
