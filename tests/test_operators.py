import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.functions.hashing import stable_seed
from trustmill.operators import audit, calibration, components, contracts, groups, hamming, learn, prefix, provenance, quantiles, shift, splits
from trustmill.operators.components import connected_components
from trustmill.plans import catalog
from trustmill.sources import arrays, files, images
from trustmill.streaming import events


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for e in edges if None not in e for n in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_totals(spark):
    rows = [(g, i, (i * 7) % 5) for g in "ab" for i in range(50)]
    out = prefix.running_before(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], {"before": "v"}).collect()
    for r in out:
        assert r["before"] == sum(v for g, i, v in rows if g == r["g"] and i < r["i"])
    assert [r[0] for r in spark.range(1).select(prefix.code(F.lit(12), "g")).collect()] == ["g0012"]
    assert spark.range(1).select(prefix.code(F.lit(123456), "g")).first()[0] == "g123456"


def test_quotas_and_subset_sums(spark):
    parts = {"train": 0.5, "train_aux": 0.1, "calibration": 0.15, "reserve": 0.1, "test": 0.15}
    q = splits.subset_quotas(spark.createDataFrame([("h", 1645)], "label string, size long"), ["label"], "size", parts)
    assert {r["subset"]: r["quota"] for r in q.collect()} == {"train": 823, "train_aux": 164, "calibration": 247, "reserve": 164, "test": 247}


def one_by_one(sizes, counts, want, ties):
    """Group by group, biggest first: the part that lacks most, of equal ones that of the least rank."""
    want, out = list(want), []
    for s, c, rank in zip(sizes, counts, ties, strict=True):
        own = [0] * len(want)
        for _ in range(c):
            i = min(range(len(want)), key=lambda i: (-want[i], rank[i]))
            want[i] -= s
            own[i] += 1
        out.append(own)
    return out


def test_greedy_counts_equal_one_group_at_a_time():
    rng = np.random.default_rng(8)
    for _ in range(200):
        sizes = sorted({int(x) for x in rng.integers(1, 12, rng.integers(1, 6))}, reverse=True)
        counts = [int(x) for x in rng.integers(1, 15, len(sizes))]
        want = [int(x) for x in rng.integers(0, 60, rng.integers(1, 6))]
        ties = [[int(x) for x in rng.permutation(len(want))] for _ in sizes]
        assert splits.greedy_counts(sizes, counts, want, ties) == one_by_one(sizes, counts, want, ties)
    many = splits.greedy_counts([7, 1], [10**9, 10**10], [10**10, 6 * 10**9, 10**9], [[0, 1, 2]] * 2)
    assert [sum(x) for x in many] == [10**9, 10**10] and [7 * a + b for a, b in zip(*many, strict=True)] == [10**10, 6 * 10**9, 10**9]


def test_closest_counts(monkeypatch):
    """The sum is the closest that any subset has, of two the lower one; few of the numbers are far from their share. So it
    is too where most groups are fixed by their share beforehand."""
    rng = np.random.default_rng(9)
    for most in (1 << 26, 0):
        monkeypatch.setattr(splits, "MOST_SUMS", most)
        for _ in range(150):
            sizes = [int(x) for x in rng.permutation(np.arange(1, 30) * int(rng.integers(1, 4)))[: rng.integers(1, 5)]]
            counts = [int(x) for x in rng.integers(1, 400 if most == 0 else 9, len(sizes))]
            sums = {0}
            for s, c in zip(sizes, counts, strict=True):
                sums = {t + s * m for t in sums for m in range(c + 1)} if len(sums) * c < 3e5 else sums | {t + s * m for t in sums for m in range(0, c + 1)}
            for target in (0, 1, int(sum(s * c for s, c in zip(sizes, counts, strict=True)) * 0.2), int(rng.integers(0, 200)), 10**7):
                taken = splits.closest_counts(sizes, counts, target)
                got = sum(s * m for s, m in zip(sizes, taken, strict=True))
                assert all(0 <= m <= c for m, c in zip(taken, counts, strict=True)) and got == min(sums, key=lambda t: (abs(t - target), t > target))
    assert splits.closest_counts([], [], 3) == []
    monkeypatch.setattr(splits, "MOST_SUMS", 1 << 26)
    assert splits.closest_counts([1, 3], [10**11, 10**10], 26 * 10**9) == [20 * 10**9, 2 * 10**9]


def test_secondary_split_of_many_groups_of_a_size(spark, tmp_path):
    """Thousands of groups of one size: as in the SQL, others make up a rest with 999 of them at most; where that doesn't
    reach the closest sum, all of them count."""
    orders = spark.sql("SELECT CASE WHEN id < 6000 THEN id ELSE 6000 + (id - 6000) DIV 10 END AS o_custkey, 'x' AS o_orderpriority FROM range(21000)")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.secondary_split(spark, str(tmp_path)).select("o_custkey", "label", "size", "part").collect())
    assert got == sorted(con.sql(f"SELECT o_custkey, label, size, part FROM ({catalog.ORACLES['secondary_split']})").fetchall())
    assert splits.closest_counts([10, 1], [1500, 6000], 4200) == [321, 990]
    assert splits.closest_counts([10, 1], [1000, 90_000], 20_000) == [200, 18_000]


def test_group_splits_of_odd_rows(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("c", 3, "x"), ("d", 2, None), ("e", 1, "y")]
    df = spark.createDataFrame(rows, "k string, size int, label string")
    out = {r["k"]: r["subset"] for r in splits.assign_greedily(df, "label", "size", "k", {"p": 0.6, "q": 0.4}).collect()}
    assert set(out) == {"a", "b", "c", "e"} and out["c"] == out["e"] == "p" and {out["a"], out["b"]} == {"q"}
    assert splits.assign_greedily(df.limit(0), "label", "size", "k", {"p": 1.0}).count() == 0
    members = spark.createDataFrame([(g, label) for g, n, label in [("g1", 4, "x"), ("g2", 1, "x"), ("g3", 5, None), ("g4", 5, "x")] for _ in range(n)], "g string, label string")
    got = {r["g"]: (r["size"], r["part"]) for r in splits.secondary_split(members, "label", "g").collect()}
    assert got == {"g1": (4, "train"), "g2": (1, "val"), "g4": (5, "train")}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_with_hubs(spark, kind, monkeypatch):
    """A star of very many leaves, a long chain, copies of edges; contracted portions of few edges."""
    monkeypatch.setattr(components, "PORTION", 1000)
    star = spark.range(1, 60_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(100_000, 100_200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = star.union(chain).union(chain).union(spark.createDataFrame([(7, 7), (None, 3), (500_000, 500_000)], "src long, dst long"))
    edges = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind)).repartition(8)
    got = connected_components(edges, hubs=True)
    want = [("0", 60_001), ("100000", 201), ("500000", 1)]
    assert sorted((str(r["component"]), r["count"]) for r in got.groupBy("component").count().collect()) == sorted(want)
    few = components.contracted(chain.union(chain).coalesce(1).toDF("u", "v"))
    assert few.count() == 200 and {r["v"] for r in few.collect()} == {100_000}
    # the hub's join reads saved tables, which can be split
    plan = components._large_star(edges.toDF("u", "v"), components.saved)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[1]


def test_bands_lose_no_pair():
    """Any split of a distance over the bands leaves one within its radius; and no smaller radii would do."""
    for distance in range(25):
        for many in range(2, 34):
            plan = hamming.bands(distance, many)
            assert sum(b.radius + 1 for b in plan) == distance + 1 and all(b.width <= 32 and b.ball() == len(set(b.masks())) for b in plan if b.ball() < 5000)
    few, lots = hamming.best_bands(6, 1000), hamming.best_bands(6, 10**8)
    assert len(few) > len(lots) and hamming.rows_made(lots, 10**8) < 1e-3 * 10**16 / 2
    assert hamming.best_bands(18, 10**6)


@pytest.mark.parametrize("many", [2, 3, 4, 5, 8, 13])
def test_any_number_of_bands_finds_all(spark, many):
    rng = np.random.default_rng(many)
    base = [int(x) for x in rng.integers(0, 2**63, 25)] + [0, 2**64 - 1]
    flip = lambda v, n: v ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False))
    values = list({*base, *[flip(b, n) for b in base for n in range(1, 9)]})
    df = spark.createDataFrame([(i, v >> 32, v & (2**32 - 1)) for i, v in enumerate(values)], "v int, h long, l long")
    got = [tuple(r) for r in hamming.close_pairs(df, 7, hamming.bands(7, many)).collect()]
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 7}
    assert set(got) == want and len(got) == len(want)


def test_no_pairwise_comparison_in_the_plan(spark):
    df = spark.range(3000).select(F.col("id").alias("v"), (F.col("id") * 7919 % 4294967296).alias("h"), (F.col("id") * 104729 % 4294967296).alias("l"))
    plan = hamming.close_pairs(df, 18)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_find_all_pairs_once(spark, monkeypatch):
    """Several blocks with copies, rows without a hash and portions of few pairs; links join what the pairs join."""
    monkeypatch.setattr(hamming, "PORTION", 5)
    monkeypatch.setattr(hamming, "TILE", (3, 7))
    rng = np.random.default_rng(12)
    base = [int(x) for x in rng.integers(0, 2**63, 12)] + [0, 2**64 - 1]
    values = base * 3 + [b ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in range(1, 7)]
    rows = [(f"k{i}", v >> 32, v & (2**32 - 1)) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("none", None, 1), ("none", 1, None)], "v string, h long, l long")
    got = [tuple(r) for r in hamming.block_pairs(df, 5, len(values)).collect()]
    want = {(frozenset((f"k{a}", f"k{b}")), (values[a] ^ values[b]).bit_count()) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 5}
    assert {(frozenset(r[:2]), r[2]) for r in got} == want and len(got) == len(want)
    found = lambda e: {tuple(r) for r in connected_components(e, "v_a", "v_b").collect()}
    links = hamming.block_links(df, 5, len(values))
    assert found(links) == found(hamming.block_pairs(df, 5, len(values))) and links.count() < len(want)


def test_links_at_a_wide_distance_join_no_candidates(spark):
    """At 18 bits bands make thousands of rows a hash; no candidate goes through a join, and no link of two blocks in vain."""
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, int(h), int(low)) for i, (h, low) in enumerate(rng.integers(0, 2**32, (3000, 2)))], "id long, hi long, lo long")
    assert hamming.in_blocks(18, 600_000) and not hamming.in_blocks(4, 10**8)
    assert "Join" not in hamming.close_pairs(items.selectExpr("id AS v", "hi AS h", "lo AS l"), 18)._jdf.queryExecution().executedPlan().toString()
    links, pairs = audit.near_links(items, "id", "hi", "lo", 22), audit.near_pairs(items, "id", "hi", "lo", 22)
    assert {r["v"] for r in connected_components(links, "a", "b").selectExpr("struct(*) AS v").collect()} == {r["v"] for r in connected_components(pairs, "id_a", "id_b").selectExpr("struct(*) AS v").collect()}
    assert links.count() < pairs.count() / 2


def test_sweep_without_exact_copies(spark):
    rows = [(1, 5, 0, "x"), (2, 5, 0, "x"), (3, 5, 1, "x"), (4, 5, 1, "y"), (5, 5, 1, None), (6, None, 1, "z")]
    items = spark.createDataFrame(rows, "id int, hi long, lo long, sha string")
    got = {tuple(r) for r in audit.near_pairs(items, "id", "hi", "lo", 3, "sha").collect()}
    assert got == {(1, 4, 1), (2, 4, 1), (3, 4, 0), (1, 5, 1), (2, 5, 1), (3, 5, 0), (4, 5, 0)}


@pytest.mark.parametrize("distance", [0, 1, 5, 7, 12])
def test_near_pairs(spark, distance):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**62, 20)]
    values = base + [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(4)] + base[:5]
    rows = [(i, f"{v:016x}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, h string")
    hi, lo = audit.halves(F.col("h"))
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in audit.near_pairs(df.select("id", hi.alias("hi"), lo.alias("lo")), "id", "hi", "lo", distance).collect()}
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= distance}
    assert got == want


@pytest.mark.parametrize("distance", [2, 18])
def test_near_links_join_what_near_pairs_join(spark, distance):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    values = base * 20 + [b ^ (1 << int(rng.integers(64))) for b in base]
    rows = [(i, f"{v:016x}") for i, v in enumerate(values)]
    hi, lo = audit.halves(F.col("h"))
    df = spark.createDataFrame(rows, "id int, h string").select("id", hi.alias("hi"), lo.alias("lo"))
    edges = audit.near_links(df, "id", "hi", "lo", distance)
    pairs = audit.near_pairs(df, "id", "hi", "lo", distance)
    found = lambda e, a, b: {tuple(r) for r in connected_components(e, a, b).collect()}
    assert found(edges, "a", "b") == found(pairs, "id_a", "id_b")
    assert edges.count() < 2 * len(values) < pairs.count()


def test_exact_duplicates_and_report(spark):
    rows = [("s", "a", "x", 1), ("s", "b", "x", 2), ("t", "a", "y", 3), ("s", "c", "z", 4), ("s", "a", "z", 5), ("s", "a", "w", 6), ("s", "a", None, 7), ("s", "a", None, 8)]
    m = spark.createDataFrame(rows + [("t", "b", "v", 9), ("s", None, "v", 10)], "dataset string, label string, sha256 string, path int")
    got = audit.exact_duplicates(m)
    assert {tuple(r) for r in got.select("sha256", "dataset", "path", "count", "scope", "labels").collect()} == {
        ("x", "s", 1, 2, "within_s", "a;b"), ("x", "s", 2, 2, "within_s", "a;b"), ("z", "s", 4, 2, "within_s", "a;c"), ("z", "s", 5, 2, "within_s", "a;c"),
        ("v", "t", 9, 2, "cross_dataset", "b"), ("v", "s", 10, 2, "cross_dataset", "b"),
    }
    assert {(r["sha256"], r["paths"]) for r in audit.duplicate_report(got).collect()} == {("x", "1;2"), ("z", "4;5"), ("v", "10;9")}
    assert audit.exact_duplicates(m.limit(0)).count() == 0


def test_links_and_groups(spark):
    m = spark.createDataFrame([("a", "source", "1"), ("b", "source", "1"), ("c", "source", "2"), ("d", "target", "2"), ("e", "source", "3"), ("f", "source", "4")], "path string, dataset string, sha256 string")
    reviews = spark.createDataFrame([("e", "f", "unsure"), ("a", "e", "different"), ("d", "f", "different")], "path_a string, path_b string, decision string")
    links, gone = groups.collect_links(m, reviews)
    assert {(r["a"], r["b"]) for r in links.collect()} == {("a", "b"), ("e", "f")}
    assert [r["path"] for r in gone.collect()] == ["c"]
    pool = m.where("dataset = 'source'").join(gone, "path", "left_anti")
    got = {r["path"]: (r["group_id"], r["size"]) for r in groups.build_groups(pool, links).collect()}
    assert got == {"a": ("g0001", 2), "b": ("g0001", 2), "e": ("g0002", 2), "f": ("g0002", 2)}


def test_stable_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42\0p/q.jpg\0blur\x001").digest()[:8], "big") % (2**63 - 1)
    assert spark.range(1).select(stable_seed(F.lit(42), F.lit("p/q.jpg"), F.lit("blur"), F.lit(1))).first()[0] == want


def bisected(z, y):
    """1/T where the slope of the loss is zero."""
    low, high = calibration.LOW, calibration.HIGH
    for _ in range(60):
        middle = (low + high) / 2
        e = np.exp(middle * (z - z.max(1, keepdims=True)))
        falls = ((e * z).sum(1) / e.sum(1) - z[np.arange(len(y)), y]).sum() < 0
        low, high = (middle, high) if falls else (low, middle)
    return (low + high) / 2


def test_temperature(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 3, (400, 3))
    p = np.exp(z / 2) / np.exp(z / 2).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=row)) for row in p]
    df = spark.createDataFrame([(1, a.tolist(), b) for a, b in zip(z, y, strict=True)], "seed int, logits array<double>, label int")
    t = calibration.fit_temperature(df, ["seed"]).first()
    assert t["temperature"] == pytest.approx(1 / bisected(z, np.array(y)), rel=1e-9) and not t["hit_limit"]


def test_nearest_blocks_hold_many_cells(spark, monkeypatch):
    """Where nothing can be pruned a row is sent once a block of the other side, whatever the number of cells."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>")
    kept, keep = [], shift.saved
    monkeypatch.setattr(shift, "saved", lambda d: kept.append(keep(d)) or kept[-1])
    got = {r["id"]: r["nearest"] for r in shift.nearest_distance(df, df, "id", exclude_self=True, pivots=30, block=200).collect()}
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * 600)
    assert np.allclose([got[i] for i in range(600)], apart.min(1), atol=1e-9)
    assert [d.count() for d in kept if d.columns == ["x", "y"]] == [9]


def test_nearest_by_pivots(spark):
    """Clusters, copies, several blocks in a cell, rows without vectors; equal to all distances, and not all blocks meet."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 3)) * 40
    x = np.vstack([c + rng.normal(size=(60, 3)) for c in centres] + [centres[:1].repeat(30, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    a = spark.createDataFrame(rows[::2] + [(9999, None)], "id long, z array<double>")
    b = spark.createDataFrame(rows + [(None, [0.0, 0.0, 0.0])], "id long, z array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for exclude in (False, True):
        own = d + np.where(np.eye(len(x)) > 0, np.inf, 0) if exclude else d
        got = {r["id"]: r["nearest"] for r in shift.nearest_distance(a, b, "id", exclude_self=exclude, pivots=40, block=25).collect()}
        assert set(got) == set(range(0, len(x), 2)) and all(abs(got[i] - own[i].min()) < 1e-6 for i in got)
    one = spark.createDataFrame(rows[:1], "id long, z array<double>")
    assert shift.nearest_distance(one, one, "id", exclude_self=True).count() == 0 and shift.nearest_distance(a, b.limit(0), "id").count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {"wide": rng.normal(size=5000) * 10.0 ** rng.integers(-9, 9, 5000), "few": rng.integers(0, 3, 900).astype(float), "one": np.array([2.5]), "same": np.full(50, 7.0), "huge": np.array([-1e308, 1e308, 0.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None), (None, 3.0), (None, 5.0)]
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares).collect()}
    want = {(g, p): np.quantile(v, p) for g, v in (groups | {None: np.array([3.0, 5.0])}).items() for p in shares}
    assert set(got) >= {k for k in want if k[0] is not None} and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want if k in got)
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(spark.createDataFrame([(1.0,), (float("inf"),)], "v double"), [], "v", [0.5])


def test_pca_and_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, z array<double>")
    out, shares = shift.principal_components(df, ["id"], "z", F.lit(True))
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2].tolist())
    got = np.array([r["pc1"] for r in out.orderBy("id").collect()])
    want = (x - x.mean(0)) @ vt[0]
    assert np.allclose(np.abs(got), np.abs(want))
    near = {r["id"]: r["nearest"] for r in shift.nearest_distance(df, df, "id", exclude_self=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag([np.inf] * 60)
    assert np.allclose([near[i] for i in range(60)], d.min(1))


def test_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text("a" * 64 + "  x/y.csv\nnot a line\n")
    assert [tuple(r) for r in files.read_hash_list(spark, str(tmp_path / "h.txt")).collect()] == [("a" * 64, "x/y.csv")]
    rows = spark.createDataFrame([(42, 0.4, "B1 MSP", 0.1, 0.2)], "seed int, temperature double, method string, tau80 double, tau90 double")
    files.write_settings(rows, str(tmp_path / "s"))
    assert files.read_settings(spark, str(tmp_path / "s")).collect() == rows.collect()
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(3, 2), y=np.array(["a", "b", "c"]))
    assert arrays.load_arrays(spark, str(tmp_path / "a.npz")).count() == 3
    (tmp_path / "c.csv").write_text("a,b,f\nx,,TRUE\n,y,false\n")
    got = files.read_csv(spark, str(tmp_path / "c.csv"), "a string, b string, f boolean", keep_blanks=True).collect()
    assert [tuple(r) for r in got] == [("x", "", True), ("", "y", False)]
    (tmp_path / "img" / "rust").mkdir(parents=True)
    (tmp_path / "img" / "rust" / "1.JPG").write_bytes(b"x")
    assert files.labelled_files(spark, str(tmp_path / "img")).first()["label"] == "rust"


def test_write_checked(spark, tmp_path):
    path = str(tmp_path / "out")

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        provenance.write_checked(spark.range(3), path, refuse)
    assert not (tmp_path / "out").exists()
    provenance.write_checked(spark.range(3), path, lambda df: None)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        provenance.write_checked(spark.range(3), path, lambda df: None)
    with pytest.raises(ValueError):
        provenance.sealed_join(spark.range(3), spark.createDataFrame([(0, 1)], "id long, label int"), "id")


def test_committed_outputs(spark, tmp_path):
    """Half-written, changed, enlarged and unrecorded outputs are refused, and so is a second run."""
    path = str(tmp_path / "out")
    df = spark.range(50).selectExpr("id", "id % 3 AS label").repartition(3)
    provenance.write_committed(df, path, lambda written: None)
    seal = provenance.manifest_digest(spark, path)
    assert provenance.read_committed(spark, path, seal).count() == 50
    with pytest.raises(FileExistsError):
        provenance.write_committed(df, path)
    with pytest.raises(ValueError, match="recorded"):
        provenance.read_committed(spark, path, "0" * 64)
    df.write.parquet(str(tmp_path / "half"))
    with pytest.raises(ValueError, match="no manifest"):
        provenance.read_committed(spark, str(tmp_path / "half"))

    def refuse(written):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        provenance.write_committed(df, str(tmp_path / "bad"), refuse)
    with pytest.raises(ValueError, match="no manifest"):
        provenance.read_committed(spark, str(tmp_path / "bad"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    whole = parts[0].read_bytes()
    (tmp_path / "out" / "part-extra.parquet").write_bytes(whole)
    with pytest.raises(ValueError, match="observed only"):
        provenance.read_committed(spark, path)
    (tmp_path / "out" / "part-extra.parquet").unlink()
    parts[0].unlink()
    with pytest.raises(ValueError, match="expected only"):
        provenance.read_committed(spark, path)
    for hidden in (tmp_path / "out").glob(".part-*"):
        hidden.unlink()
    parts[0].write_bytes(whole[:-5] + b"wrong")
    with pytest.raises(ValueError, match="differs"):
        provenance.read_committed(spark, path)
    provenance.write_committed(df.limit(0), str(tmp_path / "none"))
    assert provenance.read_committed(spark, str(tmp_path / "none")).count() == 0


def test_sidecars_and_requirements(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    digest = provenance.file_digests(spark, str(tmp_path / "t.csv")).first()["sha256"]
    (tmp_path / "t.sha256").write_text(f"{digest}  t.csv\n")
    (tmp_path / "bad.sha256").write_text("none\n")
    provenance.verify_sidecar(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.sha256"))
    with pytest.raises(ValueError, match="no digest"):
        provenance.verify_sidecar(spark, str(tmp_path / "t.csv"), str(tmp_path / "bad.sha256"))
    (tmp_path / "t.csv").write_text("a,b\n1,3\n")
    with pytest.raises(ValueError, match="differs"):
        provenance.verify_sidecar(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.sha256"))
    rows = spark.createDataFrame([("x", 1, False), ("x", 1, True), ("y", 0, False), ("y", 1, False)], "k string, f int, held boolean")
    contracts.require_columns(rows, ["k", "f"], "rows")
    with pytest.raises(ValueError, match="lacks columns"):
        contracts.require_columns(rows, ["k", "z"], "rows")
    fine = spark.createDataFrame([("x", 2), ("y", 2)], "k string, expected long")
    contracts.require_counts(rows, fine, "k", "classes")
    for bad in ([("x", 2), ("y", 3)], [("x", 2)], [("x", 2), ("y", 2), ("z", 1)]):
        with pytest.raises(ValueError, match="classes"):
            contracts.require_counts(rows, spark.createDataFrame(bad, "k string, expected long"), "k", "classes")
    contracts.require_positives(rows, ["k"], "f", 1)
    for least, held in ((2, None), (1, "held")):
        with pytest.raises(ValueError, match="positives"):
            contracts.require_positives(rows.where("k = 'y'"), ["k"], "f", least, held)
    assert [r[0] for r in spark.createDataFrame([(1.5,), (-0.25,), (0.0,)], "x double").select(prefix.signed(F.col("x"), 2)).collect()] == ["+1.50", "-0.25", "+0.00"]
    settings = spark.createDataFrame([(1, 0.5), (2, None)], "a int, t double")
    none = spark.createDataFrame([], "path string, sha256 string")
    seal = lambda df: contracts.freeze_record(none, df).first()["sha256"]
    assert seal(settings) == seal(settings.orderBy(F.desc("a")).repartition(3)) != seal(settings.na.fill(0.0)) and seal(settings) != seal(settings.union(settings))
    with pytest.raises(ValueError, match="no source rows"):
        shift.principal_components(spark.createDataFrame([([1.0],)], "z array<double>"), [], "z", F.lit(False))


def test_label_gate(spark, tmp_path):
    path, read = str(tmp_path / "pred"), []
    provenance.write_committed(spark.range(5).selectExpr("id", "id * 2 AS score"), path)
    seal = provenance.manifest_digest(spark, path)

    def labels():
        read.append(1)
        return spark.createDataFrame([(i, None if i == 2 else i % 2) for i in range(5)], "id long, label long")

    out = provenance.opened_labels(spark, {path: seal}, labels, "id", [str(tmp_path / "result")])[path]
    assert out.count() == 5 and out.where("label IS NULL").count() == 1 and out.columns == ["id", "score", "label"]
    problems = lambda: spark.createDataFrame([("model", "changed")], "name string, problem string")
    for seals, results, checks, kind in (({path: "0" * 64}, [], None, ValueError), ({path: seal}, [path], None, FileExistsError), ({path: seal}, [], problems, ValueError)):
        with pytest.raises(kind):
            provenance.opened_labels(spark, seals, labels, "id", results, checks)
    assert read == [1]
    with pytest.raises(ValueError, match="several"):
        provenance.sealed_join(spark.range(2), spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "id long, label long"), "id")


def png(width, height, colour=2, depth=8, cut=0, flip=None):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    data = images.PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 50)) + chunk(b"IEND", b"")
    data = data[: len(data) - cut]
    return data if flip is None else data[:flip] + bytes([data[flip] ^ 1]) + data[flip + 1 :]


def jpeg(width, height, parts=3, end=b"\xff\xd9", frame=0xC0):
    head = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0"
    return head + b"\xff\xff" + bytes([frame]) + struct.pack(">HBHHB", 8 + 3 * parts, 8, height, width, parts) + b"\1\x11\0" * parts + b"\xff\xda\0\x02data" + end


def test_image_properties(spark):
    cases = [
        (png(300, 200), ("PNG", 300, 200, "RGB", 3, None)), (png(1, 2, 6), ("PNG", 1, 2, "RGBA", 4, None)), (png(9, 9, 0, 1), ("PNG", 9, 9, "1", 1, None)), (png(9, 9, 3), ("PNG", 9, 9, "P", 1, None)),
        (png(0, 5), ("PNG", None, None, None, None, "bad header")), (png(3, 3, cut=5), ("PNG", None, None, None, None, "truncated")), (png(3, 3, flip=40), ("PNG", None, None, None, None, "checksum")),
        (jpeg(640, 480), ("JPEG", 640, 480, "RGB", 3, None)), (jpeg(7, 5, 1, frame=0xC2), ("JPEG", 7, 5, "L", 1, None)), (jpeg(7, 5, end=b""), ("JPEG", None, None, None, None, "truncated")),
        (jpeg(7, 5)[:30], ("JPEG", None, None, None, None, "truncated")), (b"\xff\xd8\xff\xd9\0\0\0\0", ("JPEG", None, None, None, None, "no header")), (b"\xff\xd8abcdef", ("JPEG", None, None, None, None, "no marker")),
        (b"GIF89a", (None, None, None, None, None, "unknown format")), (b"", (None, None, None, None, None, "empty")), (None, (None, None, None, None, None, "empty")),
    ]
    df = spark.createDataFrame([(i, c, "clash") for i, (c, _) in enumerate(cases)], "path int, content binary, mode string")
    got = images.inspected(df).orderBy("path")
    assert [tuple(r)[2:] for r in got.collect()] == [w for _, w in cases] and got.columns[:2] == ["path", "content"]
    problems = {r["path"]: r["problem"] for r in images.decode_problems(got, least=6).collect()}
    assert problems[1] == "mode RGBA" and problems[2] == "mode 1" and problems[8] == "mode L" and 0 not in problems and 7 not in problems and len(problems) == len(cases) - 2
    rng = np.random.default_rng(1)
    for data in (png(30, 20), jpeg(30, 20)):  # whatever the bytes, it doesn't raise
        for _ in range(300):
            at = int(rng.integers(len(data)))
            assert set(images.properties(data[:at] + bytes(rng.integers(0, 256, 3).tolist()) + data[at + 2 :])) == {"format", "width", "height", "mode", "channels", "error"}


def test_dct_hash(spark):
    """By the sums written out; small changes flip few bits, other pictures about half."""
    rng = np.random.default_rng(2)
    a, b = (np.cumsum(np.cumsum(rng.normal(size=(32, 32)), 0), 1) for _ in range(2))
    near = a + rng.normal(size=(32, 32)) * 0.01
    rows = [(i, x.ravel().tolist()) for i, x in enumerate((a, near, b))] + [(3, None), (4, [1.0])]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows, "id int, x array<double>").select("id", images.dct_hash("x").alias("h")).collect()}
    low = [sum(a[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    assert got[0] == f"{int(''.join('1' if x > np.median(low) else '0' for x in low), 2):016x}" and got[3] is None and got[4] is None
    apart = lambda i, j: (int(got[i], 16) ^ int(got[j], 16)).bit_count()
    assert apart(0, 1) <= 4 and apart(0, 2) > 10


def test_array_bundles(spark, tmp_path):
    """Ranges of rows of every kind of array, compressed or not, and back; the driver's frame is never built."""
    n = 2500
    rng = np.random.default_rng(1)
    data = {"features": rng.normal(size=(n, 5)).astype(np.float32), "logits": rng.normal(size=(n, 3)), "label": rng.integers(0, 9, n), "ok": rng.random(n) > 0.5, "path": np.array([f"p{i}é" for i in range(n)]), "small": rng.integers(0, 99, n).astype(">i2"), "seed": np.array(42)}
    np.savez(tmp_path / "a.npz", **data)
    np.savez_compressed(tmp_path / "b.npz", **data)
    for name in ("a", "b"):
        df = arrays.load_arrays(spark, str(tmp_path / f"{name}.npz"), partition_rows=700)
        assert df.rdd.getNumPartitions() == 4 and dict(df.dtypes)["features"] == "array<float>" and dict(df.dtypes)["seed"] == "bigint"
        got = df.orderBy("row").collect()
        assert [r["row"] for r in got] == list(range(n)) and all(np.array_equal([r[c] for r in got], data[c]) for c in data if c != "seed") and {r["seed"] for r in got} == {42}
    folder = str(tmp_path / "folder")
    written = arrays.save_arrays(df, folder, "row", rows=1000)
    assert [r["rows"] for r in written.collect()] == [1000, 1000, 500]
    back = arrays.load_arrays(spark, folder, key="place").orderBy("place").drop("place")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.orderBy("row").select(*back.columns).collect()]
    with np.load(tmp_path / "folder" / "part-00000002.npz") as last:
        assert last["features"].shape == (500, 5) and np.array_equal(last["logits"], data["logits"][2000:])
    with pytest.raises(FileExistsError):
        arrays.save_arrays(df, folder, "row")
    np.savez(tmp_path / "bad.npz", a=np.zeros(3), b=np.zeros(4))
    with pytest.raises(Exception, match="different lengths"):
        arrays.load_arrays(spark, str(tmp_path / "bad.npz")).count()


def test_heads_and_history(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(1, v.tolist(), int(v[0] + v[1] > 0)) for v in x], "seed int, x array<double>, failure int")
    heads = learn.train_heads(df, "seed", "x", "failure", learn.Recipe(epochs=40, rate=0.01))
    scored = learn.head_scores(df, heads, "seed", "x").select("failure", "head_score").toPandas()
    assert ((scored["head_score"] > 0.5) == scored["failure"]).mean() > 0.9
    with pytest.raises(ValueError, match="50 positives"):
        learn.train_heads(df.limit(60), "seed", "x", "failure")


def test_best_epoch(spark):
    histories = {1: [0.1, 0.3, 0.2, 0.3, 0.2, 0.9], 2: [0.5, None, float("nan"), 0.6, 0.7], 3: [None, None], 4: [0.2, 0.1, 0.1, 0.1, 0.3], 5: [0.1, 0.2, 0.3]}
    rows = [(s, e, m) for s, h in histories.items() for e, m in enumerate(h)]
    got = {tuple(r) for r in learn.best_epoch(spark.createDataFrame(rows, "seed int, epoch long, auprc double"), ["seed"], "epoch", "auprc", 3).collect()}
    assert got == {(1, 1, 0.3), (2, 4, 0.7), (3, None, None), (4, 0, 0.2), (5, 2, 0.3)}


def test_timed():
    ticks = []
    assert learn.timed(lambda: ticks.append(1), warm=2, runs=3) >= 0 and len(ticks) == 5


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = events.windowed_counts(src)
    assert spark.sql("SELECT start, event_type, n FROM windows").exceptAll(want.select("start", "event_type", "n")).count() == 0
    assert spark.table("windows").count() == want.count()
