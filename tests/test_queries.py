import inspect
import zlib

import numpy as np
import pytest
from conftest import rows_of

from trustmill.operators import audit, calibration, contracts, learn, resample, splits
from trustmill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize(("name", "joins"), [("near_duplicate_pairs", 0), ("distance_sweep", 2), ("review_queue", 1)])
def test_pairs_take_their_labels_along(spark, name, joins):
    """Pairs are not joined with hashes, keys and labels, and not found again for their reviews."""
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == joins and plan.count("FlatMapGroupsInArrow") == (name == "near_duplicate_pairs")


def test_review_sheet_numbers_saved_pairs(spark, monkeypatch):
    """Ranges are sampled before rows are dealt; pairs are not found twice for that."""
    seen = []
    numbered = audit.numbered
    monkeypatch.setattr(audit, "numbered", lambda pairs, *more: seen.append(pairs) or numbered(pairs, *more))
    catalog.review_sheet(spark, DIR)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan


def vectors(spark):
    rows = catalog.logits(spark, DIR).orderBy("vec_id").collect()
    z = np.array([r["logits"] for r in rows])
    y, seed = (np.array([r[c] for r in rows]) for c in ("label", "seed"))
    return rows, z, y, seed


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_temperature_bootstrap_equals_plain_search(spark, block_rows):
    """Every resample's draws written out, each optimum by trying many values of 1/T; in one block and in many."""
    _, z, y, seed = vectors(spark)
    some = calibration.temperature_intervals(catalog.logits(spark, DIR), "seed", resamples=6, block_rows=block_rows)
    got = {r["seed"]: r for r in some.collect()}
    assert len(got) == 3
    for s in sorted(set(seed.tolist())):
        own, true = z[seed == s], y[seed == s]
        order = np.array(sorted(range(len(true)), key=lambda i: (*own[i], true[i])))
        own, true, n = own[order], true[order], len(true)
        weights = np.hstack([calibration.block_weights(s, n, 6, 2026, block_rows, b) for b in range(-(-n // block_rows))])
        assert weights.shape == (6, n) and (weights.sum(1) == n).all() and weights.min() == 0
        grid = np.linspace(0.05, 20, 40_001)
        each = np.array([np.log(np.exp(b * (own - own.max(1, keepdims=True))).sum(1)) + b * (own.max(1) - own[np.arange(n), true]) for b in grid])
        fits = [1 / grid[(each @ w).argmin()] for w in weights]
        assert np.allclose([got[s]["interval_low"], got[s]["interval_high"]], np.percentile(fits, [2.5, 97.5]), rtol=1e-2, atol=1e-3)
        assert np.isclose(got[s]["temperature"], 1 / grid[each.sum(1).argmin()], rtol=1e-2)


def test_resampled_optima_are_exact():
    """Roots by interpolation equal a long bisection on the weighted slopes."""
    rng = np.random.default_rng(4)
    z, y, w = rng.normal(size=(80, 5)) * 2, rng.integers(0, 5, 80), rng.integers(0, 4, (9, 80)).astype(float)
    y[:60] = z[:60].argmax(1)
    nodes = np.geomspace(0.3, 9, calibration.NODES)
    got = calibration._roots(nodes, w @ calibration._slopes(z, y, nodes))
    for g, own in zip(got, w, strict=True):
        low, high = 0.05, 20.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (own @ calibration._slopes(z, y, np.array([middle])))[0] < 0 else (low, middle)
        assert np.isclose(g, low, rtol=1e-8)


def test_draws_are_even():
    """Over many resamples each row is drawn once on average, with the variance of draws with replacement, across blocks too."""
    w = np.hstack([calibration.block_weights("g", 100, 20_000, 1, 13, b) for b in range(8)])
    assert (w.sum(1) == 100).all() and np.abs(w.mean(0) - 1).max() < 0.05 and np.abs(w.var(0) - 0.99).max() < 0.06
    assert np.abs(np.corrcoef(w[:, 0], w[:, 99])[0, 1] + 1 / 99) < 0.03


def test_logistic_is_at_the_optimum(spark):
    """The gradient of the penalised loss, failures weighted by min(5, negatives / positives), is zero for each seed."""
    _, z, y, seed = vectors(spark)
    fail = np.array([float(r["pred"] != r["label"]) for r in vectors(spark)[0]])
    out = catalog.failure_logistic(spark, DIR).orderBy("seed", "term").collect()
    for s in (0, 1, 2):
        w = np.array([r["weight"] for r in out if r["seed"] == s])
        own, true = z[seed == s], fail[seed == s]
        x = np.column_stack([np.ones(len(own)), (own - own.mean(0)) / own.std(0)])
        weight = np.where(true == 1, min(5, (true == 0).sum() / (true == 1).sum()), 1.0)
        gradient = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - true)) + np.append(0, w[1:])
        assert len(w) == z.shape[1] + 1 and np.abs(gradient).max() < 1e-6


def test_logistic_of_odd_rows(spark):
    rows = [(1, [float(i), 2.0], i % 3 == 0) for i in range(40)] + [(1, None, True), (1, [1.0, 2.0], None), (None, [1.0, 1.0], True), (2, [1.0, 5.0], False), (2, [2.0, 5.0], False)]
    df = spark.createDataFrame([(g, x, None if y is None else int(y)) for g, x, y in rows], "g int, x array<double>, y int")
    models = learn.logistic_models(df, "g", "x", "y")
    got = {r["g"]: r for r in models.collect()}
    assert set(got) == {1, 2} and got[1]["weights"][2] == 0 and got[2]["weights"][0] < -5
    scores = learn.logistic_scores(df.where("x IS NOT NULL"), models, "g", "x").collect()
    assert len(scores) == 43 and all(0 <= r["score"] <= 1 for r in scores)


def test_principal_components_equal_svd(spark):
    rows = catalog.table(spark, DIR, "embeddings").orderBy("vec_id").collect()
    x, source = np.array([r["embedding"] for r in rows], float), np.array([r["label"] < 5 for r in rows])
    u = np.linalg.svd(x[source] - x[source].mean(0), full_matrices=False)[2][:2]
    got = np.array([[r["pc1"], r["pc2"]] for r in catalog.principal_components(spark, DIR).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x[source].mean(0)) @ u.T), atol=1e-6)


def test_group_splits_of_orders(spark):
    """Whole groups once each, and sums as near to the quotas as the groups allow."""
    orders = catalog.table(spark, DIR, "orders").toPandas()
    groups = orders.groupby("o_custkey").agg(label=("o_orderpriority", "min"), size=("o_orderkey", "count")).reset_index()
    greedy = catalog.greedy_group_split(spark, DIR).toPandas()
    assert sorted(greedy["o_custkey"].astype(int)) == sorted(groups["o_custkey"]) and set(greedy["subset"]) == set(catalog.PARTS)
    for label, own in greedy.groupby("label"):
        total = groups.loc[groups["label"] == label, "size"].sum()
        for part, share in catalog.PARTS.items():
            assert abs(own.loc[own["subset"] == part, "size"].sum() - total * share) <= own["size"].max() + 1
    second = catalog.secondary_split(spark, DIR).toPandas()
    assert sorted(second["o_custkey"].astype(int)) == sorted(groups["o_custkey"])
    exact = groups.groupby("label")["size"].sum() * 0.2
    val = second[second["part"] == "val"].groupby("label")["size"].sum()
    assert (abs(val - exact) <= 1).all() and abs(val.sum() - round(exact.sum())) == 0  # small groups reach any sum


def test_paired_bootstrap_equals_plain_loop(spark):
    docs = catalog.judged_documents(spark, DIR)
    pdf = docs.toPandas()
    names = sorted(pdf["source"].unique())
    rng = np.random.default_rng(5)
    want, weights = [], []
    for r in range(4):
        pick = [names[i] for i in rng.integers(0, len(names), len(names))]
        weights += [(r, c, pick.count(c)) for c in set(pick)]
        rows = np.concatenate([np.flatnonzero(pdf["source"] == c) for c in pick])
        error, score = pdf["error"].to_numpy()[rows].astype(float), pdf["score"].to_numpy()[rows]
        total, b, n0 = 0.0, 0.0, 0
        for s in np.unique(score):
            g, sz = error[score == s].sum(), (score == s).sum()
            total += sum((b + j / sz * g) / (n0 + j) for j in range(1, sz + 1))
            b, n0 = b + g, n0 + sz
        want.append(total / n0)
    reps = resample.replicates(docs, spark.createDataFrame(weights, "resample int, source string, weight long"), [], "source").orderBy("resample").collect()
    assert np.allclose([r["aurc"] for r in reps], want, atol=1e-12)


def plain_head(group, shards, held, positive, recipe):
    """(weights by epoch, average precision by epoch on held) of a loop over batches, all shards averaged after each
    epoch; written out with matrices of its own."""
    h, d = recipe.hidden, shards[0][0].shape[1]
    crc = zlib.crc32(str(group).encode())
    first = np.random.default_rng([recipe.seed, crc])
    w = [first.uniform(-1, 1, d * h).reshape(d, h) / d**0.5, first.uniform(-1, 1, h) / d**0.5, first.uniform(-1, 1, h) / h**0.5, first.uniform(-1, 1, 1) / h**0.5]
    m, v, t = [0 * a for a in w], [0 * a for a in w], 0
    states, marks = [], []
    for epoch in range(1, recipe.epochs + 1):
        ends = []
        for k, (x, y) in enumerate(shards):
            own, mm, vv, tt = [a.copy() for a in w], [a.copy() for a in m], [a.copy() for a in v], t
            draw = np.random.default_rng([recipe.seed, crc, epoch, k])
            order = draw.permutation(len(y))
            while len(order):
                rows, order = order[: recipe.batch], order[recipe.batch :]
                kept = draw.random((len(rows), h)) >= recipe.dropout
                before = x[rows] @ own[0] + own[1]
                hidden = np.where(before > 0, before, 0) * kept / (1 - recipe.dropout)
                p = 1 / (1 + np.exp(-(hidden @ own[2] + own[3])))
                e = (p - y[rows]) * np.where(y[rows] > 0, positive, 1) / len(rows)
                back = e[:, None] * own[2][None] * kept / (1 - recipe.dropout) * (before > 0)
                tt += 1
                for i, g in enumerate([x[rows].T @ back + 2 * recipe.l2 * own[0], back.sum(0), hidden.T @ e, e.sum(keepdims=True)]):
                    mm[i], vv[i] = 0.9 * mm[i] + 0.1 * g, 0.999 * vv[i] + 0.001 * g**2
                    own[i] = own[i] - recipe.rate * mm[i] / (1 - 0.9**tt) / ((vv[i] / (1 - 0.999**tt)) ** 0.5 + 1e-8)
            ends.append((len(y), own, mm, vv, tt))
        total = sum(e[0] for e in ends)
        mean = lambda j: [sum(e[0] * e[j][i] for e in ends) / total for i in range(4)]
        w, m, v, t = mean(1), mean(2), mean(3), sum(e[0] * e[4] for e in ends) / total
        states.append([a.copy() for a in w])
        if held is not None:
            score = 1 / (1 + np.exp(-(np.maximum(held[0] @ w[0] + w[1], 0) @ w[2] + w[3])))
            marks.append(learn.average_precision(held[1], score))
    return states, marks


def best_of(marks, patience):
    best, at = -np.inf, 0
    for e, x in enumerate(marks, 1):
        if x > best:
            best, at = x, e
        elif e - at >= patience:
            break
    return at


def head_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(2, 3, size=(n, 5))
    y = (x[:, 0] + rng.normal(size=n) * 2 > 3).astype(int)
    held = np.arange(n) % 4 == 0
    df = spark.createDataFrame([(7, v.tolist(), int(f), bool(k)) for v, f, k in zip(x, y, held, strict=True)], "g int, x array<double>, y int, held boolean").coalesce(1)
    return x, y.astype(float), held, df


@pytest.mark.parametrize(("shard_rows", "raw", "checked"), [(10_000, False, None), (10_000, True, "held"), (200, False, None), (200, True, "held")])
def test_heads_equal_a_plain_loop(spark, shard_rows, raw, checked):
    """A group in one piece and one in three shards; with and without early stopping."""
    x, y, held, df = head_rows(spark, 600, 3)
    recipe = learn.Recipe(hidden=6, epochs=9, rate=0.03, patience=2, raw=raw)
    head = learn.train_heads(df, "g", "x", "y", recipe, checked=checked, shard_rows=shard_rows).collect()
    train = ~held if checked else np.ones(600, bool)
    mean, std = (x[train].mean(0), x[train].std(0)) if not raw else (np.zeros(5), np.ones(5))
    z = (x - mean) / std
    if shard_rows == 10_000:
        order = np.lexsort([y, *x.T[::-1]])
        order = order[train[order]]
        shards = [(z[order], y[order])]
    else:
        shards = [(z[(np.arange(600) % 3 == k) & train], y[(np.arange(600) % 3 == k) & train]) for k in range(3)]
    positive = min(5, (y[train] == 0).sum() / (y[train] == 1).sum())
    states, marks = plain_head(7, shards, (z[held], y[held]) if checked else None, positive, recipe)
    at = best_of(marks, recipe.patience) if checked else recipe.epochs
    assert len(head) == 1 and head[0]["epochs_used"] == at
    got = learn.Head(5, recipe, np.array(head[0]["state"]))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got.parts(got.weights), states[at - 1], strict=True))
    assert np.allclose(head[0]["mean"], mean) and np.allclose(head[0]["std"], std)
    scored = learn.head_scores(df.union(df.limit(1).selectExpr("99", "x", "y", "held")), spark.createDataFrame(head), "g", "x", keep_epochs=True).collect()
    assert len(scored) == 600 and {r["epochs_used"] for r in scored} == {at}


def test_heads_in_slices(spark, monkeypatch):
    """More heads than are sent at once give the same scores."""
    rows = [(g, [float(i), float(g)], i % 2) for g in range(7) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, x array<double>, y int")
    heads = learn.train_heads(df, "g", "x", "y", learn.Recipe(hidden=3, epochs=2), min_positives=1)
    score = lambda: sorted((r["g"], r["x"][0], r["head_score"]) for r in learn.head_scores(df, heads, "g", "x").collect())
    whole = score()
    monkeypatch.setattr(learn, "HEADS_AT_ONCE", 2)
    assert score() == whole and len(whole) == len(rows)


def test_failure_grid_judges_held_rows_by_every_method(spark):
    rows, z, y, seed = vectors(spark)
    ids = np.array([r["vec_id"] for r in rows])
    held = ids % 5 == 0
    fail = np.array([float(r["pred"] != r["label"]) for r in rows])
    got = {(r["seed"], r["method"], r["inputs"], r["recipe"]): r for r in catalog.failure_grid(spark, DIR).collect()}
    assert len(got) == 3 * (3 + 1 + 3 * 2)
    picks = {}
    for r in catalog.resample.draws(spark.createDataFrame([(int(i),) for i in sorted(set(ids[held] // 30))], "original long"), "original", 500, seed=12345).collect():
        picks.setdefault(r["resample"], []).extend([r["original"]] * r["weight"])
    for s in (0, 1, 2):
        check = (seed == s) & held
        msp = 1 - (np.exp(z) / np.exp(z).sum(1, keepdims=True)).max(1)
        assert np.isclose(got[s, "msp", "logits", "none"]["auprc"], learn.average_precision(fail[check], msp[check]), equal_nan=True)
        values = []
        for pick in picks.values():
            some = np.concatenate([np.flatnonzero(check & (ids // 30 == o)) for o in pick]) if pick else np.zeros(0, int)
            if 0 < fail[some].sum() < len(some):
                values.append(learn.average_precision(fail[some], msp[some]))
        assert np.allclose([got[s, "msp", "logits", "none"][f"auprc_{k}"] for k in ("low", "high")], np.percentile(values, [2.5, 97.5]))
        for recipe, (raw, stopped) in learn.RECIPES.items():
            r = got[s, "head", "logits", recipe]
            assert r["n"] == check.sum() and r["errors"] == fail[check].sum() and 1 <= r["epochs_used"] <= 30 and r["auprc_low"] <= r["auprc"] <= r["auprc_high"]
            assert stopped or r["epochs_used"] == 30


def test_heads_have_the_size_of_the_workload():
    r = learn.Recipe()
    assert (r.hidden, r.dropout, r.batch, r.rate, r.l2, r.epochs, r.patience, r.cap) == (64, 0.30, 64, 5e-4, 1e-4, 30, 5, 5.0)
    assert inspect.signature(learn.train_heads).parameters["min_positives"].default == 50


def test_contract_gates(spark):
    with pytest.raises(ValueError, match="sums: {'bad': 2}"):
        contracts.require_zero(spark.sql("SELECT 0 AS fine, 2 AS bad"), "sums")
    contracts.require_zero(spark.sql("SELECT 0 AS fine"), "sums")
    with pytest.raises(ValueError):
        contracts.require_none(spark.range(1), "rows")
    contracts.require_none(spark.range(0), "rows")


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "function", "parameter", "value"),
    [
        ("temperature_bootstrap", calibration, "temperature_intervals", "resamples", 500),
        ("bootstrap_interval", resample, "draws", "resamples", 2000),
        ("paired_bootstrap", resample, "draws", "resamples", 2000),
        ("failure_head", learn, "train_heads", "recipe", learn.Recipe()),
    ],
)
def test_whole_job(spark, monkeypatch, name, module, function, parameter, value):
    """The query runs the operator at the reference's size."""
    signature = inspect.signature(getattr(module, function))

    def seen(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments[parameter])

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(Called) as e:
        catalog.QUERIES[name](spark, DIR)
    assert e.value.args == (value,)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
