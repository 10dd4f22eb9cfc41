"""Failure heads trained over partitions, a logistic reference, batch scoring, and timing."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.operators.metrics import ranking_metrics
from trustmill.operators.partial import as_numpy, grouped_sums

#: A group of more rows is trained in shards of about so many.
SHARD_ROWS = 50_000
#: Heads that are sent to every task at once.
HEADS_AT_ONCE = 200


@dataclass(frozen=True)
class Recipe:
    """How a head is trained: sizes and rates of the workload. raw: inputs aren't standardised."""

    hidden: int = 64
    dropout: float = 0.30
    batch: int = 64
    rate: float = 5e-4
    l2: float = 1e-4
    epochs: int = 30
    patience: int = 5
    cap: float = 5.0
    seed: int = 42
    raw: bool = False


def batch_scored(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The hook for any model: score turns a batch of rows into rows of schema; it travels once to each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield score(pdf)

    return df.mapInPandas(run, schema)


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Step-wise, over falling scores, tied ones together; nan without positives."""
    s, place = np.unique(-score, return_inverse=True)
    hits, n = np.bincount(place, y, len(s)), np.bincount(place, minlength=len(s))
    return float((hits * np.cumsum(hits) / np.cumsum(n)).sum() / y.sum()) if y.sum() else float("nan")


class Head:
    """One ReLU layer and a logistic output; weights with Adam's two moments and step count, as one flat vector."""

    def __init__(self, inputs: int, recipe: Recipe, state: np.ndarray | None = None, draw: np.random.Generator | None = None):
        h = recipe.hidden
        self.recipe, self.shapes = recipe, [(inputs, h), (h,), (h,), (1,)]
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        n = sum(self.sizes)
        if state is None:
            # uniform within one over the root of the number of inputs, weights and offsets alike
            state = np.zeros(3 * n + 1)
            state[:n] = np.concatenate([draw.uniform(-1, 1, size) / np.sqrt(fan) for size, fan in zip(self.sizes, (inputs, inputs, h, h), strict=True)])
        self.weights, self.first, self.second, self.steps = state[:n].copy(), state[n : 2 * n].copy(), state[2 * n : 3 * n].copy(), float(state[-1])

    def state(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.steps]])

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(self.sizes)[:-1]), self.shapes, strict=True)]

    def scores(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(self.weights)
        return 1 / (1 + np.exp(-(np.maximum(z @ w1 + b1, 0) @ w2 + b2)))

    def step(self, z: np.ndarray, y: np.ndarray, positive: float, kept: np.ndarray) -> None:
        """One step of Adam on the mean weighted cross-entropy of a batch, plus the penalty on the hidden weights; kept: the
        hidden units that aren't dropped, for each row."""
        w1, b1, w2, b2 = self.parts(self.weights)
        a = z @ w1 + b1
        scale = kept / (1 - self.recipe.dropout)
        h = np.maximum(a, 0) * scale
        p = 1 / (1 + np.exp(-(h @ w2 + b2)))
        e = (p - y) * np.where(y == 1, positive, 1.0) / len(y)
        dh = np.outer(e, w2) * scale * (a > 0)
        g = np.concatenate([(z.T @ dh + 2 * self.recipe.l2 * w1).ravel(), dh.sum(0), h.T @ e, [e.sum()]])
        self.steps += 1
        self.first += 0.1 * (g - self.first)
        self.second += 0.001 * (g * g - self.second)
        self.weights -= self.recipe.rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)

    def epoch(self, z: np.ndarray, y: np.ndarray, positive: float, draw: np.random.Generator) -> None:
        """All rows once, in batches of the recipe's size and a rest."""
        order = draw.permutation(len(y))
        for i in range(0, len(y), self.recipe.batch):
            rows = order[i : i + self.recipe.batch]
            self.step(z[rows], y[rows], positive, draw.random((len(rows), self.recipe.hidden)) >= self.recipe.dropout)


def _draw(recipe: Recipe, group: object, *more: int) -> np.random.Generator:
    return np.random.default_rng([recipe.seed, zlib.crc32(str(group).encode()), *more])


def _trained(group: object, x: np.ndarray, y: np.ndarray, held: np.ndarray, positive: float, recipe: Recipe) -> tuple[np.ndarray, int]:
    """(state, epochs used) of a head on rows that fit one shard; with held rows, of the epoch that is best on them, the
    first of equal ones, ending after so many epochs without a better one."""
    head = Head(x.shape[1], recipe, draw=_draw(recipe, group))
    best, kept, kept_at = -np.inf, None, recipe.epochs
    for epoch in range(1, recipe.epochs + 1):
        head.epoch(x[~held], y[~held], positive, _draw(recipe, group, epoch, 0))
        if held.any():
            now = average_precision(y[held], head.scores(x[held]))
            if now > best:
                best, kept, kept_at = now, head.state(), epoch
            elif epoch - kept_at >= recipe.patience:
                break
    return (head.state() if kept is None else kept), kept_at


HEAD = "mean array<double>, std array<double>, state array<double>, epochs_used long"


def moments(rows: DataFrame, by: str, x: str) -> dict:
    """Group -> (mean, population standard deviation, 1 where it is tiny) of an array column, in two passes."""
    first = grouped_sums(rows, by, [x], lambda g, a: np.append(a.sum(0), len(a)))
    mean = {g: v[:-1] / v[-1] for g, v in first.items()}
    second = grouped_sums(rows, by, [x], lambda g, a: ((a - mean[g]) ** 2).sum(0))
    std = {g: np.sqrt(second[g] / first[g][-1]) for g in mean}
    return {g: (mean[g], np.where(std[g] < 1e-6, 1.0, std[g])) for g in mean}


def train_heads(df: DataFrame, by: str, features: str, failure: str, recipe: Recipe = Recipe(), min_positives: int = 50, checked: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(by, mean, std, state, epochs_used): one head per group, of any number of rows.

    A group of at most shard_rows rows is trained as it is, in one task. A larger one is dealt into shards; in each epoch
    every shard goes through its rows in batches, from the same weights, and weights and moments are then averaged, by
    rows; they travel in a table, one row per group. Inputs are standardised by the rows trained on, if not raw. Rows where
    the flag `checked` holds aren't trained on, but tell which epoch is kept, by average precision. Rows without group,
    features or failure are left out; a group with fewer positives than min_positives to train on, or without one to
    check on, is an error.
    """
    kind = df.schema[by].dataType.simpleString()
    flag = F.coalesce(F.col(checked), F.lit(False)) if checked else F.lit(False)
    rows = df.select(F.col(by).alias("by"), F.col(features).cast("array<double>").alias("x"), F.col(failure).cast("double").alias("y"), flag.alias("held"))
    rows = saved(rows.where("by IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("_n", F.monotonically_increasing_id()))
    counts = saved(rows.groupBy("by").agg(F.count("*").alias("rows"), F.count_if(F.expr("NOT held AND y = 1")).alias("positives"), F.count_if(F.expr("NOT held AND y = 0")).alias("negatives"), F.count_if(F.expr("held AND y = 1")).alias("to_check")))
    poor = counts.where((F.col("positives") < min_positives) | (F.lit(checked is not None) & (F.col("to_check") == 0))).limit(5).collect()
    if poor:
        raise ValueError(f"{min_positives} positives are needed to train on, and one to check on: {[r.asDict() for r in poor]}")
    plain = {} if recipe.raw else moments(rows.where("NOT held"), "by", "x")
    shards = F.ceil(F.col("rows") / shard_rows)
    weight = F.least(F.lit(recipe.cap), F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))
    dealt = rows.join(counts.select("by", shards.alias("shards"), weight.alias("positive")), "by")
    dealt = saved(dealt.withColumn("shard", F.when(F.col("held"), 0).otherwise(F.pmod("_n", "shards"))))

    def scaled(group, x: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack(x.to_numpy()).astype(float)
        mean, std = plain.get(group, (np.zeros(x.shape[1]), np.ones(x.shape[1])))
        return (x - mean) / std, mean, std

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        # in an order of their own, so that batches don't depend on how rows arrive
        pdf = pdf.iloc[np.lexsort([pdf["y"].to_numpy(), *np.stack(pdf["x"].to_numpy()).T[::-1]])]
        group = pdf["by"].iloc[0]
        z, mean, std = scaled(group, pdf["x"])
        state, used = _trained(group, z, pdf["y"].to_numpy(), pdf["held"].to_numpy().astype(bool), pdf["positive"].iloc[0], recipe)
        return pd.DataFrame([{"by": group, "mean": mean, "std": std, "state": state, "epochs_used": used}])

    small = dealt.where("shards = 1").groupBy("by").applyInPandas(whole, f"by {kind}, {HEAD}")
    large = dealt.where("shards > 1")
    heads = saved(small)
    if not large.isEmpty():
        heads = heads.unionByName(_in_rounds(large, kind, recipe, scaled, checked is not None))
    return heads.withColumnRenamed("by", by)


def _in_rounds(rows: DataFrame, kind: str, recipe: Recipe, scaled, stops: bool) -> DataFrame:
    """Heads of groups in several shards: one job an epoch, which averages what the shards have learned."""
    shards = saved(rows.select("by", "shards").distinct())
    states = None

    def one(epoch: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({"by": [], "n": [], "mean": [], "std": [], "state": []})
            pdf = pdf.sort_values("_n")
            group, shard = pdf["by"].iloc[0], int(pdf["shard"].iloc[0])
            z, mean, std = scaled(group, pdf["x"])
            head = Head(z.shape[1], recipe, np.asarray(states["state"].iloc[0]) if len(states) else None, _draw(recipe, group))
            head.epoch(z, pdf["y"].to_numpy(), pdf["positive"].iloc[0], _draw(recipe, group, epoch, shard))
            return pd.DataFrame([{"by": group, "n": len(z), "mean": mean, "std": std, "state": head.state()}])

        return run

    trained = rows.where("NOT held")
    best = None
    for epoch in range(1, recipe.epochs + 1):
        sent = (states if states is not None else shards.select("by", F.lit(None).cast("array<double>").alias("state")).limit(0)).select("by", "state").join(shards, "by")
        sent = sent.select("by", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "state")
        work = trained.groupBy("by", "shard").cogroup(sent.groupBy("by", "shard"))
        own = work.applyInPandas(one(epoch), f"by {kind}, n long, mean array<double>, std array<double>, state array<double>")
        states = saved(_averaged(saved(own)).withColumn("epochs_used", F.lit(epoch).cast("long")))
        if not stops:
            continue
        now = ranking_metrics(head_scores(rows.where("held"), states, "by", "x", "score").select("by", F.col("y").cast("int").alias("error"), "score"), ["by"]).select("by", "auprc")
        now = states.join(now, "by")
        if best is not None:
            was = best.select("by", F.struct(*[F.col(c).alias(c) for c in now.columns[1:]]).alias("_was"))
            better = F.col("_was").isNull() | (F.col("auprc") > F.col("_was.auprc"))
            now = was.join(now, "by", "left").select("by", *[F.when(better & F.col("state").isNotNull(), F.col(c)).otherwise(F.col(f"_was.{c}")).alias(c) for c in now.columns[1:]])
        best = saved(now)
        # a group stops when its best epoch is too long ago
        going = best.where(F.lit(epoch) - F.col("epochs_used") < recipe.patience).select("by")
        trained, states = trained.join(going, "by", "left_semi"), saved(states.join(going, "by", "left_semi"))
        if states.isEmpty():
            break
    out = best if stops else states
    return out.select("by", "mean", "std", "state", "epochs_used")


def _averaged(own: DataFrame) -> DataFrame:
    """(by, mean, std, state): states of shards averaged place by place, weighted by rows."""
    mixed = own.select("by", "n", F.posexplode("state").alias("at", "v")).groupBy("by", "at").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
    mixed = mixed.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("state"))
    return own.groupBy("by").agg(F.first("mean").alias("mean"), F.first("std").alias("std")).join(mixed, "by")


def _hidden_units(state: int, inputs: int) -> int:
    """From the length of a state: three times (inputs + 2) h + 1, and one."""
    return ((state - 1) // 3 - 1) // (inputs + 2)


def head_scores(df: DataFrame, heads: DataFrame, by: str, features: str, out: str = "head_score", keep_epochs: bool = False) -> DataFrame:
    """df plus the score of its group's head; rows of groups without one, or without features, are left out. With
    keep_epochs, also plus epochs_used. Heads are sent to all tasks HEADS_AT_ONCE at a time, never with the rows."""
    many = heads.count()
    slices = max(1, -(-many // HEADS_AT_ONCE))
    of = F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(slices))
    return reduce(DataFrame.unionByName, [_scored(df.where(of == i), heads.where(of == i), by, features, out, keep_epochs) for i in range(slices)])


def _scored(df: DataFrame, heads: DataFrame, by: str, features: str, out: str, keep_epochs: bool) -> DataFrame:
    held = {str(r[by]): (np.array(r["mean"]), np.array(r["std"]), np.array(r["state"]), r["epochs_used"]) for r in heads.collect()}
    sent = df.sparkSession.sparkContext.broadcast(held)

    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, x in batches:
            names, score = np.array(groups.to_pylist(), object), np.full(len(groups), np.nan)
            there = np.array([n in sent.value for n in names], bool) & ~x.is_null().to_numpy(zero_copy_only=False)
            for g in dict.fromkeys(names[there]):
                mean, std, state, _ = sent.value[g]
                own = there & (names == g)
                head = Head(len(mean), Recipe(hidden=_hidden_units(len(state), len(mean))), state)
                score[own] = head.scores((as_numpy(x.filter(pa.array(own))) - mean) / std)
            yield pa.array(score, mask=~there)

    scored = df.withColumn(out, F.arrow_udf(score, "double").asNondeterministic()(F.col(by).cast("string"), F.col(features).cast("array<double>"))).where(F.col(out).isNotNull())
    if keep_epochs:
        scored = scored.join(heads.select(by, "epochs_used"), by)
    return scored


#: Recipes of head_grid: whether inputs stay raw, and whether the held rows tell when to stop (else all epochs are used).
RECIPES = {"raw, stopped early": (True, True), "standardised, all epochs": (False, False)}


def head_grid(df: DataFrame, by: str, keys: list[str], inputs: dict[str, Column | str], failure: str, held: str, recipe: Recipe = Recipe(), **settings) -> DataFrame:
    """(by, keys, failure, inputs, recipe, epochs_used, score) of the held rows: a head for every group, every set of
    inputs (name -> array column) and every recipe, each trained on the group's other rows."""
    rows = df.select(by, *keys, failure, F.coalesce(F.col(held), F.lit(False)).alias("_held"), F.inline(F.array(*[F.struct(F.lit(n).alias("inputs"), (F.col(c) if isinstance(c, str) else c).cast("array<double>").alias("_x")) for n, c in inputs.items()])))
    rows = rows.withColumn("_key", F.concat_ws("|", F.col(by).cast("string"), "inputs"))
    out = []
    for name, (raw, stopped) in RECIPES.items():
        own = rows if stopped else rows.where("NOT _held")
        heads = train_heads(own, "_key", "_x", failure, Recipe(**{**recipe.__dict__, "raw": raw}), checked="_held" if stopped else None, **settings)
        scored = head_scores(rows.where("_held"), heads, "_key", "_x", "score", keep_epochs=True)
        out.append(scored.select(by, *keys, failure, "inputs", F.lit(name).alias("recipe"), "epochs_used", "score"))
    return reduce(DataFrame.unionByName, out)


def logistic_models(df: DataFrame, by: str, features: str, failure: str, c: float = 1.0, cap: float = 5.0, steps: int = 60) -> DataFrame:
    """(by, mean, std, weights): for every group a logistic regression on standardised features, its intercept first and
    unpenalised, of least half squared weights plus c times the summed loss, in which failures count min(cap, negatives /
    positives). Newton's method for all groups at once: a pass sums gradients and second derivatives of each group per
    partition; where the loss would rise, the step is halved. Rows without group, features or label are left out."""
    rows = df.select(F.col(by).alias("by"), F.col(features).cast("array<double>").alias("x"), F.col(failure).cast("double").alias("y"))
    rows = saved(rows.where("by IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"))
    scale = moments(rows, "by", "x")
    counts = grouped_sums(rows, "by", ["y"], lambda g, y: np.array([(y == 0).sum(), (y == 1).sum()], float))
    weight = {g: min(cap, n[0] / max(n[1], 1.0)) for g, n in counts.items()}
    w = {g: np.zeros(len(m[0]) + 1) for g, m in scale.items()}

    def pass_over(at: dict) -> dict:
        """Group -> (loss, gradient, second derivatives) at its weights."""

        def sums(g, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(y)), (x - scale[g][0]) / scale[g][1]])
            f, s = z @ at[g], c * np.where(y == 1, weight[g], 1.0)
            p = 1 / (1 + np.exp(-f))
            return np.concatenate([[(s * (np.logaddexp(0, f) - y * f)).sum()], z.T @ (s * (p - y)), ((z * (s * p * (1 - p))[:, None]).T @ z).ravel()])

        some = grouped_sums(rows.where(F.col("by").isin(list(at))), "by", ["x", "y"], sums)
        out = {}
        for g, v in some.items():
            d, own = len(at[g]), at[g]
            keep = np.append(0.0, np.ones(d - 1))
            out[g] = v[0] + (keep * own * own).sum() / 2, v[1 : d + 1] + keep * own, v[d + 1 :].reshape(d, d) + np.diag(keep)
        return out

    state = pass_over(w)
    moving = {g: -np.linalg.lstsq(h, grad, rcond=None)[0] for g, (_, grad, h) in state.items()}
    for _ in range(steps):
        moving = {g: step for g, step in moving.items() if np.abs(step).max() > 1e-10}
        if not moving:
            break
        tried = pass_over({g: w[g] + step for g, step in moving.items()})
        for g, now in tried.items():
            if now[0] <= state[g][0] + 1e-9 * abs(state[g][0]):
                w[g], state[g] = w[g] + moving[g], now
                moving[g] = -np.linalg.lstsq(now[2], now[1], rcond=None)[0]
            else:
                moving[g] = moving[g] / 2
    kind = df.schema[by].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, scale[g][0].tolist(), scale[g][1].tolist(), w[g].tolist()) for g in w], f"{by} {kind}, mean array<double>, std array<double>, weights array<double>")


def logistic_scores(df: DataFrame, models: DataFrame, by: str, features: str, out: str = "score") -> DataFrame:
    """df plus the probability that its group's model gives; rows of groups without one are left out."""
    joined = df.join(models, by)
    z = F.zip_with(F.zip_with(F.col(features), F.col("mean"), lambda x, m: x.cast("double") - m), F.col("std"), lambda x, s: x / s)
    f = F.aggregate(F.zip_with(z, F.slice("weights", 2, F.size("weights") - 1), lambda a, b: a * b), F.get("weights", F.lit(0)), lambda acc, x: acc + x)
    return joined.withColumn(out, 1 / (1 + F.exp(-f))).drop("mean", "std", "weights")


def best_epoch(history: DataFrame, by: list[str], epoch: str, metric: str, patience: int) -> DataFrame:
    """(by, best_epoch, best): where early stopping with strict improvement would have kept the model. Missing values
    never improve; a group whose values all are missing has null ones."""
    value = F.when(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    up = Window.partitionBy(*by).orderBy(epoch)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    rows = history.select(*by, F.col(epoch).alias("_e"), value.alias("_v"), F.max(value).over(before).alias("_top"), F.row_number().over(up).alias("_i"))
    better = F.col("_v").isNotNull() & (F.col("_top").isNull() | (F.col("_v") > F.col("_top")))
    up, so_far = Window.partitionBy(*by).orderBy("_i"), Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_better": better, "_last": F.coalesce(F.max(F.when(better, F.col("_i"))).over(so_far), F.lit(0))})
    rows = rows.withColumn("_over", F.max(F.when(F.col("_i") - F.col("_last") >= patience, 1).otherwise(0)).over(so_far))
    kept = F.max_by(F.struct(F.col("_e").alias("e"), F.col("_v").alias("v")), F.when(F.col("_better") & (F.col("_over") == 0), F.col("_i")))
    return rows.groupBy(*by).agg(kept.alias("_k")).select(*by, F.col("_k.e").alias("best_epoch"), F.col("_k.v").alias("best"))


def timed(run: Callable[[], object], warm: int = 1, runs: int = 3) -> float:
    """Median seconds of runs calls after warm calls."""
    for _ in range(warm):
        run()
    spans = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        spans.append(time.perf_counter() - start)
    return median(spans)
