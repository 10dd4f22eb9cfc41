"""Reliability and classification metrics, grouped by any keys.

Ranking metrics take an error flag (1 = wrong) and a score (higher = less trustworthy). Tied scores count as all their
orders averaged, so results don't depend on row order. Rows may have integer weights (column `weight`). Undefined
metrics are null. Rows with a null score or error are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions import scores as S
from trustmill.operators.prefix import running_before

_EXACT = [sum(1 / k for k in range(1, n + 1)) for n in range(33)]
_GAMMA = 0.5772156649015328606


def harmonic(n: Column) -> Column:
    """H(n) = 1 + 1/2 + ... + 1/n: a table up to 32, beyond that the expansion, whose next term is below 1e-14 there."""
    far = F.log(F.greatest(n, F.lit(1)).cast("double")) + _GAMMA + _beyond_log(n)
    return F.when(n <= 32, F.get(F.array(*map(F.lit, _EXACT)), F.least(n, F.lit(32)).cast("int"))).otherwise(far)


def _beyond_log(n: Column) -> Column:
    """H(n) less its logarithm and constant."""
    x = F.greatest(n, F.lit(1)).cast("double")
    square = x * x
    return 1 / (2 * x) - 1 / (12 * square) + 1 / (120 * square * square) - 1 / (252 * square * square * square)


def harmonic_between(n: Column, more: Column) -> Column:
    """H(n + more) - H(n), without cancelling the digits of two large numbers."""
    far = F.log1p(more / F.greatest(n, F.lit(1))) + _beyond_log(n + more) - _beyond_log(n)
    return F.when(n > 32, far).otherwise(harmonic(n + more) - harmonic(n))


def tie_groups(df: DataFrame, by: list[str], error: str = "error", score: str = "score", weight: str | None = None) -> DataFrame:
    """One row per distinct score: its rows (sz) and errors (g), and those of all lower scores (n0, b)."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    flag = F.col(error).cast("long")
    small = df.where(F.col(error).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score"))
    small = small.agg(F.sum(w).alias("sz"), F.sum(w * flag).alias("g")).where("sz > 0")
    return running_before(small, by, ["score"], {"n0": "sz", "b": "g"})


def risk_coverage_curve(df: DataFrame, by: list[str], error: str = "error", score: str = "score") -> DataFrame:
    """(by, k, coverage, risk): expected share of errors among the k most trusted rows, for every k."""
    t = tie_groups(df, by, error, score)
    n = t.groupBy(*by).agg(F.sum("sz").alias("_n")) if by else t.agg(F.sum("sz").alias("_n"))
    t = t.join(n, by) if by else t.crossJoin(F.broadcast(n))  # one row
    t = t.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "sz")).alias("j"))
    k = F.col("n0") + F.col("j")
    return t.select(*by, k.alias("k"), (k / F.col("_n")).alias("coverage"), ((F.col("b") + F.col("j") / F.col("sz") * F.col("g")) / k).alias("risk"))


def ranking_metrics(df: DataFrame, by: list[str], error: str = "error", score: str = "score", weight: str | None = None) -> DataFrame:
    """(by, n, errors, aurc, auroc, auprc) from one pass over the distinct scores.

    aurc in closed form: a tie group adds b*dH + (g/sz)*(sz - n0*dH), dH = H(n0+sz) - H(n0). auroc is the
    Mann-Whitney statistic with half for ties; auprc the step-wise average precision over falling scores.
    """
    t = tie_groups(df, by, error, score, weight)
    total = t.groupBy(*by).agg(F.sum("sz").alias("n"), F.sum("g").alias("errors"))
    dh = harmonic_between(F.col("n0"), F.col("sz"))
    area = F.col("b") * dh + F.col("g") / F.col("sz") * (F.col("sz") - F.col("n0") * dh)
    right_before, right_here = F.col("n0") - F.col("b"), F.col("sz") - F.col("g")
    t = t.join(total, by) if by else t.crossJoin(F.broadcast(total))
    above = F.col("errors") - F.col("b")  # errors at this score or higher
    precision = above / F.nullif(F.col("n") - F.col("n0"), F.lit(0))
    out = t.groupBy(*by, "n", "errors").agg(
        F.sum(area).alias("_area"), F.sum(F.col("g") * (right_before + right_here / 2.0)).alias("_wins"), F.sum(F.col("g") * precision).alias("_ap")
    )
    both = F.nullif(F.col("errors") * (F.col("n") - F.col("errors")), F.lit(0))
    return out.select(*by, "n", "errors", (F.col("_area") / F.col("n")).alias("aurc"), (F.col("_wins") / both).alias("auroc"), (F.col("_ap") / F.nullif("errors", F.lit(0))).alias("auprc"))


def method_scores(df: DataFrame, ids: list[str], methods: dict[str, str]) -> DataFrame:
    """Wide to long: one row per id row and method (name -> column)."""
    return df.select(*ids, F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in methods.items()])))


def delta_to(df: DataFrame, by: list[str], metric: str, reference: str, method: str = "method") -> DataFrame:
    """df (one row per by and method) plus delta_<metric> against the reference method of the same group."""
    ref = df.where(F.col(method) == reference).select(*by, F.col(metric).alias("_ref"))
    out = df.join(ref, by, "left") if by else df.crossJoin(F.broadcast(ref))
    return out.withColumn(f"delta_{metric}", F.col(metric) - F.col("_ref")).drop("_ref")


def threshold_for_coverage(df: DataFrame, by: list[str], coverages: list[float], score: str = "score") -> DataFrame:
    """(by, target, tau): the ceil(c*n)-th smallest score; ties may make the coverage reached larger."""
    t = tie_groups(df.withColumn("_flag", F.lit(0)), by, "_flag", score)
    n = t.groupBy(*by).agg(F.sum("sz").alias("_n"))
    t = t.join(n, by) if by else t.crossJoin(F.broadcast(n))
    want = F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("target")
    t = t.select("*", want).withColumn("_k", F.ceil(F.col("target") * F.col("_n")))
    return t.where((F.col("n0") < F.col("_k")) & (F.col("_k") <= F.col("n0") + F.col("sz"))).select(*by, "target", F.col("score").alias("tau"))


def selective_risk(df: DataFrame, thresholds: DataFrame, by: list[str], error: str = "error", score: str = "score") -> DataFrame:
    """(by, target, tau, coverage, answered, wrong_answered, selective_risk) for answering where score <= tau."""
    hit = F.col(score) <= F.col("tau")
    out = df.join(thresholds, by) if by else df.crossJoin(F.broadcast(thresholds))
    out = out.groupBy(*by, "target", "tau").agg(F.count("*").alias("_n"), F.count_if(hit).alias("answered"), F.sum(F.when(hit, F.col(error)).otherwise(0)).cast("long").alias("wrong_answered"))
    return out.select(*by, "target", "tau", (F.col("answered") / F.col("_n")).alias("coverage"), "answered", "wrong_answered", (F.col("wrong_answered") / F.nullif("answered", F.lit(0))).alias("selective_risk"))


def confusion_matrix(df: DataFrame, by: list[str], n_classes: int, true: str = "label", pred: str = "pred") -> DataFrame:
    """(by, true_class, predicted_class, n): every cell, zeros included."""
    cells = df.groupBy(*by, F.col(true).cast("int").alias("true_class"), F.col(pred).cast("int").alias("predicted_class")).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    axis = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = groups.select("*", F.explode(axis).alias("true_class")).select("*", F.explode(axis).alias("predicted_class"))
    return grid.join(cells, [*by, "true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def classification_summary(df: DataFrame, by: list[str], n_classes: int, true: str = "label", pred: str = "pred") -> DataFrame:
    """(by, n, wrong, accuracy, macro_f1, recall): f1 averages over all classes, 0 where undefined; recall is an array
    by class, null without support."""
    m = confusion_matrix(df, by, n_classes, true, pred)
    side = lambda c: m.groupBy(*by, F.col(c).alias("c"))
    tp = F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0))
    rows = side("true_class").agg(tp.alias("tp"), F.sum("n").alias("support"))
    cols = side("predicted_class").agg(F.sum("n").alias("called"))
    per = rows.join(cols, [*by, "c"])
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("support") + F.col("called"), F.lit(0)), F.lit(0.0))
    recall = F.col("tp") / F.nullif("support", F.lit(0))
    out = per.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("support") - F.sum("tp")).alias("wrong"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"), F.transform(F.array_sort(F.collect_list(F.struct("c", recall.alias("r")))), lambda x: x["r"]).alias("recall"),
    )
    return out


def expected_calibration_error(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """(by, ece) over bins (lo, hi] of [0, 1]; a confidence of 0 is in no bin."""
    edges = [k * (1 / bins) for k in range(bins)] + [1.0]
    place = reduce(lambda acc, k: F.when((F.col(confidence) > F.lit(edges[k])) & (F.col(confidence) <= F.lit(edges[k + 1])), k).otherwise(acc), range(bins), F.lit(None).cast("int"))
    binned = df.groupBy(*by, place.alias("_bin")).agg(F.count("*").alias("_m"), F.avg(F.col(correct).cast("double")).alias("_acc"), F.avg(confidence).alias("_conf"))
    part = F.when(F.col("_bin").isNotNull(), F.col("_m") * F.abs(F.col("_acc") - F.col("_conf"))).otherwise(0.0)
    return binned.groupBy(*by).agg((F.sum(part) / F.sum("_m")).alias("ece"))


def calibration_summary(df: DataFrame, by: list[str], logits: str = "logits", label: str = "label", temperature: Column | float = 1.0, bins: int = 15) -> DataFrame:
    """(by, nll, ece, brier)."""
    probs = df.withColumn("_p", S.softmax(logits, temperature))
    probs = probs.select(*by, S.row_nll(logits, label, temperature).alias("_nll"), S.row_brier("_p", label).alias("_brier"), F.array_max("_p").alias("_conf"), (S.predicted("_p") == F.col(label)).cast("int").alias("_ok"))
    means = probs.groupBy(*by).agg(F.avg("_nll").alias("nll"), F.avg("_brier").alias("brier"))
    ece = expected_calibration_error(probs, by, "_conf", "_ok", bins)
    return means.join(ece, by) if by else means.crossJoin(F.broadcast(ece))


def mean_over(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Plain means, such as over seeds, ignoring undefined values."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
