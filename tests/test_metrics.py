import numpy as np
import pytest

from trustmill.operators import metrics, resample


def ranked(spark, errors, scores, weights=None):
    rows = [(int(e), float(s), int(w)) for e, s, w in zip(errors, scores, weights if weights is not None else np.ones(len(errors)), strict=True)]
    df = spark.createDataFrame(rows, "error int, score double, weight long")
    return metrics.ranking_metrics(df, [], weight="weight").first()


def brute(errors, scores):
    errors, scores = np.asarray(errors, float), np.asarray(scores, float)
    n, risks, b, n0 = len(errors), [], 0, 0
    for s in np.unique(scores):
        g, sz = errors[scores == s].sum(), (scores == s).sum()
        risks += [(b + j / sz * g) / (n0 + j) for j in range(1, sz + 1)]
        b, n0 = b + g, n0 + sz
    p, q = scores[errors == 1], scores[errors == 0]
    wins = (p[:, None] > q[None, :]).mean() + (p[:, None] == q[None, :]).mean() / 2
    ap = sum(errors[scores == s].sum() * errors[scores >= s].sum() / (scores >= s).sum() for s in np.unique(scores)) / errors.sum()
    return np.mean(risks), wins, ap


def test_known_answers(spark):
    good = ranked(spark, [0, 0, 0, 1], [0.1, 0.2, 0.3, 0.9])
    assert good["aurc"] == pytest.approx(0.0625) and good["auroc"] == 1 and good["auprc"] == 1
    bad = ranked(spark, [0, 0, 0, 1], [0.9, 0.3, 0.2, 0.1])
    assert bad["aurc"] == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 4) / 4) and bad["auroc"] == 0
    assert ranked(spark, [0, 0, 0, 1], [0.5] * 4)["aurc"] == pytest.approx(0.25)
    none = ranked(spark, [0, 0], [0.1, 0.2])
    assert none["auroc"] is None and none["auprc"] is None


def test_ties_and_order(spark):
    rng = np.random.default_rng(0)
    errors, scores = (rng.random(300) < 0.1).astype(int), np.round(rng.random(300), 1)
    turn = rng.permutation(300)
    a, b = ranked(spark, errors, scores), ranked(spark, errors[turn], scores[turn])
    want = brute(errors, scores)
    for x in (a, b):
        assert (x["aurc"], x["auroc"], x["auprc"]) == pytest.approx(want, abs=1e-12)


def test_weights_are_copies(spark):
    rng = np.random.default_rng(1)
    errors, scores, w = rng.integers(0, 2, 60), rng.integers(0, 9, 60), rng.integers(0, 4, 60)
    x = ranked(spark, errors, scores, w)
    assert (x["aurc"], x["auroc"], x["auprc"]) == pytest.approx(brute(np.repeat(errors, w), np.repeat(scores, w)), abs=1e-12)


def test_selective_risk_and_classification(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.9)], "error int, score double")
    tau = spark.createDataFrame([(0.75, 0.35)], "target double, tau double")
    r = metrics.selective_risk(df, tau, []).first()
    assert (r["coverage"], r["wrong_answered"], r["selective_risk"]) == (0.75, 0, 0)
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "label int, pred int")
    c = metrics.classification_summary(df, [], 3).first()
    assert c["accuracy"] == 0.75
    cells = {(r["true_class"], r["predicted_class"]): r["n"] for r in metrics.confusion_matrix(df, [], 3).collect()}
    assert cells[0, 1] == 1 and len(cells) == 9


def test_draws(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "c string")
    for made in (resample.draws(df, "c", 5), resample.draws(df, "c", 5, 1)):
        per = {r["resample"]: r["sum(weight)"] for r in made.groupBy("resample").sum("weight").collect()}
        assert set(per.values()) == {3} and len(per) == 5
    assert resample.draws(df.limit(0), "c", 5).count() == 0
