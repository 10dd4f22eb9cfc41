import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import quality_model

DIR = "/root/testdata/sf0.01"


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, stats string, score string, label int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def auc(y, s):
    """By all pairs."""
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_rising_equals_the_formula():
    """The least-squares rising function is a maximum over starts of minima over ends of means."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        s, y, w = np.sort(rng.normal(size=n)), rng.random(n).round(1), rng.integers(1, 5, n).astype(float)
        at, value = quality_model.rising(s, y, w)
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(np.interp(s, at, value), want)


def test_kernel():
    """Products of random features come near the Gaussian kernel."""
    rng = np.random.default_rng(2)
    k = len(quality_model.NAMES)
    x = rng.normal(size=(60, k))
    model = quality_model.Model(np.zeros(k), np.ones(k), rng.normal(0, 1 / np.sqrt(k), (k, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))
    z = model.features(x)[:, :-1]
    x = np.clip(x, -quality_model.FARTHEST, quality_model.FARTHEST)
    assert np.abs(z @ z.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * k))).max() < 0.05


def test_fit_equals_a_fit_in_one_piece(spark):
    """Weights, left-out weights and penalty from partition sums equal numpy's over all rows at once."""
    rng = np.random.default_rng(3)
    k, n = len(quality_model.NAMES), 700
    x = rng.normal(2, 3, (n, k))
    x[:, 5] = 1.5  # a constant
    y, fold = (x[:, 0] + x[:, 1] > 4).astype(float), rng.integers(0, quality_model.FOLDS, n)
    rows = spark.createDataFrame([(list(map(float, a)), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "stats array<double>, label double, fold int").repartition(7)
    model = quality_model.fitted(rows, 96)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.std, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = model.features(x)

    def ridge(some, penalty):
        root = np.sqrt(np.append(np.full(96, penalty), 1e-9) * some.sum())
        return np.linalg.lstsq(np.vstack([z[some], np.diag(root)]), np.append(y[some], np.zeros(97)), rcond=None)[0]

    errors = [sum(((z[fold == f] @ ridge(fold != f, p) - y[fold == f]) ** 2).sum() for f in range(quality_model.FOLDS)) for p in quality_model.PENALTIES]
    best = quality_model.PENALTIES[int(np.argmin(errors))]
    assert np.allclose(model.weights, ridge(fold >= 0, best), atol=1e-6)
    assert all(np.allclose(model.others[f], ridge(fold != f, best), atol=1e-6) for f in range(quality_model.FOLDS))
    s = model.score(x)
    assert auc(y, s) > 0.85 and abs(s.mean() - y.mean()) < 0.05 and 0 <= s.min() and s.max() <= 1
    raw = z @ model.weights
    assert (np.diff(s[np.argsort(raw)]) >= 0).all()


def test_statistics_by_hand():
    got = dict(zip(quality_model.NAMES, quality_model.statistics("A bb bb! \n A bb\n\nA bb"), strict=True))
    assert got["words"] == pytest.approx(np.log(8)) and got["distinct"] == 3 / 7 and got["repeats"] == 0
    assert got["commonest"] == 3 / 7 and got["repeated_lines"] == pytest.approx(1 / 3) and got["byte_class_0"] == 3 / 21 and got["byte_class_6"] == 1 / 21
    assert quality_model.statistics(None) == quality_model.statistics(" \n") == [0.0] * len(quality_model.NAMES)


def test_held_out_quality(spark):
    rows = quality_model.op13_quality_classifier(spark, DIR).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    y, s = np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    print("held out", len(held), "auc", auc(y, s), "right", ((s >= 0.7) == y).mean())
    assert auc(y, s) > 0.95 and ((s >= 0.7) == y).mean() > 0.93


def test_odd_tables(spark, tmp_path):
    good, bad = "Some plain words of prose, all of them different here. ", "$$$ BUY *** "
    rows = [(i, good * (i % 3 + 1) if i % 2 else bad * (i % 5 + 1), "en", "x", "y", 1) for i in range(200)]
    rows += [(None, good, None, None, None, None), (300, None, None, None, None, None), (301, "", None, None, None, None), (7, good * 2, "en", "x", "y", 1), (302, "w " * 200_000, None, None, None, None)]
    labels = [(i, i % 2, 0) for i in range(200)] + [(7, 1, 0), (5, None, 0), (None, 1, 0), (999, 1, None)]
    tables(spark, f"{tmp_path}/a", rows, labels)
    out = quality_model.op13_quality_classifier(spark, f"{tmp_path}/a").collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and all(by_id[i]["predicted"] == i % 2 for i in range(200)) and all(0 <= r["score"] <= 1 for r in out)
    assert by_id[300]["score"] == by_id[301]["score"] and len({r["score"] for r in out if r["doc_id"] == 7}) == 1
    # labels of held-out rows, and all columns but the text, teach nothing
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    tables(spark, f"{tmp_path}/b", [(i, t, "fr", "z", None, 0) for i, t, *_ in rows], [(i, 1 - q if i in held else q, 1) for i, q, _ in labels if q is not None])
    other = {r["doc_id"]: r["score"] for r in quality_model.op13_quality_classifier(spark, f"{tmp_path}/b").collect()}
    assert held and all(abs(other[i] - by_id[i]["score"]) < 1e-9 for i in range(200))
    tables(spark, f"{tmp_path}/c", rows, [])
    assert {(r["score"], r["predicted"]) for r in quality_model.op13_quality_classifier(spark, f"{tmp_path}/c").collect()} == {(0.5, 0)}
    tables(spark, f"{tmp_path}/d", rows, [(i, 1, 0) for i in range(9)])
    assert {r["score"] for r in quality_model.op13_quality_classifier(spark, f"{tmp_path}/d").collect()} == {1.0}
    tables(spark, f"{tmp_path}/e", [], labels)
    assert quality_model.op13_quality_classifier(spark, f"{tmp_path}/e").count() == 0
    clash = quality_model.described(spark.read.parquet(f"{tmp_path}/a/documents.parquet").where("doc_id = 7"))
    assert clash.columns == ["doc_id", "text", "lang", "stats", "score", "label"] and clash.select(F.size("stats")).first()[0] == len(quality_model.NAMES)
