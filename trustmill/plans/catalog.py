"""Registered queries over the test tables, with the SQL that gives the same rows. Doubles are rounded to 6 digits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions import hashing as H
from trustmill.functions import scores as S
from trustmill.functions.storage import saved, shared_folder
from trustmill.operators import audit, calibration, contracts, groups, learn, metrics, prefix, provenance, resample, shift, splits, views
from trustmill.sources import arrays, images
from trustmill.streaming import events as streaming

FLAGSHIP = "risk_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = {"train": 0.5, "train_aux": 0.1, "calibration": 0.15, "reserve": 0.1, "test": 0.15}
SCALE = 8.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6)


# --- ranking metrics -------------------------------------------------------------------------------------------------

METHODS = {"discount": "l_discount", "price": "l_extendedprice"}


def scored_lines(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").withColumn("error", (F.col("l_returnflag") == "R").cast("int"))
    return metrics.method_scores(line, ["l_linestatus", "error"], METHODS)


LINES = """
s AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS error, 'discount' AS method, l_discount AS score FROM lineitem
      UNION ALL SELECT l_linestatus, (l_returnflag = 'R')::INT, 'price', l_extendedprice FROM lineitem),
t AS (SELECT l_linestatus, method, score, count(*) AS sz, sum(error) AS g FROM s GROUP BY ALL),
c AS (SELECT *, sum(sz) OVER w - sz AS n0, sum(g) OVER w - g AS b, sum(sz) OVER p AS n, sum(g) OVER p AS e FROM t
      WINDOW w AS (PARTITION BY l_linestatus, method ORDER BY score), p AS (PARTITION BY l_linestatus, method)),
"""
RANKED = """
m AS (SELECT l_linestatus, method, max(n)::BIGINT AS n, max(e)::BIGINT AS errors,
  sum(list_sum(list_transform(range(1, sz + 1), lambda j: (b + j * g::DOUBLE / sz) / (n0 + j)))) / max(n) AS aurc,
  sum(g * ((n0 - b) + (sz - g) / 2.0::DOUBLE)) / nullif(max(e) * (max(n) - max(e)), 0) AS auroc,
  sum(g * ((e - b)::DOUBLE / (n - n0))) / nullif(max(e), 0) AS auprc FROM c GROUP BY ALL)
"""


@query(f"WITH {LINES} {RANKED} SELECT l_linestatus, method, n, errors, round(aurc, 6) AS aurc, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM m")
def risk_summary(spark, d):
    m = metrics.ranking_metrics(scored_lines(spark, d), ["l_linestatus", "method"])
    return m.select("l_linestatus", "method", "n", "errors", r6("aurc").alias("aurc"), r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query(f"""WITH {LINES} {RANKED} SELECT m.l_linestatus, m.method, round(m.aurc - r.aurc, 6) AS delta_aurc FROM m JOIN m r
       ON r.l_linestatus = m.l_linestatus AND r.method = 'discount'""")
def delta_aurc(spark, d):
    m = metrics.ranking_metrics(scored_lines(spark, d), ["l_linestatus", "method"])
    return metrics.delta_to(m, ["l_linestatus"], "aurc", "discount").select("l_linestatus", "method", r6("delta_aurc").alias("delta_aurc"))


def judged_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "source", "lang", F.col("toxic").alias("error"), F.col("n_chars").cast("double").alias("score"))


DOCS = "s AS (SELECT doc_id, source, lang, toxic AS error, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),"


@query(f"""WITH {DOCS} t AS (SELECT score, count(*) AS sz, sum(error) AS g FROM s GROUP BY 1),
c AS (SELECT *, sum(sz) OVER (ORDER BY score) - sz AS n0, sum(g) OVER (ORDER BY score) - g AS b, sum(sz) OVER () AS n FROM t),
x AS (SELECT *, unnest(range(1, sz + 1)) AS j FROM c)
SELECT (n0 + j)::BIGINT AS k, round((n0 + j) / n, 6) AS coverage, round((b + j * g::DOUBLE / sz) / (n0 + j), 6) AS risk FROM x""")
def risk_coverage(spark, d):
    return metrics.risk_coverage_curve(judged_documents(spark, d), []).select("k", r6("coverage").alias("coverage"), r6("risk").alias("risk"))


@query(f"""WITH {LINES} k AS (SELECT c.*, target, ceil(target * n) AS k FROM c, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) v(target)),
tau AS (SELECT l_linestatus, method, target, score AS tau FROM k WHERE n0 < k AND k <= n0 + sz)
SELECT l_linestatus, method, target, tau, round(count(*) FILTER (score <= tau) / count(*), 6) AS coverage, count(*) FILTER (score <= tau) AS answered,
  coalesce(sum(error) FILTER (score <= tau), 0)::BIGINT AS wrong_answered, round(avg(error) FILTER (score <= tau), 6) AS selective_risk
FROM s JOIN tau USING (l_linestatus, method) GROUP BY ALL""")
def selective_risk(spark, d):
    lines = scored_lines(spark, d)
    tau = metrics.threshold_for_coverage(lines, ["l_linestatus", "method"], [0.8, 0.9])
    out = metrics.selective_risk(lines, tau, ["l_linestatus", "method"])
    return out.withColumns({"coverage": r6("coverage"), "selective_risk": r6("selective_risk")})


# --- scores, classification, calibration -----------------------------------------------------------------------------


def logits(spark, d) -> DataFrame:
    """Each vector, in all its values, against the mean vector of every label."""
    rows = table(spark, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("mean")).agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("means"))
    dot = lambda w: F.aggregate(F.zip_with("embedding", w["mean"], lambda x, m: x.cast("double") * m["m"]), F.lit(0.0), lambda a, x: a + x)
    z = F.transform("means", lambda w: dot(w) * SCALE)
    rows = rows.crossJoin(F.broadcast(means)).select("vec_id", "label", z.alias("logits")).withColumn("probs", S.softmax("logits"))  # one row
    return rows.withColumns({"pred": S.predicted("logits"), "seed": (F.col("vec_id") % 3).cast("int")})


LOGITS = f"""
mv AS (SELECT label, pos, avg(x) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL),
mw AS (SELECT list(w ORDER BY label) AS means FROM (SELECT label, list(a ORDER BY pos) AS w FROM mv GROUP BY 1)),
z AS (SELECT vec_id, label, (vec_id % 3)::INT AS seed, list_transform(means, lambda w: list_dot_product(embedding::DOUBLE[], w) * {SCALE}::DOUBLE) AS z FROM embeddings, mw),
y AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM z),
p AS (SELECT vec_id, label, seed, z, list_transform(ex, lambda x: x / list_sum(ex)) AS p, (list_position(z, list_max(z)) - 1)::INT AS pred FROM y)
"""


@query(f"""WITH {LOGITS} SELECT vec_id, pred, (pred <> label)::INT AS error, round(1 - list_max(p), 6) AS msp,
round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))), 6) AS entropy, round(1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]), 6) AS margin FROM p""")
def uncertainty_scores(spark, d):
    p = logits(spark, d)
    return p.select("vec_id", "pred", (F.col("pred") != F.col("label")).cast("int").alias("error"), r6(S.msp("probs")).alias("msp"), r6(S.entropy("probs")).alias("entropy"), r6(S.margin("probs")).alias("margin"))


@query(f"""WITH {LOGITS} SELECT seed, t.c::INT AS true_class, q.c::INT AS predicted_class, count(vec_id) AS n
FROM (SELECT DISTINCT seed FROM p) s CROSS JOIN range(10) t(c) CROSS JOIN range(10) q(c) LEFT JOIN p USING (seed) WHERE TRUE GROUP BY ALL""".replace("LEFT JOIN p USING (seed) WHERE TRUE", "LEFT JOIN p ON p.seed = s.seed AND p.label = t.c AND p.pred = q.c").replace("SELECT seed, t.c", "SELECT s.seed, t.c"))
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(logits(spark, d), ["seed"], 10)


@query(f"""WITH {LOGITS} , k AS (SELECT seed, c FROM (SELECT DISTINCT seed FROM p) CROSS JOIN range(10) t(c)),
f AS (SELECT k.seed, c, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS called FROM k JOIN p USING (seed) GROUP BY ALL)
SELECT seed, sum(support)::BIGINT AS n, (sum(support) - sum(tp))::BIGINT AS wrong, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(coalesce(2 * tp / nullif(support + called, 0), 0)), 6) AS macro_f1, round(max(tp / nullif(support, 0)) FILTER (c = 3), 6) AS recall_3 FROM f GROUP BY 1""")
def classification(spark, d):
    out = metrics.classification_summary(logits(spark, d), ["seed"], 10)
    return out.select("seed", "n", "wrong", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), r6(F.get("recall", F.lit(3))).alias("recall_3"))


@query(f"""WITH {LOGITS}, r AS (SELECT seed, -ln(p[label + 1]) AS nll, list_sum(list_transform(p, lambda x, i: pow(x - (i = label + 1)::INT, 2))) AS brier, list_max(p) AS conf, (pred = label)::INT AS ok FROM p),
b AS (SELECT seed, ceil(conf * 15) AS bin, count(*) AS m, avg(ok) AS acc, avg(conf) AS conf FROM r GROUP BY ALL)
SELECT seed, round(avg(nll), 6) AS nll, round(max(e.ece), 6) AS ece, round(avg(brier), 6) AS brier
FROM r JOIN (SELECT seed, sum(m * abs(acc - conf)) / sum(m) AS ece FROM b GROUP BY 1) e USING (seed) GROUP BY 1""")
def calibration_summary(spark, d):
    out = metrics.calibration_summary(logits(spark, d), ["seed"])
    return out.select("seed", r6("nll").alias("nll"), r6("ece").alias("ece"), r6("brier").alias("brier"))


#: Bisection on the slope of the loss by 1/T.
FITTED = f"""{LOGITS},
bis(seed, lo, hi, i) AS (SELECT DISTINCT seed, 0.05::DOUBLE, 20.0::DOUBLE, 0 FROM z UNION ALL
  SELECT seed, CASE WHEN g < 0 THEN mid ELSE lo END, CASE WHEN g < 0 THEN hi ELSE mid END, i + 1 FROM (
    SELECT b.seed, lo, hi, i, (lo + hi) / 2 AS mid, avg(list_dot_product(list_transform(z.z, lambda x: exp((lo + hi) / 2 * (x - list_max(z.z)))), z.z)
      / list_sum(list_transform(z.z, lambda x: exp((lo + hi) / 2 * (x - list_max(z.z))))) - z.z[label + 1]) AS g
    FROM bis b JOIN z ON z.seed = b.seed WHERE i < 44 GROUP BY ALL)),
fit AS (SELECT seed, (lo + hi) / 2 AS beta FROM bis WHERE i = 44),
ws AS (SELECT vec_id, label, z.seed, z, beta, list_transform(z, lambda x: exp(beta * (x - list_max(z)))) AS ex FROM z JOIN fit ON z.seed = fit.seed),
wp AS (SELECT vec_id, label, seed, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM ws)"""


def _summary_sql(name: str, rows: str) -> str:
    return f"""{name}r AS (SELECT seed, -ln(p[label + 1]) AS nll, list_sum(list_transform(p, lambda x, i: pow(x - (i = label + 1)::INT, 2))) AS brier, list_max(p) AS conf,
      (list_position(p, list_max(p)) - 1 = label)::INT AS ok FROM {rows}),
    {name}b AS (SELECT seed, ceil(conf * 15) AS bin, count(*) AS m, avg(ok) AS acc, avg(conf) AS conf FROM {name}r GROUP BY ALL),
    {name} AS (SELECT seed, avg(nll) AS nll, any_value(e.ece) AS ece, avg(brier) AS brier FROM {name}r JOIN (SELECT seed, sum(m * abs(acc - conf)) / sum(m) AS ece FROM {name}b GROUP BY 1) e USING (seed) GROUP BY 1)"""


_CALIBRATION = [f"{n}_{side}" for n in ("nll", "ece", "brier") for side in ("before", "after")]


@query(f"""WITH RECURSIVE {FITTED}, {_summary_sql("q0", "p")}, {_summary_sql("q1", "wp")}
SELECT seed, round(1 / beta, 6) AS temperature, beta > 19.8 AS hit_limit, {", ".join(f"round({'q0' if c.endswith('before') else 'q1'}.{c.split('_')[0]}, 6) AS {c}" for c in _CALIBRATION)}, q1.nll <= q0.nll + 1e-9 AS nll_ok
FROM fit JOIN q0 USING (seed) JOIN q1 USING (seed)""")
def temperature_scaling(spark, d):
    out, _ = calibration.calibrate(logits(spark, d), ["seed"], [0.8, 0.9])
    return out.select("seed", r6("temperature").alias("temperature"), "hit_limit", *[r6(c).alias(c) for c in _CALIBRATION], "nll_ok")


@query(f"""WITH RECURSIVE {FITTED}, u AS (SELECT seed, 'B1 MSP' AS method, 1 - list_max(p) AS score FROM p
  UNION ALL SELECT seed, 'B2 Entropy', -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))) FROM p
  UNION ALL SELECT seed, 'B3 Margin', 1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]) FROM p UNION ALL SELECT seed, 'B4 Temperature MSP', 1 - list_max(p) FROM wp),
o AS (SELECT *, row_number() OVER (PARTITION BY seed, method ORDER BY score) AS k, count(*) OVER (PARTITION BY seed, method) AS n FROM u)
SELECT seed, method, target, round(score, 6) AS tau FROM o, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) v(target) WHERE k = ceil(target * n)""")
def calibration_thresholds(spark, d):
    return calibration.calibrate(logits(spark, d), ["seed"], [0.8, 0.9])[1].withColumn("tau", r6("tau"))


@query(f"""WITH RECURSIVE {FITTED}, u AS (SELECT vec_id, seed, 'B1 MSP' AS method, 1 - list_max(p) AS score FROM p
  UNION ALL SELECT vec_id, seed, 'B2 Entropy', -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))) FROM p
  UNION ALL SELECT vec_id, seed, 'B3 Margin', 1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]) FROM p UNION ALL SELECT vec_id, seed, 'B4 Temperature MSP', 1 - list_max(p) FROM wp
  UNION ALL SELECT vec_id, seed, 'head ' || k, p[k::INT] FROM p, (VALUES ('1'), ('2'), ('3')) v(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY seed, method ORDER BY score) AS k, count(*) OVER (PARTITION BY seed, method) AS n FROM u),
t AS (SELECT seed, method, target, score AS tau FROM o, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) v(target) WHERE k = ceil(target * n)),
w AS (SELECT vec_id, (list_position(z, list_max(z)) - 1 <> label)::INT AS error FROM z)
SELECT t.seed, t.method, target, round(tau, 6) AS tau, round(avg((score <= tau)::INT), 6) AS coverage, count(*) FILTER (score <= tau AND error = 1) AS wrong_answered
FROM t JOIN u USING (seed, method) JOIN w USING (vec_id) GROUP BY ALL""")
def calibration_stage(spark, d):
    """Seven methods: four without training, three heads (here three of the probabilities)."""
    rows = logits(spark, d).withColumns({"error": (F.col("pred") != F.col("label")).cast("int")} | {f"head{k}": F.get("probs", F.lit(k - 1)) for k in (1, 2, 3)})
    _, reached = calibration.calibration_stage(rows, "seed", [0.8, 0.9], {f"head {k}": f"head{k}" for k in (1, 2, 3)})
    return reached.withColumns({"tau": r6("tau"), "coverage": r6("coverage")})


@query()
def temperature_bootstrap(spark, d):
    return calibration.temperature_intervals(logits(spark, d), "seed")


# --- resampling ------------------------------------------------------------------------------------------------------

RESAMPLES = 2000


@query(f"""WITH {DOCS} cl AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT source FROM s)),
dr AS (SELECT r, k, ('0x' || substr(sha256('0:' || r || ':' || k), 1, 8))::BIGINT % (SELECT max(g) FROM cl) AS i FROM range({RESAMPLES}) a(r), range((SELECT max(g) FROM cl)) b(k)),
w AS (SELECT r, source, count(*) AS w FROM dr JOIN cl USING (i) GROUP BY ALL),
t AS (SELECT r, score, sum(w) AS sz, sum(w * error) AS g FROM s JOIN w USING (source) GROUP BY ALL),
c AS (SELECT *, sum(sz) OVER x - sz AS n0, sum(g) OVER x - g AS b FROM t WINDOW x AS (PARTITION BY r ORDER BY score)),
a AS (SELECT r, sum(list_sum(list_transform(range(1, sz::BIGINT + 1), lambda j: (b + j * g::DOUBLE / sz) / (n0 + j)))) / sum(sz) AS aurc FROM c GROUP BY 1)
SELECT round(quantile_cont(aurc, 0.025::DOUBLE), 6) AS aurc_low, round(quantile_cont(aurc, 0.975::DOUBLE), 6) AS aurc_high FROM a""")
def bootstrap_interval(spark, d):
    docs = judged_documents(spark, d)
    reps = resample.replicates(docs, resample.draws(docs, "source", RESAMPLES), [], "source")
    out = resample.intervals(reps.withColumn("_all", F.lit(1)), ["_all"], ["aurc"])
    return out.select(r6("aurc_low").alias("aurc_low"), r6("aurc_high").alias("aurc_high"))


@query(f"""WITH {DOCS} cl AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT source FROM s)),
dr AS (SELECT r, k, ('0x' || substr(sha256('3:' || r || ':' || k), 1, 8))::BIGINT % (SELECT max(g) FROM cl) AS i FROM range({RESAMPLES}) a(r), range((SELECT max(g) FROM cl)) b(k)),
w AS (SELECT r, source, count(*) AS w FROM dr JOIN cl USING (i) GROUP BY ALL), t AS (SELECT source, lang, sum(error) AS e, count(*) AS n FROM s GROUP BY ALL),
a AS (SELECT lang, r, sum(w * e) / sum(w * n) AS rate FROM t JOIN w USING (source) GROUP BY ALL)
SELECT lang, round(quantile_cont(rate, 0.025::DOUBLE), 6) AS rate_low, round(quantile_cont(rate, 0.975::DOUBLE), 6) AS rate_high FROM a GROUP BY 1""")
def statistic_bootstrap(spark, d):
    """Any statistic, here an error rate by language, in every resample."""
    docs = judged_documents(spark, d)

    def rate(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
        return rows.groupBy(*keys).agg((F.sum(F.col(weight) * F.col("e")) / F.sum(F.col(weight) * F.col("n"))).alias("rate"))

    small = docs.groupBy("source", "lang").agg(F.sum("error").alias("e"), F.count("*").alias("n"))
    reps = resample.replicates_of(small, resample.draws(docs, "source", RESAMPLES, 3), ["lang"], "source", rate)
    return resample.intervals(reps, ["lang"], ["rate"]).select("lang", r6("rate_low").alias("rate_low"), r6("rate_high").alias("rate_high"))


@query(f"""WITH {DOCS} cl AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT source FROM s)),
dr AS (SELECT r, k, ('0x' || substr(sha256('2026:' || r || ':' || k), 1, 8))::BIGINT % (SELECT max(g) FROM cl) AS i FROM range({RESAMPLES}) a(r), range((SELECT max(g) FROM cl)) b(k)),
w AS (SELECT r, source, count(*) AS w FROM dr JOIN cl USING (i) GROUP BY ALL),
m AS (SELECT source, lang, error, 'length' AS method, score::DOUBLE AS score FROM s UNION ALL SELECT source, lang, error, 'shortness', -score::DOUBLE FROM s),
t AS (SELECT lang, method, r, score, sum(w) AS sz, sum(w * error) AS g FROM m JOIN w USING (source) GROUP BY ALL),
c AS (SELECT *, sum(sz) OVER x - sz AS n0, sum(g) OVER x - g AS b FROM t WINDOW x AS (PARTITION BY lang, method, r ORDER BY score)),
a AS (SELECT lang, method, r, sum(list_sum(list_transform(range(1, sz::BIGINT + 1), lambda j: (b + j * g::DOUBLE / sz) / (n0 + j)))) / sum(sz) AS aurc FROM c GROUP BY 1, 2, 3),
j AS (SELECT a.method, r, avg(a.aurc) AS aurc, avg(a.aurc - f.aurc) AS delta FROM a JOIN (SELECT lang, r, aurc FROM a WHERE method = 'length') f USING (lang, r) GROUP BY 1, 2)
SELECT method, {", ".join(f"round(quantile_cont({c}, {p}::DOUBLE), 6) AS {n}_{side}" for c, n in (("aurc", "aurc"), ("delta", "delta_aurc")) for side, p in (("low", 0.025), ("high", 0.975)))} FROM j GROUP BY 1""")
def paired_bootstrap(spark, d):
    """Two methods on the same resamples, the difference in each, and averages over languages before the percentiles."""
    docs = judged_documents(spark, d)
    both = metrics.method_scores(docs.withColumn("other", -F.col("score")), ["source", "lang", "error"], {"length": "score", "shortness": "other"})
    reps = resample.replicates(both, resample.draws(docs, "source", RESAMPLES, 2026), ["lang", "method"], "source")
    reps = resample.paired_difference(reps, ["lang"], "length")
    out = resample.intervals(resample.joint_mean(reps, ["method"], ["aurc", "delta_aurc"]), ["method"], ["aurc", "delta_aurc"])
    return out.select("method", *[r6(c).alias(c) for c in ("aurc_low", "aurc_high", "delta_aurc_low", "delta_aurc_high")])


@query(f"""WITH {DOCS} o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
cl AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT source FROM s)),
dr AS (SELECT r, k, ('0x' || substr(sha256('2027:' || r || ':' || k), 1, 8))::BIGINT % (SELECT max(g) FROM cl) AS i FROM range({RESAMPLES}) a(r), range((SELECT max(g) FROM cl)) b(k)),
w AS (SELECT r, source, count(*) AS w FROM dr JOIN cl USING (i) GROUP BY ALL UNION ALL SELECT -1, source, 1 FROM cl),
m AS (SELECT source, error, 'length' AS method, score FROM o UNION ALL SELECT source, error, 'shortness', -score FROM o),
t AS (SELECT method, r, score, sum(w) AS sz, sum(w * error) AS g FROM m JOIN w USING (source) GROUP BY ALL),
c AS (SELECT *, sum(sz) OVER x - sz AS n0, sum(g) OVER x - g AS b FROM t WINDOW x AS (PARTITION BY method, r ORDER BY score)),
a AS (SELECT method, r, sum(sz) AS n, sum(list_sum(list_transform(range(1, sz::BIGINT + 1), lambda j: (b + j * g::DOUBLE / sz) / (n0 + j)))) / sum(sz) AS aurc FROM c GROUP BY 1, 2),
j AS (SELECT a.*, a.aurc - f.aurc AS delta FROM a JOIN (SELECT r, aurc FROM a WHERE method = 'length') f USING (r))
SELECT method, max(n) FILTER (r = -1)::BIGINT AS n, round(max(aurc) FILTER (r = -1), 6) AS aurc, round(max(delta) FILTER (r = -1), 6) AS delta_aurc,
round(quantile_cont(delta, 0.025::DOUBLE) FILTER (r >= 0), 6) AS delta_aurc_low, round(quantile_cont(delta, 0.975::DOUBLE) FILTER (r >= 0), 6) AS delta_aurc_high FROM j GROUP BY 1""")
def cluster_sensitivity(spark, d):
    docs = judged_documents(spark, d).withColumns({"other": -F.col("score")})
    weights = saved(resample.draws(docs, "source", RESAMPLES, 2027))
    out = resample.cluster_sensitivity(docs, [], "source", ["doc_id"], {"length": "score", "shortness": "other"}, "length", weights)
    return out.select("method", "n", *[r6(c).alias(c) for c in ("aurc", "delta_aurc", "delta_aurc_low", "delta_aurc_high")])


@query(f"WITH {DOCS} x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM s) SELECT doc_id, source, lang, error, score FROM x WHERE k = 1")
def one_per_cluster(spark, d):
    return resample.one_per_cluster(judged_documents(spark, d), "source", ["doc_id"])


# --- audit and duplicates --------------------------------------------------------------------------------------------


def manifest(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    domain = F.when(F.col("source").isin("src0", "src1", "src2"), "target").otherwise("source")
    return docs.select(F.col("doc_id").alias("path"), domain.alias("dataset"), F.col("lang").alias("label"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


MANIFEST = """m AS (SELECT doc_id AS path, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'target' ELSE 'source' END AS dataset, lang AS label, sha256(text) AS sha256,
  octet_length(encode(text))::BIGINT AS size_bytes FROM documents)"""


@query(f"""WITH {MANIFEST} SELECT sha256, dataset, path, count(*) OVER g AS count, CASE WHEN min(dataset) OVER g < max(dataset) OVER g THEN 'cross_dataset' ELSE 'within_' || dataset END AS scope,
array_to_string(list_sort(list_distinct(list(label) OVER g)), ';') AS labels FROM m WINDOW g AS (PARTITION BY sha256) QUALIFY count(*) OVER g >= 2""")
def exact_duplicates(spark, d):
    return audit.exact_duplicates(manifest(spark, d))


def sign_hash(spark, d) -> DataFrame:
    bits = lambda at: F.aggregate(F.transform(F.slice("embedding", at, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", "label", bits(1).alias("hi"), bits(33).alias("lo"))


SIGNS = """h AS (SELECT vec_id, label, list_sum(list_transform(embedding[1:32], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS hi,
  list_sum(list_transform(embedding[33:64], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS lo FROM embeddings),
n AS (SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance, a.label = b.label AS same_label,
  a.label AS label_a, b.label AS label_b FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 18)"""


def labelled_pairs(spark, d, items=None, digest=None) -> DataFrame:
    items = sign_hash(spark, d) if items is None else items
    pairs = audit.near_pairs(items, "vec_id", "hi", "lo", 18, digest, ("label",))
    return pairs.withColumn("same_label", F.col("label_a") == F.col("label_b"))


@query(f"WITH {SIGNS} SELECT vec_id_a, vec_id_b, distance, same_label FROM n")
def near_duplicate_pairs(spark, d):
    return labelled_pairs(spark, d).select("vec_id_a", "vec_id_b", "distance", "same_label")


@query(f"""WITH {SIGNS}, f AS (SELECT doc_id AS k, sha256(text) AS sha FROM documents),
w AS (SELECT n.*, (vec_id_a + vec_id_b) % 5 = 0 AS reviewed, CASE WHEN (label_a < 5) <> (label_b < 5) THEN 'cross' WHEN label_a < 5 THEN 'source-source' ELSE 'target-target' END AS scope
  FROM n LEFT JOIN f x ON x.k = vec_id_a LEFT JOIN f y ON y.k = vec_id_b WHERE coalesce(x.sha <> y.sha, true))
SELECT k::INT AS distance, count(distance) AS pairs, count(*) FILTER (scope = 'source-source') AS "source-source", count(*) FILTER (scope = 'target-target') AS "target-target",
count(*) FILTER (scope = 'cross') AS "cross", count(*) FILTER (NOT same_label) AS different_label, count(*) FILTER (NOT reviewed) AS not_reviewed,
(sum(count(distance)) OVER (ORDER BY k))::BIGINT AS pairs_up_to FROM range(19) r(k) LEFT JOIN w ON distance = k GROUP BY k""")
def distance_sweep(spark, d):
    """Items are the vectors, whose exact copies are those of the document of the same number."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("sha"))
    pairs = labelled_pairs(spark, d, sign_hash(spark, d).join(texts, "vec_id", "left"), "sha")
    half = lambda c: F.when(F.col(c) < 5, "source").otherwise("target")
    pairs = saved(pairs).withColumn("scope", audit.pair_scope(half("label_a"), half("label_b")))
    reviews = pairs.where((F.col("vec_id_a") + F.col("vec_id_b")) % 5 == 0).select(F.col("vec_id_b").alias("vec_id_a"), F.col("vec_id_a").alias("vec_id_b"))
    return audit.distance_sweep(audit.with_reviewed(pairs, reviews, "vec_id_a", "vec_id_b"), 18, ["source-source", "target-target", "cross"])


@query(f"WITH {SIGNS} SELECT row_number() OVER (ORDER BY distance, vec_id_a, vec_id_b) AS pair_id, vec_id_a, vec_id_b, distance, floor((row_number() OVER (ORDER BY distance, vec_id_a, vec_id_b) - 1) / 6)::BIGINT AS sheet, '' AS decision FROM n")
def review_sheet(spark, d):
    pairs = saved(labelled_pairs(spark, d).select("vec_id_a", "vec_id_b", "distance"))
    return audit.review_sheet(pairs, ["distance", "vec_id_a", "vec_id_b"])


@query("SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM labels GROUP BY 1")
def decision_crosstab(spark, d):
    return audit.crosstab(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("""SELECT k AS lang, count(doc_id) AS found, e AS expected, CASE WHEN count(doc_id) = e THEN 'OK' ELSE 'CHECK' END AS state
FROM (VALUES ('en', 620), ('fr', 145), ('it', 0), ('de', 1)) v(k, e) LEFT JOIN documents ON lang = k GROUP BY k, e""")
def count_check(spark, d):
    expected = spark.sql("SELECT * FROM VALUES ('en', 620), ('fr', 145), ('it', 0), ('de', 1) AS t(lang, expected)")
    return audit.count_check(table(spark, d, "documents"), expected, "lang")


@query("SELECT k AS lang, count(doc_id) AS n, round(count(doc_id) / (SELECT count(*) FROM documents), 6) AS share FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) v(k) LEFT JOIN documents ON lang = k GROUP BY 1")
def language_shares(spark, d):
    return audit.value_shares(table(spark, d, "documents"), "lang", ["en", "fr", "de", "es", "it"]).withColumn("share", r6("share"))


@query("SELECT source, lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def source_ranges(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.countDistinct("text").alias("texts"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_min(lang, (-n, lang)) AS lang, max(n) AS n FROM c GROUP BY 1")
def modal_language(spark, d):
    return audit.modal_value(table(spark, d, "documents"), ["source"], "lang")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, d):
    return audit.class_weights(table(spark, d, "documents"), "lang").withColumn("weight", r6("weight"))


@query("SELECT count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, round(least(5, count(*) FILTER (toxic = 0) / nullif(count(*) FILTER (toxic = 1), 0)), 6) AS weight FROM labels")
def positive_weight(spark, d):
    return audit.positive_weight(table(spark, d, "labels"), "toxic").withColumn("weight", r6("weight"))


@query("""SELECT doc_id AS path, 'label count is not one' AS problem FROM labels WHERE quality + toxic <> 1 UNION ALL
SELECT doc_id, 'listed but missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL
SELECT doc_id, 'present but unlisted' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def label_problems(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "path")
    files = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("path"))
    return audit.label_problems(labels, files, ["quality", "toxic"])


@query("""SELECT l.doc_id, CASE WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'unlabelled' END AS label, 'files/' || l.doc_id || '.txt' AS path
FROM labels l JOIN documents d USING (doc_id) WHERE lang = 'en'""")
def listed_files(spark, d):
    return audit.listed_files(table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"), ["quality", "toxic"], "doc_id", "files/", ".txt")


@query("""SELECT l.doc_id, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'missing' WHEN l.doc_id % 3 = 0 THEN 'there' ELSE 'copy' END AS state
FROM labels l LEFT JOIN documents d USING (doc_id) WHERE l.doc_id % 4 <> 0
UNION ALL SELECT doc_id, 'left out' FROM documents WHERE lang = 'en' AND source = 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 4 <> 0)""")
def file_selection(spark, d):
    found = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", F.length("text").alias("size"))
    copied = found.where("doc_id % 3 <> 1").withColumn("size", F.col("size") + F.col("doc_id") % 3)
    return audit.file_selection(table(spark, d, "labels").where("doc_id % 4 <> 0"), found, copied, "doc_id", "size", F.col("source") == "src1")


# --- groups and splits -----------------------------------------------------------------------------------------------

#: Reviews of pairs of neighbours, decided by the id: every seventh a duplicate, every eleventh unsure, the rest different.
REVIEWS = """rv AS (SELECT doc_id AS a, doc_id + 1 AS b, CASE WHEN doc_id % 7 = 0 THEN 'duplicate' WHEN doc_id % 11 = 0 THEN 'unsure' ELSE 'different' END AS decision FROM documents),
rs AS (SELECT rv.*, x.dataset AS da, y.dataset AS db FROM rv JOIN m x ON x.path = a JOIN m y ON y.path = b WHERE decision <> 'different')"""
LINKED = f"""{MANIFEST}, {REVIEWS}, h AS (SELECT *, min(path) FILTER (dataset = 'source') OVER (PARTITION BY sha256) AS head, max((dataset <> 'source')::INT) OVER (PARTITION BY sha256) AS outside FROM m),
gone AS (SELECT path, arg_max(reason, k) AS reason FROM (SELECT path, 'exact copy' AS reason, '1' AS k FROM h WHERE dataset = 'source' AND outside = 1 UNION ALL
  SELECT CASE WHEN da = 'source' THEN a ELSE b END, 'reviewed ' || decision, '2' || decision FROM rs WHERE (da = 'source') <> (db = 'source')) GROUP BY 1),
link AS (SELECT head AS a, path AS b FROM h WHERE dataset = 'source' AND outside = 0 AND path <> head UNION SELECT a, b FROM rs WHERE da = 'source' AND db = 'source')"""


def reviews(spark, d) -> DataFrame:
    k = F.col("doc_id")
    decision = F.when(k % 7 == 0, "duplicate").when(k % 11 == 0, "unsure").otherwise("different")
    return table(spark, d, "documents").select(k.alias("path_a"), (k + 1).alias("path_b"), decision.alias("decision"))


@query(f"""WITH RECURSIVE {LINKED}, pool AS (SELECT path FROM m WHERE dataset = 'source' AND path NOT IN (SELECT path FROM gone)),
e AS (SELECT a, b FROM link WHERE a IN (FROM pool) AND b IN (FROM pool)), ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (SELECT path, path FROM pool UNION SELECT reach.v, ends.b FROM reach JOIN ends ON ends.a = reach.r), root AS (SELECT v, min(r) AS root FROM reach GROUP BY 1),
g AS (SELECT v AS path, dense_rank() OVER (ORDER BY root) AS i, count(*) OVER (PARTITION BY root) AS size FROM root)
SELECT path, 'g' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS group_id, size FROM g""")
def duplicate_groups(spark, d):
    m = manifest(spark, d)
    links, gone = groups.collect_links(m, reviews(spark, d))
    pool = m.where("dataset = 'source'").join(gone, "path", "left_anti")
    return groups.build_groups(pool, links)


@query(f"WITH {LINKED} SELECT path, reason FROM gone")
def source_exclusions(spark, d):
    return groups.collect_links(manifest(spark, d), reviews(spark, d))[1]


@query(f"""WITH RECURSIVE {SIGNS}, e AS (SELECT vec_id_a AS a, vec_id_b AS b FROM n UNION SELECT vec_id_b, vec_id_a FROM n),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.r),
root AS (SELECT v, min(r) AS root FROM reach GROUP BY 1), g AS (SELECT v AS vec_id, dense_rank() OVER (ORDER BY root) AS i, count(*) OVER (PARTITION BY root) AS size FROM root)
SELECT vec_id, 'c' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS group_id, size FROM g""")
def near_duplicate_clusters(spark, d):
    items = sign_hash(spark, d)
    return groups.build_groups(items, audit.near_links(items, "vec_id", "hi", "lo", 18), "vec_id", "c")


@query(f"""WITH {LINKED}, r AS (SELECT 'exact copy' AS reason FROM h WHERE dataset = 'source' AND outside = 0 AND path <> head UNION ALL
SELECT 'reviewed ' || decision FROM rs WHERE da = 'source' AND db = 'source')
SELECT v.reason, count(r.reason) AS links FROM (VALUES ('exact copy'), ('reviewed duplicate'), ('reviewed unsure')) v(reason) LEFT JOIN r ON r.reason = v.reason GROUP BY 1""")
def link_counts(spark, d):
    return groups.link_counts(groups.collect_links(manifest(spark, d), reviews(spark, d))[0], ["exact copy", "reviewed duplicate", "reviewed unsure"])


QUOTAS = "(VALUES (0, 'train', 0.5::DOUBLE), (1, 'train_aux', 0.1::DOUBLE), (2, 'calibration', 0.15::DOUBLE), (3, 'reserve', 0.1::DOUBLE), (4, 'test', 0.15::DOUBLE)) v(i, subset, p)"
QUOTA_SQL = f"""c AS (SELECT c_mktsegment AS label, count(*) AS size FROM customer GROUP BY 1), x AS (SELECT *, size * p AS exact FROM c, {QUOTAS}),
q AS (SELECT *, floor(exact) + (row_number() OVER (PARTITION BY label ORDER BY -(exact - floor(exact)), i) <= size - sum(floor(exact)) OVER (PARTITION BY label))::INT AS quota FROM x)"""


@query(f"WITH {QUOTA_SQL} SELECT label, subset, quota::BIGINT AS quota FROM q")
def split_quotas(spark, d):
    sizes = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("size"))
    return splits.subset_quotas(sizes, ["label"], "size", PARTS)


@query("""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT round_even(sum(n) * 0.2::DOUBLE, 0) AS t FROM c),
x AS (SELECT *, n * 0.2::DOUBLE AS e FROM c, t) SELECT label, n, (floor(e) + (row_number() OVER (ORDER BY -(e - floor(e)), label) <= t - sum(floor(e)) OVER ())::INT)::BIGINT AS target FROM x""")
def largest_remainder(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return splits.largest_remainder(counts, "label", "n", 0.2)


@query(f"""WITH {QUOTA_SQL}, f AS (SELECT label, subset, sum(quota) OVER (PARTITION BY label ORDER BY i) - quota AS a, sum(quota) OVER (PARTITION BY label ORDER BY i) AS b FROM q),
o AS (SELECT c_custkey, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x' || substr(sha256('42:' || c_custkey), 1, 8))::BIGINT, c_custkey) - 1 AS k FROM customer)
SELECT c_custkey, o.label, 1 AS size, subset FROM o JOIN f ON o.label = f.label AND k >= a AND k < b""")
def stratified_split(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.lit(1).alias("size"))
    return splits.assign_in_order(rows, "label", "size", "c_custkey", PARTS)


H32 = "('0x' || substr(sha256({}), 1, 8))::BIGINT"
ORDER_GROUPS = f"""o AS (SELECT o_custkey, min(o_orderpriority) AS label, count(*) AS size, {H32.format("'42:' || o_custkey")} AS draw FROM orders GROUP BY 1)"""


@query(f"""WITH RECURSIVE {ORDER_GROUPS}, c AS (SELECT label, sum(size) AS size FROM o GROUP BY 1), x AS (SELECT *, size * p AS exact FROM c, {QUOTAS}),
q AS (SELECT label, list(floor(exact)::BIGINT + (k <= missing)::BIGINT ORDER BY i) AS want FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY -(exact - floor(exact)), i) AS k,
  size - sum(floor(exact)) OVER (PARTITION BY label) AS missing FROM x) GROUP BY 1),
g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, draw, o_custkey) AS k, row_number() OVER (PARTITION BY label, size ORDER BY draw, o_custkey) - 1 AS place FROM o),
t AS (SELECT label, size, list({H32.format("'42:' || label || ':' || size || ':' || subset")} ORDER BY i) AS ties FROM (SELECT DISTINCT label, size FROM o), {QUOTAS} GROUP BY 1, 2),
walk AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS size, want, 0::BIGINT AS chosen FROM q
  UNION ALL SELECT label, k, size, list_transform(want, lambda w, i: CASE WHEN i = best.i THEN w - size ELSE w END), best.i
  FROM (SELECT w.label, g.k, g.size, w.want, list_min(list_transform(w.want, lambda x, i: {{'d': -x, 't': t.ties[i], 'i': i::BIGINT}})) AS best
    FROM walk w JOIN g ON g.label = w.label AND g.k = w.k + 1 JOIN t ON t.label = g.label AND t.size = g.size)),
m AS (SELECT label, size, chosen, count(*) AS many FROM walk WHERE k > 0 GROUP BY 1, 2, 3), n AS (SELECT *, sum(many) OVER (PARTITION BY label, size ORDER BY chosen) - many AS first FROM m)
SELECT o_custkey, g.label, g.size, v.subset FROM g JOIN n ON n.label = g.label AND n.size = g.size AND place >= first AND place < first + many JOIN {QUOTAS} ON v.i = chosen - 1""")
def greedy_group_split(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("label"), F.count("*").alias("size"))
    return splits.assign_greedily(rows, "label", "size", "o_custkey", PARTS)


@query(f"""WITH RECURSIVE {ORDER_GROUPS}, c0 AS (SELECT label, sum(size) AS n FROM o GROUP BY 1), c AS (SELECT *, round_even(sum(n) OVER () * 0.2::DOUBLE, 0) AS t FROM c0), x AS (SELECT *, n * 0.2::DOUBLE AS e FROM c),
l AS (SELECT label, n, (floor(e) + (row_number() OVER (ORDER BY -(e - floor(e)), label) <= t - sum(floor(e)) OVER ())::INT)::BIGINT AS target FROM x),
h AS (SELECT label, size, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY size) AS k FROM o GROUP BY 1, 2),
reach AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS s FROM l UNION SELECT r.label, h.k, r.s + m.m * h.size FROM reach r JOIN h ON h.label = r.label AND h.k = r.k + 1 JOIN l ON l.label = r.label
  JOIN range(1000) m(m) ON m.m <= h.c AND r.s + m.m * h.size <= l.target + (SELECT max(size) FROM h)),
sums AS (SELECT label, k, list(s) AS reached FROM reach GROUP BY 1, 2), top AS (SELECT label, max(k) AS k FROM h GROUP BY 1),
best AS (SELECT label, k, list_min(list_transform(reached, lambda s: {{'d': abs(s - target), 'o': s > target, 's': s}})).s AS rest FROM top JOIN sums USING (label, k) JOIN l USING (label)),
pick AS (SELECT label, k + 1 AS k, rest, 0::BIGINT AS m FROM best
  UNION ALL SELECT label, k, rest - m * size, m FROM (SELECT p.label, h.k, p.rest, h.size,
    list_min(list_transform(list_filter(range(h.c + 1), lambda m: list_contains(s.reached, p.rest - m * h.size)), lambda m: {{'d': abs(m * l.n - h.c * l.target), 'm': m}})).m AS m
    FROM pick p JOIN h ON h.label = p.label AND h.k = p.k - 1 JOIN sums s ON s.label = p.label AND s.k = h.k - 1 JOIN l ON l.label = p.label))
SELECT o_custkey, o.label, o.size, CASE WHEN row_number() OVER (PARTITION BY o.label, o.size ORDER BY draw, o_custkey) <= pick.m THEN 'val' ELSE 'train' END AS part
FROM o JOIN h ON h.label = o.label AND h.size = o.size JOIN pick ON pick.label = o.label AND pick.k = h.k""")
def secondary_split(spark, d):
    return splits.secondary_split(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query(f"""WITH a AS ({ORACLES["stratified_split"]}), b AS (SELECT c_custkey AS path, c_custkey // 2 AS g, CASE WHEN c_custkey % 89 = 0 THEN 'other' ELSE subset END AS subset FROM a),
c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE path % 97 = 0), l AS (SELECT path AS a, path + 1 AS b FROM b WHERE path % 50 = 0)
SELECT (SELECT count(*) FROM (SELECT path FROM c GROUP BY 1 HAVING count(*) > 1)) AS repeated_paths, (SELECT count(*) FROM c WHERE subset = 'other') AS unknown_subsets,
(SELECT count(*) FROM (SELECT g FROM c GROUP BY 1 HAVING count(DISTINCT subset) > 1)) AS torn_groups,
(SELECT count(*) FROM l JOIN b x ON x.path = l.a JOIN b y ON y.path = l.b WHERE x.subset <> y.subset) AS torn_links""")
def split_checks(spark, d):
    """Of a split with planted faults: repeated rows, an unknown subset, groups of two, links of neighbours."""
    key = F.col("c_custkey")
    rows = stratified_split(spark, d).select(key.alias("path"), F.floor(key / 2).alias("group_id"), F.when(key % 89 == 0, "other").otherwise(F.col("subset")).alias("subset"))
    rows = rows.union(rows.where("path % 97 = 0"))
    links = rows.where("path % 50 = 0").select(F.col("path").alias("a"), (F.col("path") + 1).alias("b"))
    return splits.split_violations(rows, list(PARTS), links=links)


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderpriority AS l, o_custkey AS g FROM orders), p AS (SELECT k, CASE WHEN k % 101 = 0 THEN 'x' ELSE l END AS l, CASE WHEN k % 103 = 0 THEN -g ELSE g END AS g,
  CASE WHEN k % 107 = 0 THEN 'none' WHEN g % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM m WHERE k % 109 <> 0 UNION ALL SELECT k + 1000000000, l, g, 'train' FROM m WHERE k % 113 = 0
  UNION ALL SELECT k, l, g, 'val' FROM m WHERE k % 127 = 0)
SELECT (SELECT count(*) FROM (SELECT k FROM p GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM m WHERE k NOT IN (SELECT k FROM p)) AS missing,
(SELECT count(*) FROM p WHERE k NOT IN (SELECT k FROM m)) AS extra, (SELECT count(*) FROM p JOIN m USING (k) WHERE p.l <> m.l) AS changed_labels, (SELECT count(*) FROM p JOIN m USING (k) WHERE p.g <> m.g) AS changed_groups,
(SELECT count(*) FROM p WHERE part NOT IN ('train', 'val')) AS unknown_parts, (SELECT count(*) FROM (SELECT g FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS torn_groups,
(SELECT count(*) FROM (SELECT l FROM p GROUP BY 1 HAVING abs(avg((part = 'val')::INT) - 0.2) > 0.03)) AS labels_off""")
def secondary_split_checks(spark, d):
    """Of a secondary split of orders with planted faults of every kind."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("l"), F.col("o_custkey").alias("g"))
    k, g = F.col("k"), F.col("g")
    part = F.when(k % 107 == 0, "none").when(g % 5 == 0, "val").otherwise("train")
    p = m.where(k % 109 != 0).select("k", F.when(k % 101 == 0, "x").otherwise(F.col("l")).alias("l"), F.when(k % 103 == 0, -g).otherwise(g).alias("g"), part.alias("part"))
    p = p.union(m.where(k % 113 == 0).select(k + 1_000_000_000, "l", "g", F.lit("train"))).union(m.where(k % 127 == 0).select("k", "l", "g", F.lit("val")))
    return contracts.secondary_violations(p, m, "k", "l", "g", "part", ["train", "val"], "val", 0.2)


@query("SELECT c_custkey // 10 AS bucket, count(*) AS size, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY 1 QUALIFY row_number() OVER (ORDER BY building DESC, bucket) <= 7")
def largest_clusters(spark, d):
    """The first seven rows by falling count, ties by rising key."""
    rows = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("bucket")).agg(F.count("*").alias("size"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))
    return rows.orderBy(F.desc("building"), "bucket").limit(7)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def mixed_order_numbers(spark, d):
    return prefix.numbered(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), [("o_totalprice", "desc"), "o_orderkey"], "place").select("o_orderkey", "place")


# --- views, shift ----------------------------------------------------------------------------------------------------

VIEW_SQL = """k(view_type, replicate_index) AS (SELECT 'original', 0 UNION ALL SELECT v, r::INT FROM (VALUES ('brightness'), ('contrast'), ('blur'), ('noise')) a(v), range(3) b(r)),
v AS (SELECT doc_id, view_type, replicate_index, doc_id || chr(0) || view_type || chr(0) || replicate_index AS s FROM documents, k)"""


@query(f"""WITH {VIEW_SQL} SELECT doc_id, view_type, replicate_index, substr(sha256(s), 1, 20) AS view_id,
CASE WHEN view_type <> 'original' THEN (('0x' || substr(sha256('42' || chr(0) || s), 1, 16))::UBIGINT % 9223372036854775807::UBIGINT)::VARCHAR END AS rng_seed,
CASE WHEN view_type = 'blur' THEN round(0.3::DOUBLE + ('0x' || substr(sha256('42:' || doc_id || ':blur:' || replicate_index), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1.2::DOUBLE, 6) END AS blur_sigma FROM v""")
def view_expansion(spark, d):
    out = views.create_views(table(spark, d, "documents").select("doc_id"), "doc_id")
    return out.select("doc_id", "view_type", "replicate_index", "view_id", F.col("rng_seed").cast("string").alias("rng_seed"), r6("blur_sigma").alias("blur_sigma"))


@query(f"""WITH {VIEW_SQL}, f AS (SELECT doc_id, view_type, replicate_index, CASE WHEN doc_id % 41 = 0 AND replicate_index = 1 THEN 'same' ELSE substr(sha256(s), 1, 20) END AS id,
  CASE WHEN doc_id % 37 = 0 AND view_type = 'blur' THEN 'val' ELSE 'train' END AS part FROM v WHERE NOT (doc_id % 31 = 0 AND view_type = 'noise' AND replicate_index = 2))
SELECT (SELECT count(*) FROM (SELECT doc_id FROM f GROUP BY 1 HAVING count(*) <> 13)) AS wrong_sets, (SELECT count(*) FROM (SELECT doc_id FROM f GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS crossing_splits,
(SELECT count(*) FROM (SELECT id FROM f GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids""")
def view_checks(spark, d):
    """Of views with planted faults: a view missing, originals over two parts, one id for many views."""
    out = views.create_views(table(spark, d, "documents").select("doc_id"), "doc_id")
    k, r = F.col("doc_id"), F.col("replicate_index")
    out = out.where(~((k % 31 == 0) & (F.col("view_type") == "noise") & (r == 2)))
    out = out.withColumns({"view_id": F.when((k % 41 == 0) & (r == 1), "same").otherwise(F.col("view_id")), "part": F.when((k % 37 == 0) & (F.col("view_type") == "blur"), "val").otherwise("train")})
    return views.view_violations(out, "doc_id", 13, "part")


@query("SELECT doc_id FROM documents WHERE doc_id % 31 = 0 OR doc_id % 43 = 0")
def view_order_checks(spark, d):
    """Originals whose views aren't the expected list in order; planted: one view missing, two exchanged."""
    out = views.create_views(table(spark, d, "documents").select("doc_id"), "doc_id")
    kinds = [("original", 0), *[(v, r) for v in views.VIEWS for r in range(3)]]
    at = F.array_position(F.array(*[F.lit(f"{v}:{r}") for v, r in kinds]), F.concat_ws(":", "view_type", "replicate_index"))
    k = F.col("doc_id")
    out = out.withColumn("at", F.when((k % 43 == 0) & (at > 11), 25 - at).otherwise(at)).where((k % 31 != 0) | (F.col("at") != 5))
    return contracts.out_of_order(out, "doc_id", "at", ["view_type", "replicate_index"], kinds)


@query(f"""WITH {LOGITS}, r AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE pred END AS pred, seed FROM p WHERE vec_id % 13 <> 0)
SELECT 'key' AS "column", (SELECT count(*) FROM p WHERE vec_id % 13 = 0) AS differences UNION ALL SELECT 'label', 0 UNION ALL SELECT 'pred', (SELECT count(*) FROM r JOIN p USING (vec_id) WHERE r.pred <> p.pred) UNION ALL SELECT 'seed', 0""")
def alignment_checks(spark, d):
    rows = logits(spark, d).select("vec_id", "label", "pred", "seed")
    other = rows.where("vec_id % 13 <> 0").withColumn("pred", F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("pred")))
    return contracts.misaligned(rows, other, "vec_id", ["label", "pred", "seed"])


@query(f"""WITH {LOGITS} SELECT count(*) FILTER (vec_id % 17 = 0) AS wrong_flags, count(*) FILTER (vec_id % 19 = 0 OR vec_id % 23 = 0) AS not_finite FROM p""")
def value_checks(spark, d):
    """Of predictions with planted faults: turned flags, a NaN in the logits, an infinite score."""
    k = F.col("vec_id")
    rows = logits(spark, d).withColumn("error", ((F.col("pred") != F.col("label")) != (k % 17 == 0)).cast("int"))
    rows = rows.withColumns({"logits": F.when(k % 19 == 0, F.array_append("logits", F.lit(float("nan")))).otherwise(F.col("logits")), "score": F.when(k % 23 == 0, F.lit(float("inf"))).otherwise(S.msp("probs"))})
    return contracts.value_violations(rows, "pred", "label", "error", ["logits"], ["score"])


@query("SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS in_none, count(*) FILTER (quality = 1 AND toxic = 1) AS in_several FROM labels")
def partition_checks(spark, d):
    return contracts.partition_violations(table(spark, d, "labels"), [F.col("quality") == 1, F.col("toxic") == 1])


@query("""SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0
UNION ALL SELECT 'settings', 'changed' UNION ALL SELECT l || ':' || t, 'no setting' FROM (VALUES ('en'), ('fr'), ('it')) a(l), (VALUES ('0'), ('1')) b(t) WHERE l = 'it' OR (l = 'fr' AND t = '1')
UNION ALL SELECT n_name, 'result exists' FROM nation WHERE n_regionkey = 1""")
def freeze_preflight(spark, d):
    """Against a record: files missing and changed, settings changed and incomplete, results that exist."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    grid = spark.sql("SELECT * FROM VALUES ('en', 0), ('en', 1), ('fr', 0), ('fr', 1), ('it', 0), ('it', 1) AS t(lang, toxic)")
    settings = grid.where("lang <> 'it'").withColumn("tau", F.when(F.concat("lang", "toxic") != "fr1", F.lit(0.5)))
    record = contracts.freeze_record(files, settings.na.fill(0.25))
    k = F.col("path").cast("long")
    now = contracts.freeze_record(files.where(k % 7 != 0).withColumn("sha256", F.when(k % 5 == 0, "0").otherwise(F.col("sha256"))), settings)
    return contracts.preflight(record, now, settings, grid, table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name")))


@query("SELECT source, count(DISTINCT CASE WHEN toxic = 1 THEN lang END) AS toxic_langs, count(DISTINCT CASE WHEN quality = 0 THEN doc_id END) AS poor FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def filtered_distinct(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("lang"))).alias("toxic_langs"), F.countDistinct(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("poor"))


SHIFT = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(64)) AS dim FROM e), st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE label < 5 GROUP BY 1),
z AS (SELECT vec_id, label, dim, (x - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END AS z FROM l JOIN st USING (dim)),
c AS (SELECT vec_id, label < 5 AS src, sqrt(sum(z * z) / 64) AS d FROM z GROUP BY ALL)"""


def z_scored(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("domain", F.when(F.col("label") < 5, "source").otherwise("target"))
    return shift.standardised(rows, shift.column_stats(rows.where("domain = 'source'"), "embedding"), "embedding")


@query(f"WITH {SHIFT} SELECT vec_id, round(d, 6) AS centre_distance FROM c")
def centre_distance(spark, d):
    return z_scored(spark, d).select("vec_id", r6(shift.centre_distance("z")).alias("centre_distance"))


@query(f"""WITH {SHIFT}, q AS (SELECT quantile_cont(d, 0.95::DOUBLE) FILTER (src) AS p FROM c),
r AS (SELECT src, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS r FROM c)
SELECT (SELECT round(quantile_cont(d, 0.5::DOUBLE) FILTER (src), 6) FROM c) AS source_p50, (SELECT round(quantile_cont(d, 0.5::DOUBLE) FILTER (NOT src), 6) FROM c) AS target_p50,
(SELECT round(avg((d > p)::INT) FILTER (NOT src), 6) FROM c, q) AS beyond_p95,
(SELECT round((sum(r) FILTER (NOT src) - count(*) FILTER (NOT src) * (count(*) FILTER (NOT src) + 1) / 2) / (count(*) FILTER (NOT src) * count(*) FILTER (src)), 6) FROM r) AS auroc,
(SELECT round(avg((abs(m) > 1)::INT), 6) FROM (SELECT dim, avg(z) AS m FROM z WHERE label >= 5 GROUP BY 1)) AS shifted_share""")
def feature_shift(spark, d):
    z = z_scored(spark, d)
    out = shift.shift_summary(z.withColumn("distance", shift.centre_distance("z")), "domain", "distance")
    share = shift.shifted_share(z.where("domain = 'target'"))
    return out.crossJoin(share).select(*[r6(c).alias(c) for c in ("source_p50", "target_p50", "beyond_p95", "auroc", "shifted_share")])


@query("""WITH p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2))) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.label < 5 WHERE a.label >= 5) SELECT vec_id, round(sqrt(min(d)), 5) AS nearest FROM p GROUP BY 1""")
def nearest_source(spark, d):
    rows = table(spark, d, "embeddings").withColumn("z", F.transform("embedding", lambda x: x.cast("double")))
    out = shift.nearest_distance(rows.where("label >= 5"), rows.where("label < 5"), "vec_id", exclude_self=True)
    return out.select("vec_id", F.round("nearest", 5).alias("nearest"))


@query(f"""WITH {SHIFT}, v AS (SELECT vec_id, label < 5 AS src, list(z ORDER BY dim) AS z FROM z GROUP BY ALL),
n AS (SELECT a.vec_id, a.src, sqrt(min(list_sum(list_transform(list_zip(a.z, b.z), lambda x: pow(x[1] - x[2], 2))))) AS d FROM v a JOIN v b ON b.src AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT round(quantile_cont(d, 0.5::DOUBLE) FILTER (src), 5) AS source_p50, round(quantile_cont(d, 0.5::DOUBLE) FILTER (NOT src), 5) AS target_p50,
round((SELECT avg((d > (SELECT quantile_cont(d, 0.95::DOUBLE) FROM n WHERE src))::INT) FROM n WHERE NOT src), 6) AS beyond_p95 FROM n""")
def nearest_shift(spark, d):
    z = saved(z_scored(spark, d).select("vec_id", "domain", "z"))
    near = shift.nearest_distance(z, z.where("domain = 'source'"), "vec_id", exclude_self=True).join(z.select("vec_id", "domain"), "vec_id")
    out = shift.shift_summary(saved(near), "domain", "nearest")
    return out.select(F.round("source_p50", 5).alias("source_p50"), F.round("target_p50", 5).alias("target_p50"), r6("beyond_p95").alias("beyond_p95"))


@query()
def principal_components(spark, d):
    return shift.principal_components(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding", F.col("label") < 5)[0]


# --- provenance, learning, streaming ---------------------------------------------------------------------------------


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents""")
def digest_check(spark, d):
    recorded = manifest(spark, d).select("path", "sha256")
    now = recorded.where("path % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 5 == 0, F.lit("0")).otherwise(F.col("sha256")))
    return provenance.verify_digests(recorded, now)


@query("SELECT l AS lang, t::INT AS toxic FROM (VALUES ('en'), ('fr'), ('it')) a(l), (VALUES (0), (1)) b(t) WHERE (l, t) NOT IN (SELECT lang, toxic FROM documents JOIN labels USING (doc_id))")
def settings_complete(spark, d):
    have = judged_documents(spark, d).select("lang", F.col("error").alias("toxic")).distinct()
    return provenance.incomplete(have, {"lang": ["en", "fr", "it"], "toxic": [0, 1]})


@query("SELECT n_nationkey, n_regionkey, 'observed only' AS side FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_regionkey, 'expected only' FROM nation WHERE n_regionkey = 0")
def table_differences(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return provenance.differences(n.where("n_regionkey <> 1"), n.where("n_regionkey <> 0"))


@query(f"""WITH {LOGITS} SELECT seed, label, count(*) AS n, count(*) FILTER (list_position(z, list_max(z)) - 1 <> label) AS wrong FROM z GROUP BY 1, 2""")
def label_gate(spark, d):
    """Predictions are written and committed, their digest recorded; labels are joined once all gates are passed."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    provenance.write_committed(logits(spark, d).select("vec_id", "seed", "pred"), path)
    sealed = provenance.manifest_digest(spark, path)
    truth = lambda: table(spark, d, "embeddings").select("vec_id", "label")
    out = provenance.opened_labels(spark, {path: sealed}, truth, "vec_id", [f"{path}-results"])[path]
    return out.groupBy("seed", "label").agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col("label")).alias("wrong"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def array_bundle(spark, d):
    """Vectors as a folder of array bundles, and back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-bundles"
    arrays.save_arrays(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path, "vec_id", rows=1000)
    back = arrays.load_arrays(spark, path, partition_rows=500)
    return back.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("""WITH c AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 16) AS c FROM range(8) a(u), range(8) b(x)),
g AS (SELECT vec_id, (k // 8) AS y, k % 8 AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings)),
h AS (SELECT vec_id, y, u, sum(v * c) AS s FROM g JOIN c USING (x) GROUP BY ALL), f AS (SELECT vec_id, c.u AS p, h.u AS q, sum(s * c) AS s FROM h JOIN c ON c.x = h.y GROUP BY ALL),
m AS (SELECT vec_id, p, (s > median(s) OVER (PARTITION BY vec_id))::INT << (7 - q)::INT AS b FROM f), w AS (SELECT vec_id, p, sum(b) AS b FROM m GROUP BY 1, 2)
SELECT vec_id, string_agg(lpad(lower(to_hex(b::BIGINT)), 2, '0'), '' ORDER BY p) AS hash FROM w GROUP BY 1""")
def dct_hashes(spark, d):
    """Hashes of vectors taken as grey pictures of 8 x 8."""
    return table(spark, d, "embeddings").select("vec_id", images.dct_hash("embedding", side=8).alias("hash"))


@query(f"""WITH {SIGNS}, w AS (SELECT n.*, (vec_id_a + vec_id_b) % 5 = 0 AS reviewed, (label_a < 5) <> (label_b < 5) AS other FROM n)
SELECT vec_id_a, vec_id_b, distance FROM w WHERE (distance = 17 OR other) AND NOT reviewed""")
def review_queue(spark, d):
    """Pairs still to be reviewed: at one distance, or across domains."""
    pairs = labelled_pairs(spark, d)
    half = lambda c: F.when(F.col(c) < 5, "source").otherwise("target")
    pairs = saved(pairs).withColumn("scope", audit.pair_scope(half("label_a"), half("label_b")))
    known = pairs.where((F.col("vec_id_a") + F.col("vec_id_b")) % 5 == 0).select(F.col("vec_id_b").alias("vec_id_a"), F.col("vec_id_a").alias("vec_id_b"))
    return audit.to_review(audit.with_reviewed(pairs, known, "vec_id_a", "vec_id_b"), [17]).select("vec_id_a", "vec_id_b", "distance")


@query("""SELECT count(*) FILTER (d = '') AS empty, count(*) FILTER (d NOT IN ('', 'user', 'assistant')) AS invalid
FROM (SELECT lower(trim(CASE WHEN turn % 4 = 3 THEN '  ' WHEN turn % 3 = 0 THEN ' ' || upper(role) ELSE role END)) AS d FROM conversations)""")
def decision_states(spark, d):
    """Entries typed by hand, trimmed and lower-cased: how many are empty, how many not allowed."""
    turn = F.col("turn")
    typed = F.when(turn % 4 == 3, "  ").when(turn % 3 == 0, F.concat(F.lit(" "), F.upper("role"))).otherwise(F.col("role"))
    return audit.checked_decisions(table(spark, d, "conversations").select(typed.alias("decision")), ["user", "assistant"])[1]


@query("SELECT l_linestatus, round(avg(rate), 6) AS mean_rate FROM (SELECT l_linestatus, l_suppkey % 3 AS g, avg((l_returnflag = 'R')::INT) AS rate FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def seed_means(spark, d):
    """A metric of each group, averaged over groups and not over rows."""
    rates = table(spark, d, "lineitem").groupBy("l_linestatus", (F.col("l_suppkey") % 3).alias("g")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate"))
    return metrics.mean_over(rates, ["l_linestatus"], ["rate"]).select("l_linestatus", r6("mean_rate").alias("mean_rate"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / 64, 5) AS difference,
CASE a.label WHEN 0 THEN 'healthy' WHEN 1 THEN 'scab' WHEN 2 THEN 'rust' END AS name FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pixel_differences(spark, d):
    """Mean absolute difference of each vector to the next, and class names by index (null beyond the names)."""
    rows = table(spark, d, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    wide = F.transform("embedding", lambda x: x.cast("double")), F.transform("next", lambda x: x.cast("double"))
    return rows.join(after, "vec_id").select("vec_id", F.round(S.mean_abs_difference(*wide), 5).alias("difference"), S.class_name("label", ["healthy", "scab", "rust"]).alias("name"))


@query()
def failure_head(spark, d):
    rows = logits(spark, d).withColumns({"failure": (F.col("pred") != F.col("label")).cast("int"), "x": F.concat("logits", "probs")})
    return learn.head_scores(rows, learn.train_heads(rows, "seed", "x", "failure"), "seed", "x").select("vec_id", "seed", "failure", "head_score")


@query()
def failure_head_stopped(spark, d):
    """The head that was best on every fifth vector, which it isn't trained on."""
    rows = logits(spark, d).withColumns({"failure": (F.col("pred") != F.col("label")).cast("int"), "x": F.concat("logits", "probs"), "held": F.col("vec_id") % 5 == 0})
    heads = learn.train_heads(rows, "seed", "x", "failure", checked="held")
    return learn.head_scores(rows, heads, "seed", "x").select("vec_id", "seed", "failure", "head_score")


@query()
def failure_grid(spark, d):
    """Ranking metrics on every fifth vector, with intervals of the average precision over 500 resamples of originals (30
    numbers in a row), of untrained scores, a logistic reference, and heads over three sets of inputs by two recipes."""
    rows = logits(spark, d).withColumns({"error": (F.col("pred") != F.col("label")).cast("int"), "held": F.col("vec_id") % 5 == 0, "original": F.floor(F.col("vec_id") / 30)})
    rows = saved(rows.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id"))
    wide = rows.where("held").withColumns({"msp": 1 - F.array_max("probs"), "entropy": S.entropy("probs"), "margin": S.margin("probs")})
    named = {"inputs": F.lit("logits"), "recipe": F.lit("none"), "epochs_used": F.lit(None).cast("long")}
    plain = metrics.method_scores(wide, ["seed", "original", "error"], {m: m for m in ("msp", "entropy", "margin")}).withColumns(named)
    models = learn.logistic_models(rows.where("NOT held"), "seed", "logits", "error")
    logistic = learn.logistic_scores(rows.where("held"), models, "seed", "logits").select("seed", "original", "error", F.lit("logistic").alias("method"), "score").withColumns(named)
    inputs = {"logits": "logits", "features": "embedding", "features and logits": F.concat(F.col("embedding").cast("array<double>"), "logits")}
    heads = learn.head_grid(rows, "seed", ["original"], inputs, "error", "held").withColumn("method", F.lit("head"))
    keys = ["seed", "method", "inputs", "recipe"]
    every = saved(plain.unionByName(logistic).unionByName(heads))
    used = every.groupBy(*keys).agg(F.max("epochs_used").alias("epochs_used"))
    low_high = metrics_intervals(every, keys, resamples=500)
    return metrics.ranking_metrics(every, keys).join(used, keys).join(low_high, keys).select(*keys, "epochs_used", "n", "errors", "auroc", "auprc", "auprc_low", "auprc_high")


def metrics_intervals(scored: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """Intervals of the average precision over resamples of originals, those without both outcomes left out."""
    reps = resample.replicates(scored, saved(resample.draws(scored, "original", resamples, seed=12345)), keys, "original")
    return resample.intervals(reps.where("errors > 0 AND errors < n"), keys, ["auprc"])


@query()
def failure_logistic(spark, d):
    """The logistic reference of each seed: term 0 is the intercept, the others are of standardised logits."""
    rows = logits(spark, d).withColumn("failure", (F.col("pred") != F.col("label")).cast("int"))
    models = learn.logistic_models(rows, "seed", "logits", "failure")
    return models.select("seed", F.posexplode("weights").alias("term", "weight"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streaming.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def global_row_numbers(spark, d):
    return prefix.numbered(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents")
def hash_uniform(spark, d):
    return table(spark, d, "documents").select("doc_id", H.uniform(F.lit(7), F.col("doc_id")).alias("u"))
