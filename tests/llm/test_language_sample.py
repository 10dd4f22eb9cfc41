import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import language_id

DIR = "/root/testdata/sf0.001"


def plain_forward(net, text):
    """(language, score) filter by filter and place by place."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, total = text.encode(), np.zeros(len(net.langs))
    for at in range(0, len(raw), language_id.WINDOW):
        own = raw[at : at + language_id.WINDOW]
        window = own + bytes(language_id.WINDOW - len(own))
        hidden = []
        for width, taps in net.taps.items():
            best = [max(sum(float(taps[k][window[i + k], f]) for k in range(width)) for i in range(len(window) - width + 1)) for f in range(language_id.FILTERS)]
            hidden += best
        hidden = np.maximum(np.array(hidden) + net.bias, 0)
        z = hidden @ net.head + net.head_bias
        e = np.exp(z - z.max())
        total += e / e.sum() * len(own)
    total /= total.sum()
    return net.langs[int(total.argmax())], float(total.max())


def test_query_equals_plain_forward(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    net = language_id.trained(language_id.training_sample(docs, ~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.op7_language_id(spark, DIR).collect()}
    assert len(got) == docs.count()
    for r in docs.collect()[:60]:
        lang, score = plain_forward(net, r["text"])
        own = got[r["doc_id"]]
        assert own["lang_pred"] == lang and own["score"] == pytest.approx(score, abs=1e-4)
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_no_language_is_lost(spark):
    """A language that consists of one row, repeated very often, is learned, whatever its hash; so are rare ones."""
    some = [(i, f"le mot {i} et la phrase", "fr") for i in range(1500)] + [(10_000 + i, f"the word {i} and the line", "en") for i in range(1500)]
    base = spark.createDataFrame(some, "doc_id long, text string, lang string")
    for word in ("xora", "yonda", "zib", "wam", "vuk"):
        copies = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(f"{word} {word} mili").alias("text"), F.lit("xx").alias("lang"))
        sample = language_id.training_sample(base.union(copies), ~language_id.held_out())
        by_lang = {lang: [t for t, own in sample if own == lang] for lang in ("en", "fr", "xx")}
        assert by_lang["xx"] and all(len(by_lang[x]) >= language_id.SAMPLE_PER_LANG for x in ("en", "fr"))


def test_sample_keeps_the_smallest_before_rows_meet(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    own = docs.select("lang", F.xxhash64("doc_id", "text").alias("draw")).distinct()
    from pyspark.sql import Window

    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= language_id.SAMPLE_PER_LANG)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
