"""Language ID: a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of WINDOW bytes, the whole text, the last window padded. Filters of several widths slide
over the bytes of a window; each filter's maximum over the window, rectified, feeds a softmax over the languages. A
document's probabilities are the mean over its windows, weighted by their bytes.

A filter of width 2 is a table over byte pairs, one of width 4 the sum of two such tables: a convolution is then one
or two table reads per position, for all filters at once. Training sees a bounded sample of labelled rows
(SAMPLE_PER_LANG per language, by a hash of the id), of each a few pieces drawn from anywhere in its text; prediction
never sees a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import in_portions, table

WINDOW = 256
FILTERS = 24
WIDTHS = (2, 4)
#: The bound of the training sample: rows per language, pieces per row, and rows in all; of so many languages that the
#: last bound binds, each has fewer rows, but none is left out. The first piece of a row is as long as a window, the
#: others have lengths from SHORTEST characters on.
SAMPLE_PER_LANG, PIECES_PER_ROW, SAMPLE_ROWS, SHORTEST = 400, 3, 80_000, 12
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
#: Texts are taken together up to so many characters.
TOGETHER = 1_000_000


@dataclass
class Network:
    """taps: for each width, one (256, FILTERS) table per byte position; head: (filters in all, languages)."""

    langs: list[str]
    taps: dict[int, list[np.ndarray]]
    bias: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; the last window is padded with zeros, which count as any other byte."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima of all filters over the windows x, and where they are."""
    best, where = [], []
    for width, taps in net.taps.items():
        n = x.shape[1] - width + 1
        z = taps[0][x[:, :n]]
        for k in range(1, width):
            z += taps[k][x[:, k : k + n]]
        at = z.argmax(axis=1)
        where.append(at)
        best.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
    return np.concatenate(best, axis=1) + net.bias, where


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def trained(samples: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """A network from (piece of text, language) pairs: Adam on the cross-entropy of the first window of each."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return Network([], {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    place = {lang: i for i, lang in enumerate(langs)}
    x = np.array([windows_of(text.encode())[0] for text, _ in samples])
    y = np.array([place[lang] for _, lang in samples])
    f32 = lambda a: a.astype(np.float32)
    net = Network(
        langs,
        {w: [f32(rng.normal(0, 0.3, (256, FILTERS))) for _ in range(w)] for w in WIDTHS},
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        f32(rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))),
        np.zeros(len(langs), np.float32),
    )
    weights = [t for taps in net.taps.values() for t in taps] + [net.bias, net.head, net.head_bias]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            own, target = x[rows], y[rows]
            z, where = pooled(net, own)
            h = np.maximum(z, 0)
            p = softmax(h @ net.head + net.head_bias)
            p[np.arange(len(rows)), target] -= 1
            p /= len(rows)
            dh = (p @ net.head.T) * (z > 0)
            grads = []
            for k, (width, taps) in enumerate(net.taps.items()):
                part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for tap in range(width):
                    g = np.zeros_like(taps[tap])
                    np.add.at(g, (own[np.arange(len(rows))[:, None], where[k] + tap], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
            grads += [dh.sum(axis=0), h.T @ p, p.sum(axis=0)]
            step += 1
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def pair_tables(net: Network) -> list[np.ndarray]:
    """For each width, tables over byte pairs (65536, FILTERS); an odd last tap has a table over single bytes."""
    out = []
    for taps in net.taps.values():
        tables = [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(taps) - 1, 2)]
        out.append(tables + ([taps[-1]] if len(taps) % 2 else []))
    return out


def probabilities(net: Network, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Softmax of each window of x, as pooled() gives it, by way of the pair tables."""
    pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    best = []
    for width, own in zip(net.taps, tables, strict=True):
        n = x.shape[1] - width + 1
        z = own[0][pairs[:, :n]]
        for k, part in enumerate(own[1:], 1):
            z += part[pairs[:, 2 * k : 2 * k + n]] if part.shape[0] > 256 else part[x[:, 2 * k : 2 * k + n]]
        best.append(z.max(axis=1))
    h = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
    return softmax(h @ net.head + net.head_bias)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def classify(net: Network, tables, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; windows of several texts are taken together."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    own = [(i, t.encode()) for i, t in enumerate(texts) if t and has_letter(t)]
    if not own or not net.langs:
        return out
    sums = np.zeros((len(own), len(net.langs)))
    flat = [(k, w) for k, (_, t) in enumerate(own) for w in [windows_of(t)]]
    x = np.concatenate([w for _, w in flat])
    doc = np.repeat(np.arange(len(own)), [len(w) for _, w in flat])
    size = np.full(len(x), WINDOW, np.float64)
    last = np.cumsum([len(w) for _, w in flat]) - 1
    size[last] = [(len(t) - 1) % WINDOW + 1 for _, t in own]
    for a in range(0, len(x), 128):
        b = slice(a, a + 128)
        np.add.at(sums, doc[b], probabilities(net, tables, x[b]) * size[b, None])
    sums /= sums.sum(axis=1, keepdims=True)
    for k, (i, _) in enumerate(own):
        best = int(sums[k].argmax())
        out[i] = (net.langs[best], float(sums[k, best]))
    return out


def training_sample(docs: DataFrame, usable, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """(piece, language): PIECES_PER_ROW pieces of at most SAMPLE_PER_LANG different rows of each language, those with the
    smallest hashes of id and text; the places of pieces in the whole texts are drawn by the same hash. Rows that are equal
    in both count once, so every language with a usable row is learned, however often its rows are repeated. Rows without
    a label or without a letter teach nothing; without any other, the sample is empty."""
    rows = docs.where(usable).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    draws = saved(rows.select("lang", "draw").distinct())
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, draws.select("lang").distinct().count())))
    # each task keeps the smallest of a language that it sees, before a language's rows meet
    chosen = draws.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= each)
    rows = rows.join(saved(chosen), ["lang", "draw"]).groupBy("lang", "draw", "rank").agg(F.min("text").alias("text"))
    size = lambda k: F.lit(WINDOW) if k == 0 else SHORTEST + F.pmod(F.xxhash64("draw", F.lit(2 * k)), F.lit(WINDOW - SHORTEST))
    start = lambda k: 1 + F.pmod(F.xxhash64("draw", F.lit(2 * k + 1)), F.greatest(F.lit(1), F.length("text") - size(k) + 1))
    pieces = F.array_distinct(F.array(*[F.substring("text", start(k).cast("int"), size(k).cast("int")) for k in range(PIECES_PER_ROW)]))
    rows = rows.select("lang", "rank", F.explode(pieces).alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    return [(r["piece"], r["lang"]) for r in rows.orderBy("lang", "rank", "piece").select("piece", "lang").collect()]


def predicted(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score. A null or empty text, or one without a letter, is `und` with score 0; so is every
    text if nothing was there to learn from. Of languages with equal scores the first by name is taken. Texts of any
    length are read whole; repeated rows are judged alike; an empty table gives an empty one. Columns of these names are
    replaced, others passed on; none may be named _judged."""
    held = docs.sparkSession.sparkContext.broadcast(vars(net))  # plain arrays; the pair tables are made on the worker: 65536 x FILTERS floats each

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Network(**held.value)
        tables = pair_tables(own) if own.langs else []
        for batch in batches:
            langs, scores = zip(*[x for texts in in_portions(batch.to_pylist(), TOGETHER) for x in classify(own, tables, texts)], strict=True) if len(batch) else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # not to be run again for a filter on its result
    judge = F.arrow_udf(judge, "lang_pred string, score double").asNondeterministic()
    return docs.drop("lang_pred", "score").withColumn("_judged", judge(F.col(text_col).cast("string"))).select("*", "_judged.lang_pred", "_judged.score").drop("_judged")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each row of `documents`, learned from labelled rows that aren't held out. Null texts and those
    without a letter are `und`; rows with null ids are learned from; repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    net = trained(training_sample(docs, ~held_out()))
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
