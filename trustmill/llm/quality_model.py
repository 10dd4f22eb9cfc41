"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text is described by some twenty statistics. Cosines of random projections of these approximate a Gaussian kernel,
in which a ridge regression on the labels is linear: all it needs are the sums of products of the features, taken per
partition and added up by Spark, and solved on the driver, whose share is bounded by the number of features. Sums are
kept by fold, so the penalty is chosen, and scores of rows that a fit has not seen are made, without another fit over
the rows. The scores that each fold gets from the others' fit are then made probabilities by the least-squares rising
function of the score (pooling of adjacent violators over a fine histogram of all of them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import table

#: Random features; folds of the labelled rows, by a hash of the text, so that copies are in one; bins of the histogram
#: of scores, over a range that most scores of labels 0 and 1 are in (those outside count to the first and last).
FEATURES, FOLDS, BINS, RANGE = 256, 4, 2000, (-0.5, 1.5)
#: Penalties tried, by labelled row; statistics are cut at so many standard deviations.
PENALTIES, FARTHEST = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1), 4.0
THRESHOLD = 0.7
#: Classes of bytes whose shares are statistics: A-Z, a-z, digits, bytes of other letters, and groups of signs.
BYTES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"#*$%&", b"<>|", b"!?", b".,;:", b"\n", b"()[]{}'\"/\\_=+-@^~`"]
NAMES = ["words", "bytes", "word_length", "word_length_spread", "entropy", "distinct", "distinct_pairs", "repeats", "commonest", "repeated_lines", "words_a_line"] + [f"byte_class_{i}" for i in range(len(BYTES))]
_CLASS = np.array([[b in some for some in BYTES] for b in range(256)], float)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, as NAMES has them; of one without words, zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    many = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = many[many > 0] / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    return [
        np.log1p(n), np.log1p(len(raw)), sizes.mean(), sizes.std(), -(share * np.log(share)).sum(),
        len(counts) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), *(many @ _CLASS / len(raw)),
    ]


def described(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """docs plus the statistics of each text (array of doubles). Texts of any length are read whole; nulls count as empty;
    repeated rows are described alike; other columns are passed on."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([list(map(float, statistics(t))) for t in map(pa.StringScalar.as_py, batch)], pa.list_(pa.float64()))

    return docs.withColumn(out, F.arrow_udf(run, "array<double>").asNondeterministic()(F.col(text_col).cast("string")))


def summed(df: DataFrame, columns: list[str], sums: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of rows of sums(arrays of the columns), size numbers: added up within each partition, then
    number by number by Spark. What reaches the driver doesn't grow with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(*[_numbers(batch.column(c)) for c in columns])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    out = np.zeros(size)
    for row in df.select(*columns).mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def rising(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, value) of the rising function with the least weighted squares: adjacent values that fall are pooled.
    score must rise."""
    blocks: list[list[float]] = []  # sum of weights, of weighted labels, first and last score
    for s, y, w in zip(score, label, weight, strict=True):
        blocks.append([w, w * y, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w1, y1, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w1, blocks[-1][1] + y1, blocks[-1][2], last]
    at = np.array([x for b in blocks for x in b[2:]])
    return at, np.repeat([b[1] / b[0] for b in blocks], 2)


@dataclass
class Model:
    """weights: the fit over all rows, and those that leave out a fold each; knots: of the calibration."""

    mean: np.ndarray
    std: np.ndarray
    turns: np.ndarray
    shift: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    others: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines of the standardised statistics, and a one."""
        z = np.clip((x - self.mean) / self.std, -FARTHEST, FARTHEST)
        return np.hstack([np.cos(z @ self.turns + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = np.concatenate([self.features(x[i : i + 4096]) @ self.weights for i in range(0, len(x), 4096)])
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def _solved(products: np.ndarray, with_label: np.ndarray, rows: float, penalty: float) -> np.ndarray:
    cost = np.full(len(products), penalty * rows)
    cost[-1] = 1e-9 * rows  # the constant is free
    return np.linalg.solve(products + np.diag(cost), with_label)


def fitted(rows: DataFrame, features: int = FEATURES, seed: int = 13) -> Model:
    """A model of rows (stats array<double>, label double, fold int): every row counts. Without rows, every text's score
    is 0.5; if all labels are the same, it is that label."""
    k = len(NAMES)
    first = summed(rows, ["stats"], lambda x: np.concatenate([[len(x)], x.sum(0)]), k + 1)
    n = first[0]
    rng = np.random.default_rng(seed)
    # a kernel as wide as two typical texts are apart
    model = Model(first[1:] / max(n, 1), np.ones(k), rng.normal(0, 1 / np.sqrt(k), (k, features)), rng.uniform(0, 2 * np.pi, features))
    if not n:
        return model
    mean = model.mean
    spread = np.sqrt(summed(rows, ["stats"], lambda x: ((x - mean) ** 2).sum(0), k) / n)
    model.std = np.where(spread > 1e-9, spread, 1.0)

    d = features + 1
    cells = d * d + d + 2

    def normal_equations(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((FOLDS, cells))
        for i in range(0, len(x), 4096):
            z, own, part = model.features(x[i : i + 4096]), y[i : i + 4096], fold[i : i + 4096]
            for f in np.unique(part):
                a, b = z[part == f], own[part == f]
                out[f] += np.concatenate([(a.T @ a).ravel(), a.T @ b, [b @ b, len(b)]])
        return out.ravel()

    by_fold = summed(rows, ["stats", "label", "fold"], normal_equations, FOLDS * cells).reshape(FOLDS, cells)
    parts = lambda v: (v[: d * d].reshape(d, d), v[d * d : -2], v[-2], v[-1])
    whole = by_fold.sum(0)

    def left_out(penalty: float) -> tuple[float, np.ndarray]:
        """The squared error of each fold under the others' fit, and these fits."""
        error, fits = 0.0, []
        for own in by_fold:
            a, b, _, rest = parts(whole - own)
            w = _solved(a, b, rest, penalty) if rest > 0.5 else np.zeros(d)
            a, b, yy, _ = parts(own)
            error += yy - 2 * w @ b + w @ a @ w
            fits.append(w)
        return error, np.array(fits)

    tried = [left_out(p) for p in PENALTIES]
    best = int(np.argmin([e for e, _ in tried]))
    a, b, _, _ = parts(whole)
    model.weights, model.others = _solved(a, b, n, PENALTIES[best]), tried[best][1]

    low, high = RANGE

    def histogram(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((3, BINS))
        for i in range(0, len(x), 4096):
            s = (model.features(x[i : i + 4096]) * model.others[fold[i : i + 4096]]).sum(1)
            at = np.clip((s - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
            for j, v in enumerate((np.ones(len(s)), y[i : i + 4096], s)):
                out[j] += np.bincount(at, v, BINS)
        return out.ravel()

    many, ones, scores = summed(rows, ["stats", "label", "fold"], histogram, 3 * BINS).reshape(3, BINS)
    full = many > 0.5
    model.knots = rising(scores[full] / many[full], ones[full] / many[full], many[full])
    return model


def scored(described: DataFrame, model: Model, stats: str = "stats") -> DataFrame:
    """A column score (0 to 1, the share of label 1 among texts like this one) beside the statistics."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(_numbers(batch)) if len(batch) else np.zeros(0))

    return described.withColumn("score", F.arrow_udf(run, "double")(F.col(stats)))


def labelled(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_hash: str = "text_hash") -> DataFrame:
    """Rows for fitted(): those with an id that has a label, the mean of the id's labels if there are several."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    own = described.select(F.col(id_col).alias("_id"), "stats", F.pmod(F.col(text_hash), F.lit(FOLDS)).cast("int").alias("fold"))
    return saved(own.join(known, "_id").drop("_id"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of `documents`, learned from the labels of rows that aren't held out. Null and empty texts are
    scored as texts without words; rows with null ids teach nothing; repeated rows get one score; other columns are
    ignored; an empty table gives an empty one, and without labels all scores are 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    own = saved(described(docs).drop("text"))
    model = fitted(labelled(own.where("NOT held_out"), table(spark, sf_dir, "labels")))
    out = scored(own, model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
