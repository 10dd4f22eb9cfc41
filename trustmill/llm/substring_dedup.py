"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

A window of WINDOW words is removed where the same words also start in a document with a smaller id; overlapping
removed windows merge into maximal intervals.

Each scan hashes every window, rolling modulo 2^64, in numpy. Consecutive windows that share the smallest hash of the
ANCHOR-word windows inside them form a run. That anchor is a function of the window's words alone, so equal windows
always have equal anchors, and windows whose anchor is in one document only need no further look. Runs, about one for
18 windows, are what is counted: first by anchor, then, where an anchor occurs in several documents, by anchor and
the hash of the whole run. A run that an earlier document holds too goes as a whole. Only the first holder of each
kind of run, where an anchor has several kinds, is counted window by window. Nothing is sampled: the runs are a
lossless grouping, and every decision is taken on 128 bits (anchor and run, or anchor and window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import small_batches, table, words_of

WINDOW, ANCHOR = 50, 16
#: Words hashed at once: bounds the workers' memory. A single longer text is taken alone.
CHUNK_WORDS = 100_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHashes:
    """Hashes of all windows of a sequence of words, of any length, from one pass of prefix sums modulo 2^64."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        self.n = n
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(word_hashes) * down[:n], dtype=np.uint64)])

    def windows(self, length: int) -> np.ndarray:
        return mix((self.sums[length:] - self.sums[:-length]) * self.up[length - 1 : self.n]) if self.n >= length else np.empty(0, np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from start (inclusive) to end (exclusive), length included."""
        return mix((self.sums[end] - self.sums[start]) * self.up[end - 1] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    # bytes.split() breaks at exactly the six ASCII blanks; lone surrogates can't be in a Spark string
    return text.encode().split() if text else []


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, hashes, size = [], [], 0
    for batch in batches:
        for i, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            words = split_words(text.as_py())
            if len(words) < WINDOW:
                continue
            ids.append((i.as_py(), key.as_py()))
            hashes.append(word_hashes(words))
            size += len(words)
            if size >= CHUNK_WORDS:
                yield ids, hashes
                ids, hashes, size = [], [], 0
    if ids:
        yield ids, hashes


def _anchored(hashes: list[np.ndarray]):
    """Of all windows that lie in one document: their place in the chunk, document, anchor, and the rolling hashes."""
    counts = np.array([len(h) for h in hashes])
    ends = np.cumsum(counts)
    rolling = RollingHashes(np.concatenate(hashes))
    anchors = sliding_min(rolling.windows(ANCHOR), WINDOW - ANCHOR + 1)
    at = np.arange(len(anchors))
    at = at[at + WINDOW <= np.repeat(ends, counts)[: len(anchors)]]
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    return at, doc, anchors[at], ends - counts, rolling


RUNS = "anchor long, run long, doc_id long, key long, start int, n int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes in _chunks(batches):
        at, doc, anchor, first, rolling = _anchored(hashes)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(at)]]))
        start = at[head]
        run = rolling.spans(start, start + n + WINDOW - 1)
        own = doc[head]
        doc_id, key = np.array(ids, np.int64)[own].T
        yield pa.RecordBatch.from_arrays([
            pa.array(anchor[head].view(np.int64)), pa.array(run.view(np.int64)), pa.array(doc_id), pa.array(key),
            pa.array((start - first[own]).astype(np.int32)), pa.array(n.astype(np.int32)),
        ], names=["anchor", "run", "doc_id", "key", "start", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for a lighter exchange."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "key", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name != "packed"}
            yield row, press.decompress(batch.column(batch.schema.get_field_index("packed"))[i].as_py()).split()


WINDOWS = "anchor long, hash long, doc_id long, key long, at int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs named in column `open`, one row each."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    size = 0

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["anchor", "hash", "doc_id", "key", "at"])

    for row, words in _unpacked(batches):
        if len(words) < WINDOW:
            continue
        _, _, anchor, _, rolling = _anchored([word_hashes(words)])
        full = rolling.windows(WINDOW)
        at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in row["open"]])
        at = np.unique(at[at < len(full)])
        for k, x in enumerate((anchor[at].view(np.int64), full[at].view(np.int64), np.full(len(at), row["doc_id"], np.int64), np.full(len(at), row["key"], np.int64), at.astype(np.int32))):
            out[k].append(x)
        size += len(at)
        if size >= CHUNK_WORDS:
            yield flushed()
            out, size = [[], [], [], [], []], 0
    if size:
        yield flushed()


CHANGED = "doc_id long, key long, intervals array<struct<start:int,end:int>>, kept_text string"


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed windows merged into maximal intervals of words, and the words that stay."""
    rows, size = [], 0
    kind = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])
    for row, words in _unpacked(batches):
        edge = np.zeros(len(words) + 1, np.int64)
        starts = [np.arange(r["start"], r["start"] + r["n"]) for r in row["whole"] or ()] + [np.array(row["single"] or [], np.int64)]
        at = np.concatenate(starts)
        at = at[at + WINDOW <= len(words)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        kept = b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode()
        rows.append({"doc_id": row["doc_id"], "key": row["key"], "intervals": [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)], "kept_text": kept})
        size += len(kept)
        if size > 1_000_000:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def _key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, intervals, kept_text) of every document that loses words; key is a hash of the text, intervals are
    of words, end exclusive.

    A row is told apart by its id and text. Null and short texts, and rows without an id, lose nothing and take nothing
    from others. Rows that share an id never remove each other's words, whether their texts are the same or not; rows
    equal in both give one row here. An empty table gives an empty result. Texts of any length are taken whole, other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    runs = saved(own.mapInArrow(_runs, RUNS))
    # an anchor in one document only can't hold a repeated window
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("run").alias("run_lo"), F.max("run").alias("run_hi"))
    # saved, here and below, so that the join deals both sides itself and can split a key that very many documents hold
    anchors = saved(anchors.where("lo < hi").select("anchor", (F.col("run_lo") < F.col("run_hi")).alias("mixed")))
    shared = saved(runs.join(anchors, "anchor"))
    first = shared.groupBy("anchor", "run").agg(F.min("doc_id").alias("first"))
    marked = shared.join(saved(first), ["anchor", "run"]).withColumn("later", F.col("doc_id") > F.col("first")).where("later OR mixed")
    piece = F.struct("start", "n")
    row = ["doc_id", "key"]
    by_doc = saved(marked.groupBy(*row).agg(F.collect_set(F.when(F.col("later"), piece)).alias("whole"), F.collect_set(F.when(~F.col("later"), piece)).alias("open")))
    texts = saved(own.mapInArrow(_packed, "doc_id long, key long, packed binary").join(by_doc, row).dropDuplicates(row))
    opened = saved(texts.where(F.size("open") > 0).select(*row, "packed", "open").mapInArrow(_windows, WINDOWS))
    earliest = saved(opened.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    single = opened.join(earliest, ["anchor", "hash"]).where("doc_id > first").groupBy(*row).agg(F.collect_set("at").alias("single"))
    found = texts.select(*row, "packed", "whole").join(single, row, "left").where("size(whole) > 0 OR single IS NOT NULL")
    return found.mapInArrow(_changed, CHANGED)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text replaced by the words that stay, joined by one space, in the documents that lose words. Repeated
    rows are kept; other columns are passed on, but none may be named _id, _key or _kept. Ids must cast to long."""
    changed = repeated_passages(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kept_text").alias("_kept"))
    out = docs.join(changed, (F.col(id_col).cast("long") == F.col("_id")) & (_key(text_col) == F.col("_key")), "left")
    return out.withColumn(text_col, F.coalesce("_kept", text_col)).drop("_id", "_key", "_kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from each row of `documents`. Null and short texts and rows with null ids lose nothing; repeated rows are
    kept and lose the same; texts of any length are taken whole; other columns are ignored; an empty table gives an empty
    one. Ids must cast to long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = repeated_passages(docs).select(
        "doc_id", "key",
        F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_gone"),
        F.sha2("kept_text", 256).alias("sha_left"),
    )
    words = words_of(F.col("text"))
    whole = docs.select("doc_id", _key("text").alias("key"), F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("sha_whole"))
    return whole.join(changed, ["doc_id", "key"], "left").select("doc_id", "n_words", F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha_left", "sha_whole").alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, i + k AS w FROM (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id), range(0, {WINDOW}) t(k)),
each AS (SELECT d.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS w FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY w) AS text FROM each ANTI JOIN gone USING (doc_id, w) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """For tests: of each row (n_words, n_removed, sha256 of what stays)."""
    first: dict[tuple, int] = {}
    split = [[w.decode() for w in split_words(t)] for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        starts = [i for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d]
        gone = {i + k for i in starts for k in range(window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out
