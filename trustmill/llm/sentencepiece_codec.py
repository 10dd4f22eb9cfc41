"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is cut into chunks (a run of blanks and the word after it), which pieces never cross. Distinct chunks of equal
length advance together, one end position at a time: for each length of a last piece, hashes of the substrings probe
the sorted hashes of all pieces, and vectorised maxima over the lengths store the backpointers.

The models here merge pairs (BPE), so the wanted path isn't the one with the largest sum of scores. It is the only one
in which every two neighbours are stable: merging their joined text from scratch gives these two pieces again. The
search keeps, for each end, the last piece of that path; stability of a pair is looked up in a table that grows as
pairs are met, so a plain merge runs once per distinct pair of pieces only. Characters that the model lacks stand as
their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.llm.common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Chunks, and pairs of pieces, remembered on a worker; either memory starts anew beyond that.
CACHE, PAIRS = 200_000, 400_000
#: Slots of the vectorised front of the pair memory, and of the marks of leading hash bits: powers of two.
SLOT_BITS, LEAD_BITS = 20, 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def model_pieces(path: str) -> dict:
    """What the codec needs of a model file: pieces by id, and which of them are bytes or control symbols."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text" for i in range(n)]
    if any(BLANK in p.lstrip(BLANK) for p, k in zip(pieces, kinds, strict=True) if k == "text"):
        raise ValueError("a piece holds a blank after a letter: chunks can't be encoded apart")
    return {"pieces": pieces, "kinds": kinds, "scores": [model.get_score(i) for i in range(n)]}


class Codec:
    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.n = len(pieces)
        self.rank = {p: -s for p, s, k in zip(pieces, model["scores"], kinds, strict=True) if k == "text"}
        self.id = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "text"}
        self.piece = pieces
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.raw = [bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(BLANK, " ").encode() if k == "text" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.longest = max(map(len, self.id))
        texts = list(self.id)
        keys = np.array([int(self.hashes(self.codes([p]))[0]) for p in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.id[texts[i]] for i in order], np.int64)
        # leading bits of the hashes of all pieces, and of all beginnings of pieces: other substrings end there
        self.whole, self.begun = np.zeros(1 << LEAD_BITS, bool), np.zeros(1 << LEAD_BITS, bool)
        self.whole[self._lead(keys)] = True
        for size in range(1, self.longest):
            if heads := list({t[:size] for t in texts if len(t) > size}):
                self.begun[self._lead(self.hashes(self.codes(heads)))] = True
        self.single = np.full(0x110000, -2, np.int64)
        for t in texts:
            if len(t) == 1:
                self.single[ord(t)] = self.id[t]
        # stability of pairs: all that were met, and in front the latest of each slot
        self.slot_pair, self.slot_good = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        self.met: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _lead(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - LEAD_BITS)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """Of whole rows, by Horner's rule modulo 2^64."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k]) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def survives(self, left: str, right: str) -> bool:
        """Whether plain merging of the joined text (always the best-ranked neighbours, the leftmost of equals) ends in
        just these two pieces. It does if no merge crosses the border, as each is a piece by itself."""
        rank, none = self.rank.get, float("inf")
        parts, border = [*left, *right], len(left) - 1
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            if i == border:
                return False
            border -= i < border
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return len(parts) == 2

    def are_stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether neighbours are stable; an unknown character (id n or more) or the start (-1) always is."""
        plain = (left >= 0) & (left < self.n) & (right < self.n)
        out = np.ones(len(left), bool)
        if not plain.any():
            return out
        pair = left[plain] * self.n + right[plain]
        slot = (pair.astype(np.uint64) * _BASE) >> np.uint64(64 - SLOT_BITS)
        good = self.slot_good[slot]
        new = np.flatnonzero(self.slot_pair[slot] != pair)
        if len(new):
            fresh, place = np.unique(pair[new], return_inverse=True)
            if len(self.met) > PAIRS:
                self.met.clear()
            for p in fresh.tolist():
                if p not in self.met:
                    self.met[p] = self.survives(self.piece[p // self.n], self.piece[p % self.n])
            found = np.array([self.met[p] for p in fresh.tolist()])
            good[new] = found[place]
            # slots may clash: one pair wins, its verdict with it
            for p, q, g in zip(slot[new].tolist(), pair[new].tolist(), good[new].tolist(), strict=True):
                self.slot_pair[p], self.slot_good[p] = q, g
        out[plain] = good
        return out

    def search(self, words: list[str]) -> list[bytes]:
        """Ids (32 bits each) of words of one length."""
        codes = self.codes(words)
        n, length = codes.shape
        columns = np.ascontiguousarray(codes.T)
        last = np.full((length + 1, n), -2, np.int64)
        last[0] = -1
        back = np.zeros((length + 1, n), np.int64)
        # for each beginning: the words whose substring from there still begins a piece, and its hashes
        none = np.empty(0, np.int64)
        rows: list[np.ndarray] = []
        grown: list[np.ndarray] = []
        for end in range(1, length + 1):
            c = columns[end - 1]
            rows.append(np.arange(n))
            grown.append(np.zeros(n, np.uint64))
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                live = rows[begin]
                if not len(live):
                    continue
                h = (grown[begin] ^ c[live]) * _BASE
                h ^= h >> np.uint64(29)
                lead = self._lead(h)
                more = self.begun[lead]
                rows[begin], grown[begin] = live[more], h[more]
                if size == 1:
                    row, point = live, c.astype(np.int64) - 1
                    piece = self.single[point]
                    piece = np.where(piece == -2, self.n + point, piece)
                else:
                    hit = np.flatnonzero(self.whole[lead])
                    row, probe = live[hit], h[hit]
                    at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                    piece = np.where(self.keys[at] == probe, self.ids[at], -2)
                fits = (piece >= 0) & (last[begin, row] != -2)
                row, piece = row[fits], piece[fits]
                if not len(row):
                    continue
                fits = self.are_stable(last[begin, row], piece) & (size > back[end, row])
                row, piece = row[fits], piece[fits]
                back[end, row] = size
                last[end, row] = piece
            if end >= self.longest:  # no piece begins there any more
                rows[end - self.longest] = grown[end - self.longest] = none
        path = np.zeros((n, length), np.int32)
        place, free = np.full(n, length), np.full(n, length)
        while (live := np.flatnonzero(place > 0)).size:
            free[live] -= 1
            path[live, free[live]] = last[place[live], live]
            place[live] -= back[place[live], live]
        data, step = path.tobytes(), 4 * length
        out = [data[i * step + 4 * f : (i + 1) * step] for i, f in enumerate(free.tolist())]
        for i in np.flatnonzero((path >= self.n).any(axis=1)).tolist():
            out[i] = np.array(list(chain.from_iterable([p] if p < self.n else [self.byte[b] for b in chr(p - self.n).encode()] for p in path[i, free[i] :].tolist())), np.int32).tobytes()
        return out

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, chunks
        by_length = defaultdict(list)
        for w in new:
            by_length[len(w)].append(w)
        for words in by_length.values():
            self.known.update(zip(words, self.search(words), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null or empty text has none."""
        cut = [re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        out = []
        for a in range(0, len(cut), 1024):
            part = cut[a : a + 1024]
            self.learn(set(chain.from_iterable(part)))
            out += [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32) for chunks in part]
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def worker_codec(model: dict) -> Codec:
    """One codec a worker process, whatever tasks it runs: its memories fill once. It hangs on `sys` because functions
    sent by value have globals of their own in every task."""
    import sys

    held = sys.__dict__.setdefault("_trustmill_codecs", {})
    key = hash((len(model["pieces"]), *model["pieces"], *model["scores"]))
    if key not in held:
        held.clear()
        held[key] = Codec(model)
    return held[key]


def encoded(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs plus the ids (array of int) of each text: those of the SentencePiece library. Null and empty texts have an
    empty array; texts of any length are encoded whole; repeated rows alike; an empty table gives an empty one. A column
    named as ids_col is replaced, others are passed on. The model file is read on the driver and travels in a broadcast (about 0.5 MB for 32,000 pieces)."""
    spark = docs.sparkSession
    small_batches(spark, 2)
    held = spark.sparkContext.broadcast(model_pieces(model))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(held.value)
        for texts in batches:
            yield pd.Series(codec.encode([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(ids_col, encode(F.col(text_col)))


def decoded(docs: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs plus the text that each array of ids stands for; a null array gives an empty text. Control ids stand for
    nothing. Blanks survive; the blank sign U+2581 itself comes back as a blank. A column named as text_col is replaced,
    others are passed on; an empty table gives an empty one."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model_pieces(model))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(held.value)
        for rows in batches:
            yield pd.Series(["" if r is None else codec.decode(r) for r in rows], dtype=object)

    return docs.withColumn(text_col, decode(F.col(ids_col)))


def coded(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs plus ids, and round_trip: whether they decode to the text (to the empty text where it is null), in one pass."""
    spark = docs.sparkSession
    small_batches(spark, 2)
    held = spark.sparkContext.broadcast(model_pieces(model))

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(held.value)
        for series in batches:
            texts = [t if isinstance(t, str) else "" for t in series]
            ids = codec.encode(texts)
            yield pd.DataFrame({"ids": ids, "round_trip": [codec.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]})

    # not to be run again for each column that is read from it
    out = docs.withColumn("_coded", code.asNondeterministic()(F.col(text_col)))
    return out.withColumns({"ids": F.col("_coded.ids"), "round_trip": F.col("_coded.round_trip")}).drop("_coded")


DIGEST = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: count and SHA-256 (little-endian 32-bit) of its ids, SHA-256 of what they decode to, and
    whether that is the text. Null and empty texts have no pieces and decode to the empty text; texts of any length are
    taken whole; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    small_batches(spark, 2)
    held = spark.sparkContext.broadcast(model_pieces(model))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            all_ids = codec.encode(texts)
            back = [codec.decode(ids.tolist()) for ids in all_ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in all_ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in all_ids]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                pa.array([(t or "") == b for t, b in zip(texts, back, strict=True)]),
            ], names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, DIGEST)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each row of `documents`. Null and empty texts have no ids; texts of any length are
    encoded whole; repeated rows alike; other columns are ignored; an empty table gives an empty one."""
    return digests(table(spark, sf_dir, "documents"))
