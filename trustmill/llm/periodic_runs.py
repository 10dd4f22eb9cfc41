"""Periodic runs of words, found by Crochemore's partition refinement in numpy.

Positions of a text fall into classes: two are in one class of length L if the L words from there on are equal. The
classes of length L + 1 come from those of length L: a class is split by the classes that its members' successors are
in. Only classes that the last step has split off are looked at, without the largest part of each split class, so a
position is moved a logarithmic number of times. Members of a class are linked in order; two neighbours at a distance
equal to the length of their class are a square, the same words twice in a row, and their distance its smallest
period. Squares of one period that start at adjoining words make up a run.

All texts of a batch are refined together, each with an end mark of its own, so that a step over few positions of each
still is one numpy call. A text's classes are refined up to the longest period that a run of it can have.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.llm.common import in_portions, table, words_of

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts are refined together up to so many bytes; a longer text is taken alone.
TOGETHER = 8_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then those of first[1], and so on."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)


def _starts(key: np.ndarray) -> np.ndarray:
    """True where a sorted key differs from the one before."""
    out = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=out[1:])
    return out


def _sizes(at: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(at), np.int64)
    if len(at):
        np.subtract(at[1:], at[:-1], out=out[:-1])
        out[-1] = n - at[-1]
    return out


class Classes:
    """Classes of equal factors: `order` has the members of each in one stretch (start, size), and `ahead` and `behind`
    link them by position (-1: none). `since` is the length at which a position was linked to the one ahead."""

    def __init__(self, symbols: np.ndarray, longest: np.ndarray):
        """symbols: numbers from 0 without gaps; longest: for each position, where refinement of its text ends."""
        n = len(symbols)
        self.length, self.longest = 1, longest
        self.of = symbols.copy()
        self.order = np.argsort(symbols, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        size = np.bincount(symbols)
        self.made = len(size)
        self.size, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size[: self.made], self.start[: self.made] = size, np.cumsum(size) - size
        near = ~_starts(symbols[self.order])
        left, right = self.order[:-1][near[1:]], self.order[near]
        self.ahead, self.behind, self.since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        self.ahead[left], self.behind[right] = right, left
        self.moving = np.zeros(n, bool)
        self.small = np.arange(n)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _note(self, i: np.ndarray) -> None:
        """The links that start at i end with classes of the present length: which of them were squares?"""
        gap = self.ahead[i] - i
        square = (self.since[i] <= gap) & (gap <= np.minimum(self.length, self.longest[i]))
        if square.any():
            self.squares.append((i[square], gap[square]))

    def _movers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, its class, its successor's class) of all that precede a small class and whose class is split by that,
        in order of class, successor's class and position."""
        x = self.small[self.small > 0] - 1
        x = x[(self.size[self.of[x]] > 1) & (self.longest[x] > self.length)]
        own, to = self.of[x], self.of[x + 1]
        o = np.argsort(own * self.made + to, kind="stable")
        x, own, to = x[o], own[o], to[o]
        first = np.flatnonzero(_starts(own))
        if not len(first):
            return x, own, to
        moved = _sizes(first, len(x))
        whole = (moved == self.size[own[first]]) & (to[first] == to[first + moved - 1])
        stays = np.repeat(~whole, moved)
        return x[stays], own[stays], to[stays]

    def _relink(self, x: np.ndarray, own: np.ndarray, first: np.ndarray) -> None:
        """Takes x (in groups that begin at first) out of the links of their classes and links each group."""
        by_place = np.lexsort((x, own))
        y = x[by_place]
        before, after = self.behind[y], self.ahead[y]
        # members that move in one stretch leave one gap: its two sides are linked
        left = before[(before < 0) | ~self.moving[before]]
        right = after[(after < 0) | ~self.moving[after]]
        real = left >= 0
        self._note(left[real])
        follow = np.append(x[1:], -1)
        follow[first[1:] - 1] = -1
        lead = np.append(-1, x[:-1])
        lead[first] = -1
        old = self.ahead[x]
        self._note(x[(old >= 0) & (old != follow)])
        self.ahead[left[real]], self.since[left[real]] = right[real], self.length + 1
        self.behind[right[right >= 0]] = left[right >= 0]
        self.ahead[x], self.behind[x] = follow, lead
        self.since[x[old != follow]] = self.length + 1

    def refine(self) -> bool:
        """Goes from length L to L + 1; False if no class was split."""
        x, own, to = self._movers()
        n = len(x)
        if not n:
            return False
        self.moving[x] = True
        new_own = _starts(own)
        first = np.flatnonzero(new_own | _starts(to))
        at_own = np.flatnonzero(new_own)
        parent, moved, size = own[at_own], _sizes(at_own, n), _sizes(first, n)
        rest = self.size[parent] - moved
        self._relink(x, own, first)

        # movers get the last slots of their class's stretch, group by group; who was there takes the slots they leave
        end = self.start[parent] + rest
        slots = spread(end, moved)
        there = self.order[slots]
        place = self.place[x]
        holes = place[place < np.repeat(end, moved)]
        kept = there[~self.moving[there]]
        self.order[holes], self.place[kept] = kept, holes
        self.order[slots], self.place[x] = x, slots
        self.moving[x] = False

        # all groups are new classes, but where nothing stays the largest takes over the old one
        first_group = np.searchsorted(first, at_own)
        groups = _sizes(first_group, len(first))
        most = np.maximum.reduceat(size, first_group)
        largest = np.flatnonzero(size == np.repeat(most, groups))
        largest = largest[_starts(own[first[largest]])]
        fresh = np.ones(len(first), bool)
        fresh[largest[rest == 0]] = False
        name = own[first]
        name[fresh] = self.made + np.arange(fresh.sum())
        self.made += int(fresh.sum())
        self.size[parent] = rest
        self.size[name], self.start[name] = size, slots[first]
        self.of[x] = np.repeat(name, size)

        # the next step needs all parts but the largest of each class
        rest_small = (rest > 0) & (rest < most)
        wanted = np.ones(len(first), bool)
        wanted[largest[rest < most]] = False
        parts = [x[np.repeat(wanted, size)], self.order[spread(self.start[parent[rest_small]], rest[rest_small])]]
        self.small = np.sort(np.concatenate(parts))
        self.length += 1
        return True

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(first position, smallest period) of every square up to the longest period of its text, after refinement."""
        self.length = len(self.of)
        self._note(np.flatnonzero(self.ahead >= 0))
        parts = self.squares or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return np.concatenate([s for s, _ in parts]), np.concatenate([q for _, q in parts])


def runs_in(symbols: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) rows of all runs in texts laid end to end, by start and period. symbols has a number for
    each word, numbers of one text in no other, and after each text a number found nowhere else; ends: where those are."""
    if periods < 2:
        raise ValueError("a run has at least two periods")
    n = _sizes(np.append(0, ends + 1)[:-1], len(symbols)) - 1
    classes = Classes(symbols, np.repeat(n // periods, n + 1))
    while classes.refine():
        pass
    start, period = classes.all_squares()
    o = np.lexsort((start, period))
    start, period = start[o], period[o]
    first = np.ones(len(start), bool)
    first[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    start, period, length = start[at], period[at], _sizes(at, len(start)) - 1 + 2 * period[at]
    long = length >= np.maximum(least, periods * period)
    out = np.stack([start[long], length[long], period[long]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def examined(texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
    """Of each text its runs, by word number, and its words without the repetitions inside runs, joined by spaces."""
    words = [(t or "").encode().split() for t in texts]
    symbols, base, ends = [], 0, []
    for own in words:
        number = defaultdict(count(base).__next__)
        symbols.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        base += len(number)
        symbols.append(np.array([base]))
        base += 1
        ends.append(len(own))
    ends = np.cumsum(np.array(ends) + 1) - 1
    runs = runs_in(np.concatenate(symbols), ends) if texts else np.zeros((0, 3), np.int64)
    # a word goes if a run covers it after the run's first period
    covered = np.zeros(len(ends) and int(ends[-1]) + 2, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(covered) == 0
    text_of = np.searchsorted(ends, runs[:, 0])
    found, left = [], []
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for k, own in enumerate(words):
        at = int(ends[k]) - len(own)
        some = runs[bounds[k] : bounds[k + 1]] - [at, 0, 0]
        found.append(some)
        if len(some):
            own = [own[i] for i in np.flatnonzero(kept[at : at + len(own)])]
        left.append(b" ".join(own).decode())
    return found, left


def _examine(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found, left = [], []
        for texts in in_portions(batch.to_pylist(), TOGETHER):
            for out, more in zip((found, left), examined(texts), strict=True):
                out += more
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(left, pa.string())], ["runs", "collapsed"])


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus runs (start, length and period in words, by start and period) and collapsed (the words without the
    repetitions inside runs, joined by spaces).

    A null, empty or blank text has no runs and collapses to an empty one. Texts of any length are taken whole, one at a
    time if long; repeated rows are judged alike; an empty table gives an empty one. Columns named runs and collapsed are
    replaced, others passed on; none may be named _runs. No rows meet, so there is nothing to shuffle.
    """
    # not to be run again for a filter on its result
    examine = F.arrow_udf(_examine, f"runs {RUNS}, collapsed string").asNondeterministic()
    own = docs.drop("runs", "collapsed").withColumn("_runs", examine(F.col(text_col).cast("string")))
    return own.select("*", "_runs.runs", "_runs.collapsed").drop("_runs")


def damaged(text: Column, key: Column) -> Column:
    """Where the checksum h of key is divisible by 10, the words from number h / 10 % n on repeat a stretch of them; other
    texts, and those with a null key, stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = words_of(text)
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text of `documents`, some of them damaged by their id: a row for each row. A null or blank text and one
    without runs have null values for the longest run; texts with null ids aren't damaged. Other columns are ignored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", damaged(F.col("text"), F.col("doc_id")).alias("text"))
    out = with_runs(docs)
    first = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = out.withColumn("_first", first)
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_first.start").alias("start"),
        (-F.col("_first.l")).alias("length"),
        F.col("_first.period").alias("period"),
        F.floor(-1000 * F.col("_first.l") / F.col("_first.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(words: list) -> list[tuple[int, int, int]]:
    """For tests: (start, length, period) of all runs, by comparing words at every distance."""
    n, best = len(words), {}
    for q in range(1, n // LEAST_PERIODS + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                best.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in best.items())


#: Classes of factors of 1, 2, 4, ... words by doubling; the next member of a class of at least q words is q words on
#: all along a run of period q, up to its last 2 q words or fewer.
_DOUBLINGS = 15
ORACLE = r"""
WITH keyed AS (SELECT row_number() OVER () AS r, doc_id, string_split(doc_id::VARCHAR, '') AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(k, lambda c: ord(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM keyed),
d0 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
d AS (SELECT r, doc_id, n, w, a, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + g % 8) END AS p FROM d0),
word AS (SELECT r, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM d)),
c0 AS MATERIALIZED (SELECT r, n, i, dense_rank() OVER (PARTITION BY r ORDER BY word) AS c FROM word),
"""
for _k in range(1, _DOUBLINGS):
    ORACLE += f"""c{_k} AS MATERIALIZED (SELECT r, n, i, dense_rank() OVER (PARTITION BY r ORDER BY c, d) AS c FROM (
  SELECT r, n, i, c, lead(c, {2 ** (_k - 1)}) OVER (PARTITION BY r ORDER BY i) AS d FROM c{_k - 1}) WHERE d IS NOT NULL AND n >= {2 ** (_k + 1)}),
"""
ORACLE += "m AS (" + " UNION ALL ".join(f"SELECT r, i, q, {2**k} AS k FROM (SELECT r, n, i, lead(i) OVER (PARTITION BY r, c ORDER BY i) - i AS q FROM c{k}) WHERE q > {2**k // 2} AND q <= {2**k}" for k in range(_DOUBLINGS)) + "),"
ORACLE += r"""
t AS (SELECT r, q, k, min(i) AS start, max(i) - min(i) + k + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS z FROM m) GROUP BY r, q, k, z),
runs AS (SELECT r, start, length, q AS period FROM t WHERE length >= greatest(6, 4 * q)),
cover AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT word.r, string_agg(word.word, ' ' ORDER BY word.i) AS text FROM word LEFT JOIN cover ON cover.r = word.r AND cover.i = word.i WHERE cover.i IS NULL GROUP BY 1),
s AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1)
SELECT d.doc_id, coalesce(s.n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
  (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(s.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""
