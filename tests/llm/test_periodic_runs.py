import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import common, periodic_runs


def some_texts(seed, n, longest=60):
    """Words of small alphabets, some with planted repetitions inside repetitions."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = "abcdefg"[: rng.randrange(1, 8)]
        own = [rng.choice(letters) for _ in range(rng.randrange(0, longest))]
        for _ in range(rng.randrange(3)):
            at, size = rng.randrange(len(own) + 1), rng.randrange(1, 8)
            own[at:at] = (own[at : at + size] or ["z"]) * rng.randrange(2, 9)
        out.append(own)
    return out


def fibonacci(k):
    a, b = "a", "ab"
    for _ in range(k):
        a, b = b, b + a
    return list(b)


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    texts = [*some_texts(seed, 200), [], ["x"], ["x"] * 6, ["x"] * 5, ["x", "y"] * 4, fibonacci(9), ["p"] * 500, [str(i % 37) for i in range(900)], list("aab" * 50 + "aaab" * 40)]
    found, left = periodic_runs.examined([" ".join(t) for t in texts])
    want = [periodic_runs.brute_force(t) for t in texts]
    assert [[tuple(r) for r in f.tolist()] for f in found] == want
    assert left == [collapsed(t, r) for t, r in zip(texts, want, strict=True)]
    alone = [periodic_runs.examined([" ".join(t)])[0][0].tolist() for t in texts[::7]]
    assert alone == [f.tolist() for f in found[::7]]


def test_squares_of_any_power():
    """The refinement itself: all primitive squares, for runs of two periods on."""
    for words in some_texts(9, 80, 40):
        symbols = np.append(np.unique(words, return_inverse=True)[1], len(set(words)))
        got = periodic_runs.runs_in(symbols.astype(np.int64), np.array([len(words)]), least=2, periods=2)
        want = set()
        for q in range(1, len(words) // 2 + 1):
            i = 0
            while i + q < len(words):
                s = i
                while i + q < len(words) and words[i] == words[i + q]:
                    i += 1
                # q is the smallest period if no smaller one fits the first two periods
                if i - s >= q and not any(words[s : s + 2 * q - r] == words[s + r : s + 2 * q] for r in range(1, q)):
                    want.add((s, i - s + q, q))
                i += 1
        assert set(map(tuple, got.tolist())) == want


def test_work_grows_slowly():
    """Positions looked at: within a factor of the logarithm, for periodic and for random words."""
    for words in ([str(i % 500) for i in range(8000)], fibonacci(17)[:8000], [str(random.Random(4).random() // 0.01) for _ in range(8000)]):
        symbols = np.append(np.unique(words, return_inverse=True)[1], len(set(words))).astype(np.int64)
        classes, looked = periodic_runs.Classes(symbols, np.full(len(symbols), len(words) // 4)), 0
        while True:
            looked += len(classes.small)
            if not classes.refine():
                break
        assert looked < 3 * len(words) * np.log2(len(words))


def test_query_on_odd_texts(spark, duck, tmp_path):
    rng = random.Random(5)
    ids = range(-5, 400)
    texts = {i: " ".join(rng.choice(["a", "b", "ccc", "d e", "é"]) for _ in range(rng.randrange(40))) for i in ids}
    rows = [(i, t, "clash", 1) for i, t in texts.items()] + [(7, texts[7], None, None), (1000, None, None, None), (1001, " \t\n", None, None), (None, "x " * 9, None, None), (1002, "long " * 30_000 + "end", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want, hit = [], 0
    for i, text, *_ in rows:
        words = [w for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, hit = [words[j if j < a else a + (j - a) % p] for j in range(n)], hit + 1
        runs = periodic_runs.brute_force(words) if n < 10_000 else [(0, 30_000, 1)]
        kept = collapsed([w.decode() for w in words], runs) if n < 10_000 else "long end"
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), s, length, q, runs and 1000 * length // q or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)))
    assert hit > 20 and out == sorted(want, key=repr)
    duck.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.sql(periodic_runs.ORACLE).fetchall(), key=repr) == sorted(want, key=repr)
    duck.sql("DROP VIEW temp.documents")
    kept = periodic_runs.with_runs(df.where("doc_id = 7"))
    assert kept.columns == ["doc_id", "text", "n_runs", "runs", "collapsed"] and kept.count() == 2
    assert periodic_runs.with_runs(df.limit(0)).count() == 0 and periodic_runs.with_runs(df.where(F.col("text").isNull())).first()["collapsed"] == ""


def test_portions():
    texts = ["a" * 5, None, "b" * 9, "", "c" * 30, "d"]
    assert [len(p) for p in common.in_portions(texts, 10)] == [2, 2, 1, 1]
