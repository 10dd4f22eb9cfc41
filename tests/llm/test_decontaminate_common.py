import random
import time

import pytest

from trustmill.llm import decontaminate

DIR = "/root/testdata/sf0.01"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items):
    out = {}
    for r in decontaminate.overlaps(*frames(spark, docs, items)).collect():
        out.setdefault(r["doc_id"], []).append(r["item_id"])
    return {k: sorted(v) for k, v in out.items()}


def shared_phrase(n, prefix, seed=1, tails=()):
    """n documents and n items that begin with the same words and go on with words of their own; some items go on alike."""
    rng = random.Random(seed)
    phrase = [f"p{i}" for i in range(prefix)]
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(phrase + [word() for _ in range(30 - prefix)])) for i in range(n)]
    docs = [(i, " ".join([word() for _ in range(9)] + phrase + [word() for _ in range(40)])) for i in range(n)]
    return phrase, items, docs


@pytest.mark.parametrize(("prefix", "common"), [(16, 5), (18, 5), (21, 5), (7, 3), (16, 100)])
def test_common_phrases_equal_brute_force(spark, monkeypatch, prefix, common):
    """Items that share a phrase, below and above the share that suffices; families with a second phrase; planted items with
    substitutions, some only in the phrase, some only behind it."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(prefix)
    phrase, items, docs = shared_phrase(40, prefix)
    second = [f"q{i}" for i in range(9)]
    items += [(100 + i, " ".join(phrase[:6] + second + [f"z{i}x{j}" for j in range(10)])) for i in range(12)]
    items += [(200 + i, " ".join(phrase[: 5 + i])) for i in range(8)] + [(300, items[0][1]), (None, items[1][1])]
    for k, (i, text) in enumerate(items[:52]):
        words = text.split()
        for j in rng.sample(range(len(words)), rng.randrange(0, 8)):
            words[j] = f"s{k}"
        docs.append((1000 + i, " ".join(["before"] * rng.randrange(4) + words[rng.randrange(3) :] + ["after"])))
    docs += [(2000, " ".join(phrase * 3)), (2001, None), (2002, ""), (None, items[3][1])]
    want = {k: sorted(v, key=lambda x: (x is None, x)) for k, v in decontaminate.brute_force(docs, items).items() if v}
    got = {}
    for r in decontaminate.overlaps(*frames(spark, docs, items)).collect():
        got.setdefault(r["doc_id"], []).append(r["item_id"])
    assert {k: sorted(v, key=lambda x: (x is None, x)) for k, v in got.items()} == want and len(want) > 20


def test_work_of_a_common_phrase_grows_with_rows(spark):
    """800 documents and 800 items with 16 words in common: alignments that are compared, not their product."""
    counts, seconds = [], []
    for n in (400, 800):
        _, items, docs = shared_phrase(n, 16)
        seen = []
        real = decontaminate.common_pairs

        def counted(found, held, real=real, seen=seen):
            out = decontaminate.saved(real(found, held))
            seen.append(out.count())
            return out

        decontaminate.common_pairs = counted
        try:
            start = time.perf_counter()
            assert found(spark, docs, items) == {}
            seconds.append(time.perf_counter() - start)
        finally:
            decontaminate.common_pairs = real
        counts += seen
    print("alignments", counts, "seconds", seconds)
    assert len(counts) == 2 and counts[1] < 800 * 800 / 10


def test_query_equals_brute_force(spark):
    """All columns of the query, over all of sf0.01."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_ids"]) for r in decontaminate.op10_decontamination(spark, DIR).collect()}
    split = lambda t: decontaminate.re_split(t)
    want_of = {i: split(t) for i, t in items}
    by_token: dict = {}
    for i, words in want_of.items():
        for j, w in enumerate(words):
            by_token.setdefault(w, []).append((i, j))
    for d, text in docs:
        have, agree = split(text), {}
        for p, w in enumerate(have):
            for i, j in by_token.get(w, ()):
                agree.setdefault((i, p - j), set()).add(j)
        hit = set()
        for (i, _), places in agree.items():
            n = len(want_of[i])
            reach = min(n, decontaminate.REACH)
            need = -(-reach * 4 // 5)
            if len(places) >= need and max(sum(s <= j < s + reach for j in places) for s in range(n - reach + 1)) >= need:
                hit.add(i)
        assert got[d] == (bool(hit), len(hit), ",".join(map(str, sorted(hit)))), d
    assert len(got) == len(docs) and sum(v[0] for v in got.values()) > 5
