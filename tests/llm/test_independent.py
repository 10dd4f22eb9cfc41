"""Queries and stages against versions that share no code with them."""

import hashlib
import re

import xxhash
from test_llm import brute_copies, brute_pii

import corpus_pipeline
from trustmill.llm import decontaminate, language_id, sentencepiece_codec, simhash

WHOLE, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_fingerprints_and_components(spark):
    """Each fingerprint bit by counting shingles one by one; components by comparing all pairs of fingerprints."""
    rows = documents(spark, WHOLE)
    marks = {}
    for d, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        votes = [0] * 64
        for s in shingles:
            h = xxhash.xxh64(s.encode(), seed=42).intdigest()
            for b in range(64):
                votes[b] += h >> b & 1
        marks[d] = sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))
    ids = sorted(marks)
    least = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (marks[a] ^ marks[b]).bit_count() <= 2 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash_dedup(spark, WHOLE).collect()}
    assert got == {d: (f"{marks[d]:016x}", least[d]) for d in ids}


def test_ids_of_a_whole_table(spark):
    """Ids, digests and round trips of sf0.01 equal the library's."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = {r["doc_id"]: r for r in sentencepiece_codec.op6_sentencepiece(spark, WHOLE).collect()}
    rows = documents(spark, WHOLE)
    assert len(got) == len(rows)
    for d, text in rows:
        ids = library.encode(text or "")
        packed = b"".join(int(i).to_bytes(4, "little") for i in ids)
        assert (got[d]["n_pieces"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest()), d


def spans_masked(text, spans):
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1],)):
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_stage_by_stage(spark):
    """Every stage on all that its predecessor kept, against a plain version."""
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "pii", "sentencepiece"]

    def kept(name, df):
        out = corpus_pipeline.saved(stages[name](spark, df, SMALL))
        assert name == "sentencepiece" or out.columns == columns
        return out, {r["doc_id"]: r for r in out.collect()}

    df, own = kept("language_id", docs)
    assert set(own) == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")} and all(own[d]["text"] == rows[d]["text"] for d in own)
    net = language_id.trained(language_id.training_sample(docs, ~language_id.held_out()))
    assert all(r["lang"] in net.langs for r in own.values())

    before, (df, own) = own, kept("near_dedup", df)
    assert sorted(own) == brute_copies([(d, r["text"]) for d, r in sorted(before.items())]) and len(own) < len(before)

    before, (df, own) = own, kept("decontamination", df)
    items = {r["item_id"]: decontaminate.re_split(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}

    def holds(have, item):
        reach = min(len(item), decontaminate.REACH)
        places: dict = {}
        for j, w in enumerate(item):
            for p, x in enumerate(have):
                if x == w:
                    places.setdefault(p - j, []).append(j)
        return any(sum(s <= j < s + reach for j in some) >= -(-reach * 4 // 5) for some in places.values() for s in range(len(item) - reach + 1))

    assert set(own) == {d for d, r in before.items() if not any(holds(decontaminate.re_split(r["text"]), i) for i in items.values() if i)}

    before, (df, own) = own, kept("pii", df)
    order = sorted(before)
    spans = {row[0]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row[6].split(",") if s)] for row in brute_pii([(d, before[d]["text"]) for d in order])}
    kinds = ["email", "ip", "card", "phone", "context"]
    for d in order:
        text = spans_masked(before[d]["text"], sorted(spans[d], key=lambda s: (s[1], kinds.index(s[0]))))
        assert own[d]["text"] == text and own[d]["n_chars"] == len(text)

    library = SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    before, (df, own) = own, kept("sentencepiece", df)
    assert set(own) == set(before) and all(list(own[d]["ids"]) == library.encode(before[d]["text"]) and own[d]["round_trip"] for d in own)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(own)
