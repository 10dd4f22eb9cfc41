"""PII: pattern rules for four kinds of identifiers, and bootstrapped contextual extraction of unseen ones.

The rules' matches are seeds. Every identifier-shaped token (one with digits in it) has lexical patterns: the words to
its left, to its right, and on both sides. Tokens and patterns form a graph over the whole corpus, and scores pass back
and forth over its edges: a pattern is as good as the share of its distinct instances that are known, an instance as the
patterns that vouch for it. Instances of accepted patterns are known in the next round and so induce further patterns,
until none is added. What accepted patterns hold, and no rule has, is discovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import table
from trustmill.llm.spans import Kind, by_kind, by_start, listed, masked, merged, of_rank, with_spans


def _digits(s: Column) -> Column:
    return F.regexp_replace(s["value"], "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _is_card(s: Column) -> Column:
    d = _digits(s)
    return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Possessive forms of the four rules. A match starts at the head of a run of its characters, or where the last match
#: ended (\G): later starts in the same run fail as the head did, so leftmost matches are the same, in linear time.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, lambda s: F.regexp_like(s["value"], F.lit(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"))),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, _is_card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda s: F.length(_digits(s)).between(8, 15)),
]
#: Tokens of six characters or more that hold a digit, with the text around them.
TOKEN = Kind("token", r"(?<![A-Za-z0-9@#._:/+-])(?=[A-Za-z@#._:/+-]*+[0-9])[A-Za-z0-9@#._:/+-]{6,}+", context=80)
CONTEXT = "context"
SPANS = "array<struct<rank:int,kind:string,start:int,end:int,value:string>>"
#: A pattern needs so many distinct instances, so many of them known, and such a score; a discovered token, such digits.
ROUNDS, MIN_INSTANCES, MIN_KNOWN, MIN_SCORE, MIN_DIGITS = 6, 20, 10, 0.8, 4


def patterns_of(before: Column, after: Column) -> Column:
    """The lexical patterns of a token between two texts: the two words to its left, the two to its right, and the one
    on each side; lower-cased, digits as #. A side without words has none."""
    clean = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "#")
    words = lambda x: F.array_remove(F.split(clean(x), r"[\x20\x09-\x0D]+"), "")
    left, right = words(before), words(after)
    near_left, near_right = F.slice(left, F.greatest(F.lit(1), F.size(left) - 1), F.lit(2)), F.slice(right, F.lit(1), F.lit(2))
    one_left, one_right = F.slice(left, F.greatest(F.lit(1), F.size(left)), F.lit(1)), F.slice(right, F.lit(1), F.lit(1))
    made = F.array(
        F.when(F.size(left) > 0, F.concat(F.array_join(near_left, " "), F.lit(" _"))),
        F.when(F.size(right) > 0, F.concat(F.lit("_ "), F.array_join(near_right, " "))),
        F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.array_join(one_left, " "), F.lit(" _ "), F.array_join(one_right, " "))),
    )
    return F.filter(made, lambda p: p.isNotNull())


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base, tokens): the rules' spans, and all tokens with their patterns and whether a rule has them."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_spans(own, BASE)
    own = with_spans(own, [TOKEN]).withColumn("base", merged(BASE))

    def token(s: Column) -> Column:
        known = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("instance"), F.length(_digits(s)).alias("digits"), patterns_of(s["before"], s["after"]).alias("patterns"), known.alias("known"))

    return own.select("doc_id", F.xxhash64("text").alias("text_key"), "base", F.transform("_spans_token", token).alias("tokens"))


def good_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, pattern_score): of edges (pattern, instance, known), those that identify.

    Known instances are certain. In each round a pattern scores the certainty of its distinct instances, summed, over
    their number plus one; patterns above the thresholds vouch for all their instances, which are then as certain as
    those patterns together make them, and so count as known in further patterns. Rounds end when no pattern is added.
    """
    pairs = saved(edges.groupBy("pattern", "instance").agg(F.max("known").cast("double").alias("seed")))
    # a pattern with fewer instances can't ever be accepted
    sizes = saved(pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_INSTANCES))
    pairs = saved(pairs.join(sizes, "pattern"))
    scores = saved(pairs.groupBy("instance").agg(F.max("seed").alias("score")))
    before = 0
    for _ in range(ROUNDS):
        rated = pairs.join(scores, "instance").groupBy("pattern", "n").agg(F.sum("score").alias("good"), F.count_if(F.col("score") > 0).alias("known"))
        rated = rated.select("pattern", "known", (F.col("good") / (F.col("n") + 1)).alias("pattern_score"))
        good = saved(rated.where((F.col("known") >= MIN_KNOWN) & (F.col("pattern_score") >= MIN_SCORE)).select("pattern", "pattern_score"))
        if (now := good.count()) == before:
            break
        before = now
        vouched = F.when(F.col("pattern_score").isNotNull(), F.log1p(-F.least(F.col("pattern_score"), F.lit(0.999))))
        doubt = F.coalesce(F.sum(vouched), F.lit(0.0))
        scores = saved(pairs.join(good, "pattern", "left").groupBy("instance").agg(F.greatest(F.max("seed"), 1 - F.exp(doubt)).alias("score")))
    return good


def discovered(spans: DataFrame) -> DataFrame:
    """(doc_id, text_key, context): spans that good patterns find and no rule has, from the table of marked()."""
    tokens = spans.select("doc_id", "text_key", F.inline("tokens"))
    edges = tokens.select("doc_id", "text_key", "start", "end", "digits", "known", "instance", F.explode("patterns").alias("pattern"))
    good = good_patterns(edges.select("pattern", "instance", "known")).select("pattern")
    fresh = edges.where(~F.col("known") & (F.col("digits") >= MIN_DIGITS)).join(good, "pattern")
    return fresh.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.lit(len(BASE)).alias("rank"), F.lit(CONTEXT).alias("kind"), "start", "end", F.lit("").alias("value"))).alias("context"))


def _joined(left: DataFrame, context: DataFrame) -> DataFrame:
    right = context.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "context")
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").drop("_id", "_key")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): spans by rules, and with those that contexts add. One row per row of docs; a null or empty
    text has none; null ids and repeated rows are kept, and repeated rows have the same spans. Texts of any length are
    taken whole. An empty table gives an empty one; other columns are ignored."""
    spans = saved(marked(docs, id_col, text_col))
    out = _joined(spans, discovered(spans))
    return out.select("doc_id", "base", F.concat("base", F.coalesce("context", F.array().cast(SPANS))).alias("all"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind, such as <EMAIL>. Null texts stay null;
    repeated rows are redacted alike; overlapping spans count as one, of the kind that starts first. An empty table gives
    an empty one; other columns are passed on, those whose names begin with an underscore excepted, which must not exist.

    The rules' spans are found where the text is; only spans that contexts add come from elsewhere, by a join.
    """
    context = saved(discovered(saved(marked(docs, id_col, text_col))))
    own = docs.withColumns({"_id": F.col(id_col), "_key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    if not context.isEmpty():
        right = context.select(F.col("doc_id").alias("_id2"), F.col("text_key").alias("_key2"), F.col("context").alias("_context"))
        own = own.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left").drop("_id2", "_key2")
    else:
        own = own.withColumn("_context", F.lit(None).cast(SPANS))
    own = with_spans(own.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))), BASE, "_text")
    own = own.withColumn("_all", by_start(F.concat(merged(BASE), F.coalesce("_context", F.array().cast(SPANS)))))
    text = F.when(F.size("_all") > 0, masked(F.col("_text"), F.col("_all"))).otherwise(F.col(text_col))
    return own.withColumn("_new", text).withColumn(text_col, F.col("_new")).drop("_id", "_key", "_context", "_text", "_all", "_new", *[f"_spans_{k.name}" for k in BASE])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each row of `documents`. Null and empty texts have none; rows with null ids and repeated
    rows are kept, the latter with the same spans; other columns are ignored; an empty table gives an empty one."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(of_rank("base", i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(by_kind(F.col("base"))), 256).alias("base_sha256"), listed(by_kind(F.col("all"))).alias("spans"))
