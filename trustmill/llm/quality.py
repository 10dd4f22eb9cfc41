"""Quality rules: a threshold table compiled into one projection over each document, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.llm.common import table, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "it", "by", "are", "this", "be", "was", "or", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "en", "au", "avec",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "dem", "ein", "eine", "zu", "nicht", "auf", "sich", "im", "für", "des", "wie", "auch",
    "el", "los", "las", "y", "con", "se", "por", "no", "una", "del", "su", "al", "lo", "es", "para", "como", "más", "o", "pero",
]
WINDOW = 8


@dataclass(frozen=True)
class Threshold:
    """A document fails if feature lies outside [low, high]; applies from min_words words on."""

    feature: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's table. Shares are of words unless named otherwise.
THRESHOLDS = [
    Threshold("mean_word_length", 2.0, 14.0),
    Threshold("symbols_per_word", None, 0.3),
    Threshold("stop_word_share", 0.01, None, 100),
    Threshold("upper_share_of_letters", None, 0.5),
    Threshold("dup_share_of_lines", None, 0.5),
]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and every count that the rules use."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    own = own.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "lines": lines})
    n = F.size("words")
    own = own.withColumn("windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))))
    own = own.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda j, k: F.get("sorted", j)["h"] == F.get("sorted", j + k)["h"]
    repeated = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: F.coalesce(twin(j, 1), F.lit(False)) | F.coalesce((j > 0) & twin(j, -1), F.lit(False)))
    own = own.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(repeated, lambda j: F.get("sorted", j)["i"]))))
    covered = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return own.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def compiled(thresholds: list[Threshold]) -> Column:
    """The table as one boolean expression over the counts of measured(): true where every rule holds."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    features = {
        "mean_word_length": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "stop_word_share": per_word("n_stop_words"),
        "upper_share_of_letters": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "dup_share_of_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    holds = F.lit(True)
    for t in thresholds:
        x = features[t.feature]
        inside = F.lit(True)
        if t.low is not None:
            inside &= x >= F.lit(float(t.low))
        if t.high is not None:
            inside &= x <= F.lit(float(t.high))
        holds &= inside if not t.min_words else inside | (F.col("n_words") < t.min_words)
    return holds


def quality_rules(docs: DataFrame, thresholds: list[Threshold] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict per row of docs. A null or empty text has zero counts and fails the base rule (n_words < 20);
    texts of any length are read whole; repeated rows are judged alike; other columns are ignored; an empty table gives
    an empty one."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measured(docs, id_col, text_col).withColumn("base_failed", base_failed)
    return out.withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each row of `documents`. Null and empty texts have zero counts and fail the base rule; texts of any
    length are read whole; repeated rows are judged alike; other columns are ignored; an empty table gives an empty one."""
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) t(k) GROUP BY 1),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  len(list_filter(words, lambda x: lower(x) IN ({', '.join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0::DOUBLE AND 14.0::DOUBLE AND n_symbols / greatest(n_words, 1) <= 0.3::DOUBLE
  AND (n_stop_words / greatest(n_words, 1) >= 0.01::DOUBLE OR n_words < 100) AND n_upper / greatest(n_letters, 1) <= 0.5::DOUBLE
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5::DOUBLE AS kept FROM b
"""
