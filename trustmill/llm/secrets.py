"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed by its SHA-256. A ledger remembers which blobs were
scanned under which version of the rules. A run scans one representative of each blob whose (blob, rule version) pair
the ledger lacks, appends the findings to the ledger, and joins them back to all paths and versions that hold the blob.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import table
from trustmill.llm.spans import Kind, by_start, listed, merged, of_rank, with_spans

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = [
    Kind("assign", _ASSIGN, None, lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    # maximal runs: as runs of any length, of which the short ones are dropped
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
]
ADDED = [
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "eyJ"),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
]
RULE_VERSION = "1"
LEDGER = "blob binary, rule_version string, spans array<struct<rank:int,kind:string,start:int,end:int>>"


NO_SPANS = "array<struct<rank:int,kind:string,start:int,end:int>>"
#: The query takes the table as so many increments of a history, one after another.
INCREMENTS = 2


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of versions (path, version, content).

    findings: one row per row of versions, with path, version, blob and spans (base kinds first, then by start).
    new ledger rows: (blob, rule_version, spans) of the blobs scanned now; append them to the ledger.

    A null content counts as an empty text; null paths and versions and repeated rows are kept and share their blob's
    findings. Texts of any length are scanned whole. No versions give no findings and no ledger rows; other columns are
    ignored. Of a blob's versions the one with the smallest path and version is scanned.
    """
    own = versions.select("path", "version", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    own = own.withColumn("blob", F.unhex(F.sha2("content", 256)))
    none = F.array().cast(NO_SPANS)
    todo = own.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans")
        todo = todo.join(known.select("blob"), "blob", "left_anti")
    first = todo.select(F.col("blob").alias("_blob"), F.col("at.path").alias("_path"), F.col("at.version").alias("_version"))
    same = (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version"))
    unseen = own.join(first, same).select("blob", "content")
    kinds = BASE + ADDED
    scanned = with_spans(unseen, kinds, "content")
    spans = F.transform(merged(kinds), lambda s: F.struct(s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    scanned = scanned.select("blob", spans.alias("spans"))
    # saved before it is filtered: a filter pushed below would repeat the matching inside the lambdas
    entries = saved(scanned.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans"))
    # blobs without a finding are in the ledger too, but needn't be joined to paths
    found = entries.select("blob", "spans").where(F.size("spans") > 0)
    if ledger is not None:
        found = found.union(known.where(F.size("spans") > 0).dropDuplicates(["blob"]))
    out = own.select("path", "version", "blob").join(found, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", none)), entries


def scan_history(versions: DataFrame, increment: str, increments: list, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after scanning the increments (values of a column of versions) in turn: each sees the ledger
    that the ones before left, and scans only what that lacks."""
    outs = []
    for i in increments:
        found, new = scan_versions(versions.where(F.col(increment) == i), ledger, rule_version)
        ledger = new if ledger is None else ledger.unionByName(new)
        outs.append(found)
    return reduce(DataFrame.unionByName, outs), ledger


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each row of `documents`, the table taken as two increments. Null and empty texts have none; rows
    with null ids and repeated rows are kept, the latter scanned once; other columns are ignored; an empty table gives an
    empty one."""
    docs = table(spark, sf_dir, "documents")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(INCREMENTS)).cast("int")
    found, _ = scan_history(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"), turn.alias("turn")), "turn", list(range(INCREMENTS)))
    with_value = F.transform("spans", lambda s: F.struct(s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value")))
    found = found.withColumn("all", by_start(with_value))
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    counts = [F.size(of_rank("all", i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


_SQL_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: rank, kind, pattern, and the test of a match v.
_SQL_KINDS = [
    (0, "assign", _SQL_ASSIGN, f"length(regexp_extract(v, '{_SQL_ASSIGN}', 2)) >= 6"),
    (1, "access", "AKIA[A-Z0-9]+", "length(v) >= 20"),
    (2, "hex", "[0-9a-f]+", "length(v) >= 24"),
    (3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "TRUE"),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "TRUE"),
    (5, "github", "gh[pousr]_[A-Za-z0-9]{36,}", "TRUE"),
]


def _sql_spans(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Matches with the texts between them; a match starts after the lengths of all that lies before."""
    return f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, s, s + length(v) AS e FROM (
      SELECT doc_id, found[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found FROM d))) WHERE {keep}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(_sql_spans(*k) for k in _SQL_KINDS)}),
y AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM x),
g AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
      string_agg(span, ',' ORDER BY s, r) FILTER (r < 3) AS base, string_agg(span, ',' ORDER BY s, r) AS spans FROM y GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
