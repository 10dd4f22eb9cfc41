"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host/path rule (``example.com/en/``: the host and all its subdomains, paths that start so) or a glob
(``*`` any run, ``^`` a separator, ``||`` at the start of a host label). Each rule is filed under the rarest of the
literal tokens that every matching url must contain whole. A url's own tokens fetch candidate rules from that index,
and only the candidates run their regular expression. Up to INLINE_RULES rules the index is one literal array of
buckets, so a lookup is one hash and one array access inside the scan's projection: no shuffle, no explode. More rules
are the same index as a table, joined on the tokens of the distinct urls.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import ascii_lower, literal_rows, table

#: An index larger than this is a table, not a part of the query plan; one of more rules than BROADCAST_RULES is shuffled.
INLINE_RULES, BROADCAST_RULES = 1000, 200_000
#: Rules go into the table in lists of this many.
RULES_AT_ONCE = 10_000


@dataclass(frozen=True)
class Rule:
    """text: ``host/path`` or a glob; base rules beat globs, longer rules beat shorter ones of their kind. Of rules of one
    kind and length, the text that comes last in code point order wins, and of equal texts block wins over allow."""

    action: str
    text: str
    is_glob: bool = False

    def regex(self) -> str:
        """Each part of a glob is sought from the end of the one before, leftmost and for good: in linear time."""
        if not self.is_glob:
            return rf"\A(?:[^/]*\.)?{_quote(self.text)}"
        body, lead = self.text, ".*?"
        if body.startswith("||"):
            body, lead = body[2:], r"(?:[^/]*?\.)??"
        out = r"(?s)\A"
        for part in body.split("*"):
            out += f"(?>{lead}{''.join('(?:[^A-Za-z0-9_.%-]|\\z)' if c == '^' else _quote(c) for c in part)})"
            lead = ".*?"
        return out

    def tokens(self) -> list[str]:
        """Literal tokens that a matching url holds as whole tokens: bounded on both sides inside the rule."""
        text = self.text
        at_start = not self.is_glob or text.startswith("||")
        text = text.removeprefix("||")
        found = []
        for m in re.finditer("[A-Za-z0-9]+", text):
            left = m.start() > 0 and text[m.start() - 1] != "*" or m.start() == 0 and at_start
            right = m.end() < len(text) and text[m.end()] != "*"
            if left and right:
                found.append(m.group())
        return found


#: The rules of the query's contract.
BASE_RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]
#: What the method adds where no base rule fits.
PATTERN_RULES = [
    Rule("block", "||spam-farm.", True),
    Rule("block", "/casino/", True),
    Rule("block", ".adserver.", True),
]


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def filed(rules: list[Rule]) -> list[str | None]:
    """For each rule the rarest of its literal tokens, or none; of equally rare ones the longest."""
    counts = Counter(t for r in rules for t in set(r.tokens()))
    return [min(own, key=lambda t: (counts[t], -len(t), t)) if (own := r.tokens()) else None for r in rules]


def rule_index(rules: list[Rule]) -> tuple[list[list[tuple[str, int]]], list[int]]:
    """Buckets of (token, rule number), and the numbers of rules without a literal token, which every url tries."""
    tokens = filed(rules)
    n = 1
    while n < 2 * len(rules):
        n *= 2
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for i, token in enumerate(tokens):
        if token is not None:
            buckets[zlib.crc32(token.encode()) % n].append((token, i))
    return buckets, [i for i, token in enumerate(tokens) if token is None]


def _columns(url_col: str) -> dict[str, Column]:
    target = F.concat("host", "path")
    return {"_target": target, "_tokens": F.array_distinct(F.regexp_extract_all(target, F.lit("[A-Za-z0-9]+"), 0))}


#: What decides among the rules that fit: base rules first, then the longer text.
_RANK = ["base", "len", "text", "action"]


def _verdicts(df: DataFrame, default: str) -> DataFrame:
    return df.withColumns({
        "rule": F.when(F.col("_best.base") == 1, F.col("_best.text")),
        "verdict": F.coalesce("_best.action", F.lit(default)),
    }).drop("_target", "_tokens", "_ids", "_best")


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages plus host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path, no rule, and the default verdict; so has every url
    where there are no rules. Urls of any length are taken whole, repeated rows judged alike. Columns named host, path,
    rule or verdict are replaced; none may be named _target, _tokens, _ids or _best. Ties among rules: see Rule.
    """
    own = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    own = own.withColumns(_columns(url_col))
    if not rules:
        return _verdicts(own.withColumn("_best", F.lit(None).cast("struct<base:int,len:int,text:string,action:string>")), default)
    if len(rules) > INLINE_RULES:
        return _joined(own, rules, default)
    buckets, rest = rule_index(rules)
    n = len(buckets)
    # as literals that the optimiser folds into one constant each
    index = F.from_json(F.lit(json.dumps([[{"token": t, "id": i} for t, i in b] for b in buckets])), "array<array<struct<token:string,id:int>>>")
    listed = [{"base": int(not r.is_glob), "len": len(r.text), "text": r.text, "action": r.action, "regex": r.regex()} for r in rules]
    catalogue = F.from_json(F.lit(json.dumps(listed)), "array<struct<base:int,len:int,text:string,action:string,regex:string>>")
    bucket = lambda t: (F.crc32(t.cast("binary")) % n).cast("int")
    ids = F.flatten(F.transform("_tokens", lambda t: F.transform(F.filter(F.get(index, bucket(t)), lambda e: e["token"] == t), lambda e: e["id"])))
    own = own.withColumn("_ids", F.concat(ids, F.array(*map(F.lit, rest)).cast("array<int>")) if rest else ids)
    fits = F.filter(F.transform("_ids", lambda i: F.get(catalogue, i)), lambda r: F.regexp_like(F.col("_target"), r["regex"]))
    return _verdicts(own.withColumn("_best", F.array_max(F.transform(fits, lambda r: F.struct(*[r[c].alias(c) for c in _RANK])))), default)


def _joined(own: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by joins. Verdicts are made once per distinct host and path, so copies of a url meet in one row."""
    spark = own.sparkSession
    rows = [{"token": t, "base": int(not r.is_glob), "len": len(r.text), "text": r.text, "action": r.action, "regex": r.regex()} for r, t in zip(rules, filed(rules), strict=True)]
    kind = "token string, base int, len int, text string, action string, regex string"
    parts = [saved(literal_rows(spark, json.dumps(rows[i : i + RULES_AT_ONCE]), kind)) for i in range(0, len(rows), RULES_AT_ONCE)]
    index = saved(reduce(DataFrame.union, parts))
    small = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    targets = own.select("_target", "_tokens").dropDuplicates(["_target"])
    tokens = targets.select("_target", F.explode("_tokens").alias("token"))
    met = tokens.join(small(index.where("token IS NOT NULL")), "token").drop("token")
    free = [r for r in rows if r["token"] is None]  # rules that every url tries, in one array beside it
    if free:
        listed = F.from_json(F.lit(json.dumps(free)), f"array<struct<{kind}>>")
        met = met.union(targets.select("_target", F.inline(listed)).drop("token"))
    fits = met.where(F.regexp_like(F.col("_target"), F.col("regex")))
    best = saved(fits.groupBy("_target").agg(F.max(F.struct(*_RANK)).alias("_best")))
    return _verdicts(own.join(best, "_target", "left"), default)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each row of `pages`. A null url, or one without ://, has an empty host and path and the default verdict;
    repeated rows are judged alike; other columns are ignored; an empty table gives an empty one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, BASE_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT q.page_id, q.host, q.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action
  WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') OR contains(host || path, '/casino/') OR contains(host || path, '.adserver.') THEN 'block'
  ELSE 'allow' END AS verdict FROM m
"""
