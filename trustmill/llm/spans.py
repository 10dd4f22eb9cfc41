"""Spans of regular expressions in texts, by built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """pattern: a Java regular expression without zero-width matches. trigger: a literal that every match holds, or none.
    keep: column test on a match; failing ones go. context: so many characters of each side are kept with a match, not
    beyond the matches next to it."""

    name: str
    pattern: str
    trigger: str | None = None
    keep: object = None
    context: int = 0


def with_spans(df: DataFrame, kinds: list[Kind], text: str = "text") -> DataFrame:
    """df plus one column `_spans_<kind>` each: leftmost non-overlapping matches in order, offsets in code points, end exclusive.

    The text is cut at the matches: their starts are the running lengths of what lies before. A null text has no match.
    """
    empty = F.array().cast("array<string>")
    for k in kinds:
        if k.trigger is None:
            maybe = F.regexp_like(F.col(text), F.lit(k.pattern))
        else:
            maybe = F.contains(F.col(text), F.lit(k.trigger))
        df = df.withColumns({
            f"_gaps_{k.name}": F.when(maybe, F.split(text, k.pattern, -1)).otherwise(empty),
            f"_found_{k.name}": F.when(maybe, F.regexp_extract_all(F.col(text), F.lit(k.pattern), 0)).otherwise(empty),
        })
    df = df.withColumns({f"_starts_{k.name}": _starts(F.col(f"_gaps_{k.name}"), F.col(f"_found_{k.name}")) for k in kinds})
    spans = {f"_spans_{k.name}": _placed(k) for k in kinds}
    df = df.withColumns(spans).drop(*[f"_{a}_{k.name}" for k in kinds for a in ("gaps", "found", "starts")])
    return df.withColumns({f"_spans_{k.name}": F.filter(f"_spans_{k.name}", k.keep) for k in kinds if k.keep is not None})


def _starts(gaps: Column, found: Column) -> Column:
    """Where the matches start, from the matches and the text between them. The fold carries plain numbers only: it
    copies 4 bytes per earlier match and step."""
    # gaps is read twice on purpose: a column read once may be inlined, and then runs once per match
    n = F.least(F.size(gaps), F.size(found))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        return F.struct((start + F.length(F.get(found, i))).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    none = F.array().cast("array<int>")
    seed = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), seed, step, lambda a: a["out"])).otherwise(none)


def _placed(k: Kind) -> Column:
    found, gaps, none = F.col(f"_found_{k.name}"), F.col(f"_gaps_{k.name}"), F.lit("")

    def span(start: Column, i: Column) -> Column:
        value = F.get(found, i)
        out = [start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")]
        if k.context:
            before = F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(none), F.get(gaps, i))
            after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), none))
            out += [F.right(before, F.lit(k.context)).alias("before"), F.left(after, F.lit(k.context)).alias("after")]
        return F.struct(*out)

    return F.transform(f"_starts_{k.name}", span)


def of_rank(spans: Column | str, i: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == i)


def merged(kinds: list[Kind]) -> Column:
    """All spans of these kinds as one array of (rank, kind, start, end, value); rank is the kind's place in the list."""
    def ranked(i: int, name: str) -> Column:
        return F.transform(f"_spans_{name}", lambda s: F.struct(F.lit(i).alias("rank"), F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    parts = [ranked(i, k.name) for i, k in enumerate(kinds)]
    return F.concat(*parts)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    return _ordered(spans, "start", "rank")


def by_kind(spans: Column) -> Column:
    return _ordered(spans, "rank", "start")


def _ordered(spans: Column, first: str, second: str) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["value"].alias("value")))
    return F.array_sort(keyed)


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by <KIND>; spans are ordered by start, overlapping ones count as one."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, seed, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
