"""Contracts of tables: each check returns one row of counts, or the offending keys; a sound table gives zeros or no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), frames)  # one row each


def secondary_violations(parts: DataFrame, members: DataFrame, key: str, label: str, group: str, part: str, allowed: list[str], held_out: str, fraction: float, tolerance: float = 0.03) -> DataFrame:
    """One row, for a secondary split `parts` (key, label, group, part) of `members` (key, label, group): keys listed
    twice, missing and extra keys, changed labels and groups, parts that aren't allowed, groups over several parts, and
    labels whose share of `held_out` is further than tolerance from fraction."""
    own = members.select(key, F.col(label).alias("_label"), F.col(group).alias("_group"))
    both = parts.join(own, key)
    share = F.abs(F.avg((F.col(part) == held_out).cast("double")) - fraction)
    return _one(
        parts.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated")),
        own.join(parts, key, "left_anti").agg(F.count("*").alias("missing")),
        parts.join(own, key, "left_anti").agg(F.count("*").alias("extra")),
        both.agg(F.count_if(~F.col(label).eqNullSafe(F.col("_label"))).alias("changed_labels"), F.count_if(~F.col(group).eqNullSafe(F.col("_group"))).alias("changed_groups")),
        parts.agg(F.count_if(F.col(part).isNull() | ~F.col(part).isin(allowed)).alias("unknown_parts")),
        parts.groupBy(group).agg(F.countDistinct(part).alias("n")).where("n > 1").agg(F.count("*").alias("torn_groups")),
        parts.groupBy(label).agg(share.alias("off")).where(F.col("off") > tolerance).agg(F.count("*").alias("labels_off")),
    )


def out_of_order(rows: DataFrame, key: str, place: str, value: list[str], expected: list[tuple]) -> DataFrame:
    """(key): keys whose rows, in order of place, don't spell the expected list of values. A key's rows are gathered, of
    which a sound table has as many as expected; longer ones are told by their number alone."""
    n = len(expected)
    want = F.array(*[F.concat_ws(":", *map(F.lit, e)) for e in expected])
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    spelled = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.concat_ws(":", *[F.col(v).cast("string") for v in value]).alias("v")))), lambda x: x["v"])
    fine = rows.join(counted.where(F.col("n") == n).select(key), key, "left_semi").groupBy(key).agg(spelled.alias("list")).where(F.col("list") == want)
    return counted.select(key).join(fine.select(key), key, "left_anti")


def misaligned(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, differences): of two tables that should hold the same rows by key, the keys that only one has (as
    column `key`), and for each column the keys where values differ, nulls being equal."""
    a = left.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(F.col(key).alias("_l"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    met = a.join(b, F.col("_k") == F.col("_l"), "full_outer")
    both = F.col("_k").isNotNull() & F.col("_l").isNotNull()
    counts = met.agg(F.count_if(~both).alias("_key"), *[F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"_{c}") for c in columns])
    named = [F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("differences")) for c in ["key", *columns]]
    return counts.select(F.inline(F.array(*named)))


def not_finite(x: Column) -> Column:
    """Whether a number is null, NaN or infinite."""
    return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))


def value_violations(rows: DataFrame, pred: str, true: str, flag: str, arrays: list[str], numbers: list[str]) -> DataFrame:
    """One row: error flags other than (pred <> true), and rows with a value that isn't finite in an array or a column."""
    wrong = ~F.col(flag).cast("int").eqNullSafe((F.col(pred) != F.col(true)).cast("int"))
    bad = reduce(lambda a, b: a | b, [F.exists(a, not_finite) for a in arrays] + [not_finite(F.col(c)) for c in numbers], F.lit(False))
    return rows.agg(F.count_if(wrong).alias("wrong_flags"), F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"))


def partition_violations(rows: DataFrame, masks: list[Column]) -> DataFrame:
    """One row: rows that no mask takes, and rows that several take."""
    taken = sum((F.coalesce(m.cast("int"), F.lit(0)) for m in masks), F.lit(0))
    return rows.agg(F.count_if(taken == 0).alias("in_none"), F.count_if(taken > 1).alias("in_several"))


def freeze_record(digests: DataFrame, settings: DataFrame) -> DataFrame:
    """(kind, name, sha256) to be kept: a row for each file of digests (path, sha256), and one for the settings, whose
    digest is of all their rows in any order."""
    row = F.sha2(F.to_json(F.struct(*sorted(settings.columns)), {"ignoreNullFields": "false"}), 256)
    # sums of four lanes of 60 bits of the rows' digests, in decimals: order-free, and four numbers whatever the size
    lanes = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"x{i}") for i in range(4)]
    whole = settings.select(*lanes).agg(F.sha2(F.concat_ws(":", F.count("*"), *[F.sum(f"x{i}") for i in range(4)]), 256).alias("sha256"))
    return digests.select(F.lit("file").alias("kind"), F.col("path").alias("name"), "sha256").unionByName(whole.select(F.lit("settings").alias("kind"), F.lit("settings").alias("name"), "sha256"))


def preflight(record: DataFrame, now: DataFrame, settings: DataFrame, grid: DataFrame, results: DataFrame) -> DataFrame:
    """(name, problem) before a frozen run: recorded files that are missing or changed now (kind, name, sha256),
    combinations of the grid that settings lacks or holds with a null, and results (name) that exist already."""
    have = now.select("kind", "name", F.col("sha256").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed")
    files = record.join(have, ["kind", "name"], "left").select("name", state.alias("problem")).where("problem IS NOT NULL")
    keys = grid.columns
    values = [c for c in settings.columns if c not in keys]
    whole = settings.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in values], F.lit(True)))
    lacks = grid.join(whole.select(*keys), keys, "left_anti").select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("name"), F.lit("no setting").alias("problem"))
    there = results.select("name", F.lit("result exists").alias("problem"))
    return files.unionByName(lacks).unionByName(there)


def require_none(problems: DataFrame, what: str) -> None:
    """Raises, with the first few, if a table of problems isn't empty: the gate before labels are joined."""
    if some := problems.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def require_zero(counts: DataFrame, what: str) -> None:
    """Raises if a one-row table of counts has any but zero."""
    if bad := {k: v for k, v in counts.first().asDict().items() if v}:
        raise ValueError(f"{what}: {bad}")


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    """Raises if a table lacks columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns: {missing}")


def require_counts(found: DataFrame, expected: DataFrame, key: str, what: str) -> None:
    """Raises if the rows of found by key aren't as many as expected (key, expected) says, or if it has other keys."""
    from trustmill.operators.audit import count_check

    require_none(count_check(found, expected, key).where("state <> 'OK'").select(key, "found", "expected"), what)
    require_none(found.select(key).join(expected, key, "left_anti").distinct(), f"{what}: keys that aren't expected")


def require_positives(df: DataFrame, by: list[str], flag: str, least: int, held: str | None = None) -> None:
    """Raises if a group has fewer positives than `least`, or, with a flag of held rows, none among those."""
    on_hold = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    counts = df.groupBy(*by).agg(F.count_if(~on_hold & (F.col(flag) == 1)).alias("positives"), F.count_if(on_hold & (F.col(flag) == 1)).alias("held_positives"))
    require_none(counts.where((F.col("positives") < least) | (F.lit(held is not None) & (F.col("held_positives") == 0))), f"positives, at least {least}")
