"""Running totals and row numbers over any number of rows, without a window that spans a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved


def _falls(c) -> bool:
    return not isinstance(c, str) and c[1] == "desc"


def running_before(df: DataFrame, by: list[str], order: list, totals: dict[str, str]) -> DataFrame:
    """df plus, for each name: value in totals, the sum of value over the rows of its group that come before in order.

    Rows are dealt by range; sums inside a range are windows over that range only, and the ranges' own totals (groups x
    ranges rows) are summed up by a small window. order has names of columns, or (name, "desc") for falling ones. Rows
    that are equal in by and order must not exist.
    """
    keys = [F.col(c[0]).desc() if _falls(c) else F.col(c if isinstance(c, str) else c[0]) for c in order]
    dealt = saved(df.repartitionByRange(*[F.col(b) for b in by], *keys).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_of_{n}") for n, v in totals.items()])
    up = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_of_{n}").over(up), F.lit(0)).alias(f"_base_{n}") for n in totals])
    near = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"_in_{n}": F.coalesce(F.sum(v).over(near), F.lit(0)) for n, v in totals.items()})
    same = [inside[b].eqNullSafe(base[b]) for b in [*by, "_range"]]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    out = inside.join(base, cond)
    return out.select(*[inside[c] for c in df.columns], *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).alias(n) for n in totals])


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df plus a gapless row number in order; rows equal in order must not exist."""
    out = running_before(df.withColumn("_one", F.lit(1).cast("long")), [], order, {name: "_one"})
    return out.withColumn(name, F.col(name) + start).drop("_one")


def code(number, letter: str):
    """g0001: padded to four digits, never cut."""
    text = number.cast("string")
    return F.concat(F.lit(letter), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")))


def signed(number, digits: int):
    """+1.50: with its sign and so many digits."""
    return F.format_string(f"%+.{digits}f", number.cast("double"))
