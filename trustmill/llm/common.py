"""Pieces that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small driver-side list (JSON array of objects) as a DataFrame, without any Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")))


def in_portions(texts: list[str | None], limit: int) -> Iterator[list[str | None]]:
    """texts in their order, in lists of at most limit characters or of one text."""
    held, total = [], 0
    for t in texts:
        if held and total + len(t or "") > limit:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t or "")
    if held:
        yield held


def small_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches of a few MB at most, however long the texts are: bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
