"""Vector sums over all rows of each group: each task adds up what it reads, Spark adds up the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_numpy(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of arrays of numbers of one length (as rows of a matrix)."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def grouped_sums(df: DataFrame, by: str, columns: list[str], sums: Callable[..., np.ndarray]) -> dict:
    """Group -> the sum over its rows of sums(group, *arrays of the columns), a vector. What reaches the driver is one vector
    per group, whatever the number of rows; a task holds a vector for each group that it meets. Columns hold no nulls."""
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            for g in dict.fromkeys(groups):
                own = pa.array(groups == g)  # arrays may have another length in each group
                part = sums(g, *[as_numpy(batch.column(i + 1).filter(own)) for i in range(len(columns))])
                totals[g] = totals[g] + part if g in totals else part
        for g, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(total), batch.schema.field(0).type), pa.array(np.arange(len(total))), pa.array(total, pa.float64())], ["by", "at", "value"])

    parts = df.select(F.col(by).alias("by"), *columns).mapInArrow(run, f"by {kind}, at long, value double")
    out: dict = {}
    for row in parts.groupBy("by", "at").agg(F.sum("value").alias("value")).groupBy("by").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).collect():
        out[row["by"]] = np.array([x["value"] for x in row["v"]])
    return out
