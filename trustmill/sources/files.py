"""Sources and sinks: labelled folders, CSV with blanks kept, hash lists, settings, array bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = r"\.(jpe?g|png)$"


def folder_label(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def labelled_files(spark: SparkSession, path: str, pattern: str = IMAGE) -> DataFrame:
    """(path, label, content, size_bytes): files below path, labelled by their folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(pattern)).select("path", folder_label(F.col("path")).alias("label"), "content", F.col("length").alias("size_bytes"))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, keep_blanks: bool = False) -> DataFrame:
    """CSV with a header under a fixed schema; a malformed row fails. With keep_blanks, empty strings stay empty."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if keep_blanks:
        df = df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
    return df


def write_csv(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """One sorted file with a header: for small reports; tables are kept as Parquet."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of lines `<64 hex digits> <path>`; other lines are skipped."""
    line = r"^([0-9a-f]{64})\s+(\S+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("sha256"), F.regexp_extract("value", line, 2).alias("path"))


def write_hash_list(digests: DataFrame, path: str) -> None:
    digests.orderBy("path").select(F.concat_ws("  ", "sha256", "path")).coalesce(1).write.text(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(seed, temperature, method, tau80, tau90) of a JSON tree seed -> {temperature, thresholds: method -> {tau80, tau90}}."""
    kind = "map<string,struct<temperature:double,thresholds:map<string,struct<tau80:double,tau90:double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("seed", "s"))
    return rows.select(F.col("seed").cast("int").alias("seed"), "s.temperature", F.explode("s.thresholds").alias("method", "t")).select("seed", "temperature", "method", "t.tau80", "t.tau90")


def write_settings(thresholds: DataFrame, path: str) -> None:
    """The inverse of read_settings(), as one JSON file."""
    tree = thresholds.groupBy("seed", "temperature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.struct("tau80", "tau90"))))).alias("thresholds"))
    whole = tree.agg(F.map_from_entries(F.collect_list(F.struct(F.col("seed").cast("string"), F.struct("temperature", "thresholds")))).alias("m"))
    whole.select(F.to_json("m")).coalesce(1).write.text(path)


def append_history(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)
