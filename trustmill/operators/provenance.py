"""Provenance: digests, freeze records, write-once and all-or-nothing outputs, table comparison."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def verify_digests(recorded: DataFrame, now: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, state): ok, changed, or missing, for every recorded key."""
    have = now.select(key, F.col(digest).alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col(digest), "ok").otherwise("changed")
    return recorded.join(have, key, "left").select(key, state.alias("state"))


def read_sidecar(spark: SparkSession, path: str) -> str:
    """The digest in a file that begins with 64 hex digits, as is kept beside a table; raises if it has none."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^([0-9a-f]{64})(\s|$)", 1)).first()
    if found is None or not found[0]:
        raise ValueError(f"{path} holds no digest")
    return found[0]


def verify_sidecar(spark: SparkSession, path: str, sidecar: str) -> None:
    """Raises if the file at path isn't there once, or has another digest than its sidecar says."""
    want, now = read_sidecar(spark, sidecar), file_digests(spark, path).collect()
    if len(now) != 1 or now[0]["sha256"] != want:
        raise ValueError(f"{path} differs from {sidecar}")


def incomplete(settings: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Combinations of the grid's values that settings lacks."""
    rows = settings.sparkSession.range(1).select()
    for name, values in grid.items():
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return rows.join(settings.select(*grid), list(grid), "left_anti")


def differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows, repeats counted, of one table that the other lacks, with `side`; empty if the tables are equal."""
    a = expected.exceptAll(observed).withColumn("side", F.lit("expected only"))
    return a.unionByName(observed.exceptAll(expected).withColumn("side", F.lit("observed only")))


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_checked(df: DataFrame, path: str, check) -> None:
    """Writes beside the target, checks what was written, and renames; nothing is left behind if the check fails."""
    spark = df.sparkSession
    stage = f"{path}.staged-{uuid.uuid4().hex}"
    target, staged = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, stage))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.parquet(stage)
    try:
        check(spark.read.parquet(stage))
        if not fs.rename(staged, target):
            raise OSError(f"{stage} could not be renamed to {path}")
    finally:
        fs.delete(staged, True)


#: The file that makes an output whole: written last, it names all others.
MANIFEST = "_manifest.json"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, size_bytes) of the data files of an output; files whose names begin with _ or . aren't data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def write_committed(df: DataFrame, path: str, check: Callable[[DataFrame], None] = lambda written: None) -> None:
    """Writes df as Parquet where nothing is yet, checks what was written, and commits it by a manifest of the files, their
    digests and the rows. Only the manifest makes it an output (read_committed), so one that is cut short, or whose check
    fails, is none; no rename is needed, which object stores lack. One row a file meets in the manifest."""
    spark = df.sparkSession
    fs, folder = _file_system(spark, path)
    if fs.exists(folder):
        raise FileExistsError(path)
    df.write.parquet(path)
    check(spark.read.parquet(path))
    rows = spark.read.parquet(path).count()
    files = [r.asDict() for r in _parts(spark, path).orderBy("name").collect()]
    text = json.dumps({"rows": rows, "schema": df.schema.json(), "files": files}, sort_keys=True)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _manifest(spark: SparkSession, path: str) -> str:
    fs, _ = _file_system(spark, path)
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not fs.exists(file):
        raise ValueError(f"{path} isn't committed: it has no manifest")
    stream = fs.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest_digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of an output's manifest, which stands for all its files: to be recorded elsewhere."""
    return hashlib.sha256(_manifest(spark, path).encode()).hexdigest()


def read_committed(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """A committed output, after all its files were compared with its manifest, and the manifest with a recorded digest if
    one is given. Raises if it isn't committed, or if a file is missing, changed or not listed."""
    text = _manifest(spark, path)
    if digest is not None and hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError(f"{path}: the manifest isn't the recorded one")
    manifest = json.loads(text)
    kind = "name string, sha256 string, size_bytes long"
    want = spark.createDataFrame([(f["name"], f["sha256"], f["size_bytes"]) for f in manifest["files"]], kind)
    if odd := differences(want, _parts(spark, path) if manifest["files"] else want.limit(0)).limit(5).collect():
        raise ValueError(f"{path} differs from its manifest: {[(r['name'], r['side']) for r in odd]}")
    return spark.read.schema(T.StructType.fromJson(json.loads(manifest["schema"]))).parquet(path)


def sealed_join(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """predictions with their labels, which may be null; raises if a prediction has no row of labels, or several."""
    known = labels.withColumn("_there", F.lit(True))
    out = predictions.join(known, key, "left")
    if missing := out.where(F.col("_there").isNull()).count():
        raise ValueError(f"{missing} predictions have no label")
    if twice := labels.join(predictions.select(key), key, "left_semi").groupBy(key).count().where("count > 1").count():
        raise ValueError(f"{twice} predictions have several labels")
    return out.drop("_there")


def opened_labels(spark: SparkSession, predictions: dict[str, str], labels: Callable[[], DataFrame], key: str, results: list[str], problems: Callable[[], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The gate before labels of a target are read, in one call: path -> predictions with their labels.

    No result may exist yet (the analysis is run once), every problem that the caller's checks list is an error, and each
    file of predictions must be committed and equal to the digest recorded when it was made. Only then is labels called.
    """
    for path in results:
        fs, there = _file_system(spark, path)
        if fs.exists(there):
            raise FileExistsError(f"{path}: results exist already")
    if problems is not None and (some := problems().limit(5).collect()):
        raise ValueError(f"not as frozen: {[tuple(r) for r in some]}")
    sealed = {path: read_committed(spark, path, digest) for path, digest in predictions.items()}
    known = labels()
    return {path: sealed_join(df, known, key) for path, df in sealed.items()}
