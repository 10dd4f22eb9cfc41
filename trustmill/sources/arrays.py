"""NumPy bundles (.npz) as tables: a Spark data source that reads ranges of rows, and a sink of many bundles.

A bundle holds named arrays of one length; a row of the table is a row of each. The driver reads the archive's directory
and the arrays' headers, nothing else; each task opens the bundle by itself and reads its own rows of every array that
is stored uncompressed (of compressed ones, what comes before too). A folder is a table whose bundles follow each
other by name. Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a partition, and rows that a task holds at a time.
PARTITION_ROWS, BATCH_ROWS = 100_000, 4096


@dataclass(frozen=True)
class Member:
    """An array of a bundle: its first dimension counts rows; without dimensions it holds for all rows."""

    name: str
    kind: str
    shape: tuple[int, ...]
    offset: int

    def sql_type(self) -> str:
        kind = np.dtype(self.kind)
        names = {"f": "float" if kind.itemsize <= 4 else "double", "i": "int" if kind.itemsize <= 4 else "long", "u": "int" if kind.itemsize <= 2 else "long", "b": "boolean", "U": "string", "S": "string"}
        if kind.kind not in names or len(self.shape) > 2:
            raise ValueError(f"array {self.name} of type {self.kind} and shape {self.shape} has no column type")
        one = names[kind.kind]
        return f"array<{one}>" if len(self.shape) == 2 else one


def _opened(path: str):
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system, inner


def _header(stream) -> tuple[str, tuple[int, ...], int]:
    """(type, shape, bytes of the header) of an array in numpy's format, from its first bytes."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(stream)
    if kind.hasobject or fortran and len(shape) > 1:
        raise ValueError("arrays of objects, or stored by columns, can't be read by rows")
    return kind.str, shape, stream.tell()


def bundle_files(path: str) -> list[str]:
    """The bundles of a folder by name, or the file itself."""
    system, inner = _opened(path)
    if system.get_file_info(inner).type == pafs.FileType.Directory:
        return sorted(i.path for i in system.get_file_info(pafs.FileSelector(inner)) if i.path.endswith(".npz"))
    return [inner]


def members(system, file: str) -> dict[str, Member]:
    out = {}
    with system.open_input_file(file) as handle, zipfile.ZipFile(handle) as archive:
        for name in archive.namelist():
            with archive.open(name) as stream:
                out[name.removesuffix(".npy")] = Member(name, *_header(stream))
    return out


def _rows(own: dict[str, Member]) -> int:
    lengths = {m.shape[0] for m in own.values() if m.shape}
    if len(lengths) > 1:
        raise ValueError(f"arrays of different lengths: {sorted(lengths)}")
    return lengths.pop() if lengths else 0


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    many: int
    before: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, key: str, names: list[str], rows: int):
        self.path, self.key, self.names, self.size = path, key, names, rows

    def partitions(self) -> list[Rows]:
        system, _ = _opened(self.path)
        out, before = [], 0
        for file in bundle_files(self.path):
            own = members(system, file)
            if set(own) != set(self.names):
                raise ValueError(f"{file} has arrays {sorted(own)}, not {sorted(self.names)}")
            n = _rows(own)
            out += [Rows(file, i, min(self.size, n - i), before + i) for i in range(0, n, self.size)]
            before += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        own = members(system, partition.file)
        with system.open_input_file(partition.file) as handle, zipfile.ZipFile(handle) as archive:
            streams = {}
            for name, m in own.items():
                streams[name] = archive.open(m.name)
                row = int(np.dtype(m.kind).itemsize * np.prod(m.shape[1:], dtype=np.int64))
                streams[name].seek(m.offset + (partition.first * row if m.shape else 0))
            alone = {name: np.frombuffer(streams[name].read(np.dtype(m.kind).itemsize), m.kind) for name, m in own.items() if not m.shape}
            for i in range(0, partition.many, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.many - i)
                columns = [pa.array(np.arange(partition.before + i, partition.before + i + n))]
                for name in self.names:
                    m = own[name]
                    wide = int(np.prod(m.shape[1:], dtype=np.int64))
                    data = np.repeat(alone[name], n) if not m.shape else np.frombuffer(streams[name].read(n * wide * np.dtype(m.kind).itemsize), m.kind)
                    columns.append(_column(data, m, n, wide))
                yield pa.RecordBatch.from_arrays(columns, [self.key, *self.names])
            for s in streams.values():
                s.close()


def _column(data: np.ndarray, m: Member, rows: int, wide: int) -> pa.Array:
    kinds = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    one = kinds[m.sql_type().removeprefix("array<").removesuffix(">")]
    flat = pa.array(data.astype("U").tolist() if one == pa.string() else data.astype(data.dtype.newbyteorder("=")).astype(one.to_pandas_dtype()), one)
    return flat if len(m.shape) < 2 else pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * wide), flat)


class ArrayBundle(DataSource):
    """format("npz"): options path, key (the name of the row number, `row`), and partitionRows."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _first(self) -> dict[str, Member]:
        system, _ = _opened(self.options["path"])
        found = bundle_files(self.options["path"])
        if not found:
            raise ValueError(f"no bundle in {self.options['path']}")
        return members(system, found[0])

    def schema(self) -> str:
        return ", ".join([f"`{self.options.get('key', 'row')}` long", *[f"`{name}` {m.sql_type()}" for name, m in self._first().items()]])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options.get("key", "row"), list(self._first()), int(self.options.get("partitionRows", PARTITION_ROWS)))


def load_arrays(spark: SparkSession, path: str, key: str = "row", partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """A bundle, or a folder of bundles, of equally long arrays as rows; row positions become a key."""
    spark.dataSource.register(ArrayBundle)
    return spark.read.format("npz").option("key", key).option("partitionRows", partition_rows).load(path)


def save_arrays(df: DataFrame, path: str, order: str, rows: int = PARTITION_ROWS) -> DataFrame:
    """Writes df, in order of a column of distinct numbers, as a folder of bundles of at most so many rows, each written by
    the task that has its rows, under a name that tells its place; returns (file, rows). Rows hold no nulls and arrays of
    a column one length. A bundle appears under its name when it is whole, so a task that is run again does no harm."""
    from trustmill.operators.prefix import numbered

    system, inner = _opened(path)
    if system.get_file_info(inner).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(inner, recursive=True)
    columns = df.columns
    placed = numbered(df, [order], "_place", start=0).withColumn("_part", F.floor(F.col("_place") / rows))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        own, folder = _opened(path)
        table = table.sort_by("_place")
        arrays = {}
        for name in columns:
            column = table.column(name).combine_chunks()
            if pa.types.is_list(column.type):
                arrays[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            elif pa.types.is_string(column.type):
                arrays[name] = np.array(column.to_pylist(), "U")
            else:
                arrays[name] = column.to_numpy(zero_copy_only=False)
        file = f"{folder}/part-{key[0].as_py():08d}.npz"
        temporary, whole = f"{file}.{uuid.uuid4().hex}.tmp", io.BytesIO()
        np.savez(whole, **arrays)
        with own.open_output_stream(temporary) as out:
            out.write(whole.getbuffer())
        own.move(temporary, file)
        return pa.table({"file": [file], "rows": [len(table)]})

    written = placed.groupBy("_part").applyInArrow(write, "file string, rows long")
    return df.sparkSession.createDataFrame(written.orderBy("file").collect(), "file string, rows long")  # one row per bundle

