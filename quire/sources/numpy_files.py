"""A Spark data source for NumPy files: `spark.read.format("npy").load(path)` gives (rowid, vector).

Two-dimensional arrays of little-endian 32-bit floats in C order. A file is read
in ranges of rows of about `bytes` bytes (an option), each a partition that
opens the file and takes ROWS rows at a time; its header says where they lie. A
predicate on rowid leaves the ranges that may hold a row, with the option
`pushdown`, which needs spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ROWS = 4_096


#: Bytes of a partition.
RANGE = 64 << 20
#: Bytes that hold any header.
HEAD = 1 << 16


def header(head: bytes) -> tuple[int, int, int]:
    """Rows, columns and the place of the first row, from a file's first bytes; other types and orders are errors."""
    data = io.BytesIO(head)
    version = np.lib.format.read_magic(data)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(data) if version == (1, 0) else np.lib.format.read_array_header_2_0(data)
    if kind != np.dtype("<f4") or fortran or len(shape) != 2:
        raise ValueError("only two-dimensional arrays of 32-bit floats in C order")
    return *shape, data.tell()


def parse(raw: bytes) -> np.ndarray:
    """The array in a file's bytes; other types and orders are errors."""
    rows, columns, at = header(raw)
    body = raw[at:]
    if len(body) != 4 * rows * columns:
        raise ValueError("the file's size doesn't fit its header")
    return np.frombuffer(body, "<f4").reshape(rows, columns)


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of a file, the first row of which lies at `at`."""

    path: str
    start: int
    stop: int
    columns: int
    at: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, size: int = RANGE):
        self.path, self.size = path, size
        self.least, self.most = 0, None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(path)
        files = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with where.open_input_file(f.path) as opened:
                rows, columns, at = header(opened.read_at(min(HEAD, f.size), 0))
            if f.size - at != 4 * rows * columns:
                raise ValueError("the file's size doesn't fit its header")
            step = max(1, self.size // max(1, 4 * columns))
            last = rows if self.most is None else min(rows, self.most + 1)
            out += [Rows(f.path, i, min(i + step, last), columns, at) for i in range(self.least, last, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.path)
        width = 4 * partition.columns
        with where.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.stop, ROWS):
                n = min(ROWS, partition.stop - at)
                flat = pa.array(np.frombuffer(f.read_at(n * width, partition.at + at * width), "<f4"))
                ends = pa.array(np.arange(0, n * partition.columns + 1, partition.columns, dtype=np.int32) if partition.columns else np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, flat)], names=["rowid", "vector"])


class FilteredNpyReader(NpyReader):
    """The same with predicates; Spark takes it only where filter pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the rows to what bounds on rowid leave; Spark checks all predicates once more."""
        for f in filters:
            if getattr(f, "attribute", None) == ("rowid",):
                low = {GreaterThan: lambda v: v + 1, GreaterThanOrEqual: lambda v: v, EqualTo: lambda v: v, In: min}.get(type(f))
                high = {LessThan: lambda v: v - 1, LessThanOrEqual: lambda v: v, EqualTo: lambda v: v, In: max}.get(type(f))
                if low is not None and f.value not in (None, ()):
                    self.least = max(self.least, int(low(f.value)))
                if high is not None and f.value not in (None, ()):
                    self.most = int(high(f.value)) if self.most is None else min(self.most, int(high(f.value)))
            yield f


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "rowid bigint, vector array<float>"

    def reader(self, schema) -> NpyReader:
        kind = FilteredNpyReader if self.options.get("pushdown", "false").lower() == "true" else NpyReader
        return kind(self.options["path"], int(self.options.get("bytes", RANGE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def from_column(df: DataFrame, content: str = "content") -> DataFrame:
    """(rowid, vector) of NumPy files held as bytes in a column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                a = parse(raw)
                for at in range(0, len(a), ROWS):
                    part = a[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["rowid", "vector"])

    return df.select(F.col(content)).mapInArrow(read, "rowid bigint, vector array<float>")
