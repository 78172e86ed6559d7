"""Parts of files by bytes: a source whose partitions are (file, offset, length), so that what is not asked for is not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, offset long, data binary"


@dataclass
class Range(InputPartition):
    path: str
    size: int
    offset: int
    length: int


def files_below(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, in order of path."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    for x in sorted(found, key=lambda x: x.path):
        if x.type == fs.FileType.File:
            yield head + x.path, x.size


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").option("path", ...)`` with one of the options ``tail`` and ``head`` (the last or first
    bytes of each file) or ``block`` (all of them, so many at a time). Rows: path, size, offset, data."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        ways = [(w, int(options[w])) for w in ("tail", "head", "block") if w in options]
        if len(ways) != 1 or ways[0][1] <= 0:
            raise ValueError("one of tail, head and block, above 0")
        self.path, (self.way, self.n) = options["path"], ways[0]

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_below(self.path):
            if self.way == "block":
                out += [Range(path, size, at, min(self.n, size - at)) for at in range(0, size, self.n)]
            else:
                length = min(size, self.n)
                out.append(Range(path, size, size - length if self.way == "tail" else 0, length))
        return out or [Range("", 0, 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.length < 0:
            return
        system, inner = fs.FileSystem.from_uri(partition.path) if "://" in partition.path or partition.path.startswith("file:") else (fs.LocalFileSystem(), partition.path)
        with system.open_input_file(inner) as f:
            data = f.read_at(partition.length, partition.offset)
        yield pa.RecordBatch.from_pydict({"path": [partition.path], "size": [partition.size], "offset": [partition.offset], "data": pa.array([data], pa.binary())})


def read_ranges(spark: SparkSession, path: str, **way: int) -> DataFrame:
    """The rows of ``ByteRanges`` for one of tail, head and block."""
    spark.dataSource.register(ByteRanges)
    reader = spark.read.format("byte_ranges").option("path", path)
    for k, v in way.items():
        reader = reader.option(k, str(v))
    return reader.load()


def as_text(data: Column) -> Column:
    """UTF-8 with a mark in place of what is none."""

    @F.arrow_udf("string")
    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    return run(data)


def tail_sample(spark: SparkSession, path: str, n_bytes: int = 256 * 1024) -> DataFrame:
    """(path, text, sampled): the last bytes of each file, of longer ones from the first whole line on, and how many
    were read; a sampling option."""
    tails = read_ranges(spark, path, tail=n_bytes)
    text = as_text(F.col("data"))
    out = tails.select("path", "offset", text.alias("text"), F.octet_length("data").alias("sampled"))
    return out.select("path", F.when(F.col("offset") > 0, F.regexp_replace("text", r"\A[^\n]*(\n|\z)", "")).otherwise(F.col("text")).alias("text"), "sampled")


def head_lines(spark: SparkSession, path: str, lines: int = 32, n_bytes: int = 256 * 1024) -> DataFrame:
    """(path, line_no, line): the first lines of each file, of its first bytes."""
    heads = read_ranges(spark, path, head=n_bytes).select("path", F.slice(F.split(as_text(F.col("data")), "\n"), 1, lines).alias("lines"))
    return heads.select("path", F.posexplode("lines").alias("line_no", "line"))
