"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}
#: bytes of the files behind a table that a task of ``dealt`` takes
PART_BYTES = 4 << 20


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only under a local master, where it is unset, a temporary folder takes its place."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: without lineage or what the planner inferred from it, which
    in loops grows faster than the data; lost executors don't take it along. Small tables are known to be small."""
    spark = df.sparkSession
    path = f"{root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows there are (for which ``which`` holds), counted while they are written."""
    seen = Observation()
    rows = cut(df.observe(seen, (F.count(F.lit(1)) if which is None else F.count_if(which)).alias("n")))
    return rows, seen.get["n"]


def size(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in df.inputFiles()]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def parts(df: DataFrame, times: int = 1) -> int:
    """How many parts the files that ``df`` reads ask for, so that a task holds as much of large tables as of small ones,
    whatever the session's number of shuffle partitions is; that number where no files are read. Rows may be ``times`` as much as their files."""
    spark, read = df.sparkSession, size(df)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(read * times // PART_BYTES + 1, min(usual, spark.sparkContext.defaultParallelism)) if read else usual


def dealt(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """``df`` dealt by ``keys`` into ``parts``."""
    return df.repartition(parts(df, times), *keys)


def clear(spark: SparkSession) -> int:
    """Removes the intermediate tables of this application, once the results that read them are written; gives their number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
