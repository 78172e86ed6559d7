"""Sinks: a ledger keyed by run, and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: versions of a bucket that are kept side by side before its rows are written together
MOST_PIECES = 8


class Conflict(RuntimeError):
    """Others kept committing to the ledger while this batch tried to."""


class Ledger:
    """A table of credits with one row a run, below a folder that all executors share.

    Rows lie in ``data/<piece>/bucket=<hash of the run id>``. What counts is the newest file in ``manifest``: it
    names the pieces of each bucket, and is put there by one rename that fails if its number is taken. So a batch is
    there as a whole or not at all; what a lost batch left is read by nobody; and of two writers one starts
    anew on what the other has written. Nothing depends on the checkpoint or the epoch of a stream.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._rename = getattr(hadoop, "Options$Rename")

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def state(self) -> dict:
        """version, buckets, schema and the pieces of each bucket that has rows."""
        versions = self._manifests()
        if not versions:
            return {"version": 0, "buckets": self.buckets, "schema": None, "pieces": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{versions[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> bool:
        """Whether this state became the newest."""
        hidden = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(hidden), False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        # no option: a name that is taken stays as it is
        kinds = self.spark.sparkContext._gateway.new_array(self._rename, 0)
        try:
            self._files.rename(self._path(hidden), self._path(f"{self.path}/manifest/{state['version']}"), kinds)
        except Exception as e:  # noqa: BLE001
            self._fs.delete(self._path(hidden), False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/data/{p}/bucket={b}" for b, pieces in state["pieces"].items() if buckets is None or int(b) in buckets for p in pieces]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(*folders)

    def read(self) -> DataFrame | None:
        """All credits; None where none was ever committed."""
        return self._rows(self.state())

    def add(self, credits: DataFrame, key: str = "run_id", order: str = "at", tries: int = 8) -> int:
        """Adds the first credit of each run that has none yet; gives the version that holds them. Only
        the buckets of these runs are read. Rows without a run are left out."""
        fields = credits.columns
        # unknown times last
        rank = F.struct(F.col(order).isNull().alias("late"), order, F.struct(*fields).alias("row"))
        first = credits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(rank).alias("x")).select("x.row.*").persist()
        try:
            for _ in range(tries):
                state = self.state()
                bucket = F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int")
                own = first.withColumn("bucket", bucket)
                touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())  # at most one row a bucket
                known = self._rows(state, touched)
                new = own if known is None else own.join(known.select(key), key, "left_anti")
                piece = uuid.uuid4().hex
                full = [b for b in touched if len(state["pieces"].get(str(b), [])) >= MOST_PIECES]
                if full:
                    new = new.unionByName(self._rows(state, full).withColumn("bucket", bucket))
                new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{piece}")
                written = self._path(f"{self.path}/data/{piece}")
                have = [int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(written) if s.getPath().getName().startswith("bucket=")]
                if not have:
                    return state["version"]
                pieces = {b: [] if int(b) in full else p for b, p in state["pieces"].items()}
                for b in have:
                    pieces[str(b)] = [*pieces.get(str(b), []), piece]
                schema = state["schema"] or json.dumps(first.schema.jsonValue())
                if self._commit({"version": state["version"] + 1, "buckets": state["buckets"], "schema": schema, "pieces": pieces}):
                    return state["version"] + 1
        finally:
            first.unpersist()
        raise Conflict(f"{tries} commits to {self.path} were overtaken")

    def sweep(self) -> int:
        """Removes pieces that no manifest names and manifests but the newest; only while nobody writes or reads older states."""
        versions, state = self._manifests(), self.state()
        live, gone = {p for pieces in state["pieces"].values() for p in pieces}, 0
        data = self._path(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in live:
                gone += bool(self._fs.delete(status.getPath(), True))
        for v in versions[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v}"), False)
        return gone


def credit_once(events: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A stream of credits (run_id, at and others) into a ``Ledger``: of a run the first batch that has it counts, and in it the earliest
    row, whatever is replayed, restarted on another checkpoint or written by another stream. Returns the started query."""

    def merge(batch: DataFrame, epoch: int) -> None:
        Ledger(batch.sparkSession, path, buckets).add(batch)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").start()


def credits(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a ledger; None where nothing was committed."""
    return Ledger(spark, path).read()


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """One sorted JSON file; for summaries, whose size does not grow with the data."""
    rows.select(*sorted(rows.columns)).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").json(path)
