"""Deterministic sharded WARC 1.1 writer and reader.

Writing: records are deduplicated by payload digest, range-sorted by key into shards of about
equal payload bytes, and each shard is written by one task as a run of ``.warc.gz`` files (one
gzip member per record) that roll at a compressed size. The number of shards grows with the bytes.
Shard bounds are exact quantiles of bytes in the order of (key, digest): keys, digests and sizes
alone are sorted, and running sums give each row the bytes before it, so neither stray ids nor
dense ranges nor a key of many rows make a shard large, and the same rows give the same files
whatever the partitioning. Headers, block and payload digests and record ids are made anew from the
payload. Commit: tasks write under temporary names that no other attempt uses and return a
manifest row per file; the manifest of the attempts that Spark accepted is written first, then
each file is renamed, then the manifest itself is moved to its final name. A rerun task renames
nothing twice; files of lost attempts keep their temporary names and no manifest names them.

Files are opened through ``pyarrow.fs`` by URI, so any store it knows will do; the folder has
to be one that all executors share.

Defined cases: a null payload is an empty one; payloads under ``min_revisit_bytes`` are always
responses; of equal longer payloads the smallest key is the response and the others revisit it,
except that rows which repeat that key are responses too; rows with a null key are written after
all others and revisit if any keyed row has their payload; a null URL is left out of the header;
ids may span all of a long; a payload of any length is one record of one file; records that are equal
in key, payload and URL are told apart by nothing and lie side by side; an empty table gives a
manifest without rows; extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, filter_bits, maybe, own_columns, scratch_path, written

CRLF = b"\r\n"
MANIFEST = "shard int, seq int, temp string, name string, records long, file_bytes long, sha256 string, first_key long, last_key long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, stored_bytes long, digest_ok boolean, file string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


# ---------------------------------------------------------------- records


def record_id(key: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key}|{digest}|{kind}'.encode()).hexdigest()[:32])}>"


def _head(lines: list[tuple[str, object]], first: str) -> bytes:
    clean = [f"{k}: {' '.join(str(v).split())}" for k, v in lines if v is not None]
    return "\r\n".join([first, *clean]).encode("utf-8") + CRLF + CRLF


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record; ``refers_to`` makes it a revisit, which stores no payload."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(key, digest, kind)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Source-Key", key),
        ("X-Payload-Length", len(payload)),
    ]
    if kind == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest, "response")),
            ("X-Refers-To-Key", refers_to),
        ]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return _head(head, "WARC/1.1") + block + CRLF + CRLF


def _fields(stream) -> dict[str, str] | None:
    first = stream.readline()
    while first == CRLF:
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    out = {}
    while (line := stream.readline()) not in (CRLF, b""):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an uncompressed stream, one at a time."""
    while (head := _fields(stream)) is not None:
        block = stream.read(int(head["content-length"]))
        yield head, block


# ---------------------------------------------------------------- writing


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the payload compressed, as it is shuffled twice."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            payload = pa.array([pack.compress(x) for x in batch.column("payload").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict({c: payload if c == "payload" else batch.column(c) for c in batch.schema.names})

    return rows.mapInArrow(run, rows.schema)


#: payload bytes of a shard, and the most shards (beyond, shards grow)
SHARD_BYTES, MOST_SHARDS, HEAD_BYTES = 32 << 20, 1 << 16, 512


def _order(key: str = "key") -> list[Column]:
    return [F.col(key).isNull().alias("no_key"), F.coalesce(key, F.lit(0)).alias(key), F.col("digest")]


def bounds(keys: DataFrame, shards: int) -> list[tuple[bool, int, bytes]]:
    """The first (key is null, key, digest) of every shard but the first; ``keys``: key, digest, size."""
    ranged = keys.select(*_order(), (F.col("size") + HEAD_BYTES).alias("size")).repartitionByRange("no_key", "key", "digest").sortWithinPartitions("no_key", "key", "digest")

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            ends = seen + size.cumsum()
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("no_key", "key", "digest")} | {"part": pa.array([part] * len(size), pa.int32()), "before": ends - size, "size": size})

    placed = written(ranged.mapInArrow(run, "no_key boolean, key long, digest binary, part int, before long, size long"), "warc-order")
    # a row for each partition
    sizes = placed.groupBy("part").agg(F.max(F.col("before") + F.col("size")).alias("size")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["part"]], total = total, total + r["size"]
    if not starts or shards == 1:
        return []
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in (kv[0], float(kv[1]))])
    shard = F.floor((base[F.col("part")] + F.col("before")) * float(shards) / float(total)).cast("int")
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("no_key", "key", "digest")).alias("first"))
    # at most as many rows as shards
    return [(r["first"]["no_key"], r["first"]["key"], bytes(r["first"]["digest"])) for r in first.where("shard > 0").orderBy("shard").collect()]


def plan(pages: DataFrame, shards: int | None, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int) -> tuple[DataFrame, int]:
    """(rows ready to write, number of shards): (key, url, payload, refers_to, shard); payloads are compressed."""
    spark = pages.sparkSession
    text = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    source = own_columns(pages, key=pages[id_col].cast("long"), url=url_col, payload=F.encode(text, "UTF-8"), size=F.octet_length(text).cast("long"), digest=F.unhex(F.sha2(text, 256)))
    keys = written(source.select("key", "size", "digest"), "warc-keys")
    total = keys.agg(F.sum(F.col("size") + HEAD_BYTES)).first()[0] or 0
    shards = shards or max(1, -(-total // max(SHARD_BYTES, total // MOST_SHARDS)))
    starts = spark.sparkContext.broadcast(bounds(keys, shards))
    long = keys.where(F.col("size") >= min_revisit_bytes)
    # written, so that the join shuffles both sides and AQE can split a digest of many rows
    first = written(long.groupBy("digest").agg(F.min("key").alias("first_key"), F.count("*").alias("n")).where("n > 1 and first_key is not null").drop("n"), "warc-first")
    repeated = bit_filter(first.select(F.xxhash64("digest").alias("h")), "h", filter_bits(first.count()))
    # only payloads that may be repeated are dealt out by digest
    may = maybe(F.xxhash64("digest"), repeated) & (F.col("size") >= min_revisit_bytes)
    alone = packed(source.where(~may)).withColumn("refers_to", F.lit(None).cast("long"))
    met = packed(source.where(may)).join(first.hint("merge"), "digest", "left")
    met = met.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("first_key")), F.col("first_key"))).drop("first_key")

    @F.pandas_udf("int")
    def shard(no_key: pd.Series, key: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts.value, x) for x in zip(no_key, key, digest)], dtype="int32")

    rows = alone.unionByName(met).withColumn("shard", shard(*_order()))
    return rows.select("key", "url", "payload", "refers_to", "shard"), shards


def write(pages: DataFrame, out: str, shards: int | None = None, roll_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives below ``out`` and return the committed manifest."""
    spark = pages.sparkSession
    manifest_schema = _schema(MANIFEST)
    rows, shards = plan(pages, shards, id_col, url_col, payload_col, min_revisit_bytes)
    # every shard is one task's, in key order
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_last(), "url", "payload")

    def run(batches):
        fs, root = _store(out)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        sink, state = None, {}

        def close():
            sink.close()
            return pa.RecordBatch.from_pylist([{**state["row"], "sha256": state["sha"].hexdigest()}], schema=manifest_schema)

        seqs: dict[int, int] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, url, payload, refers, shard in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "refers_to", "shard"))):
                packed = gzip.compress(record(key, url, unpack.decompress(payload), refers, date), 6, mtime=0)
                if sink is not None and (state["row"]["shard"] != shard or state["row"]["file_bytes"] + len(packed) > roll_bytes):
                    yield close()
                    sink = None
                if sink is None:
                    seq = seqs[shard] = seqs.get(shard, -1) + 1
                    name = f"part-{shard:05d}-{seq:05d}.warc.gz"
                    temp = f".{name}.{attempt}-{uuid.uuid4().hex[:8]}.tmp"
                    sink = fs.open_output_stream(f"{root}/{temp}")
                    state = {"sha": hashlib.sha256(), "row": {"shard": int(shard), "seq": seq, "temp": temp, "name": name, "records": 0, "file_bytes": 0, "first_key": key, "last_key": key}}
                sink.write(packed)
                state["sha"].update(packed)
                state["row"]["records"] += 1
                state["row"]["file_bytes"] += len(packed)
                state["row"]["last_key"] = key
        if sink is not None:
            yield close()

    temp = f"{out}/_manifest.{uuid.uuid4().hex}"
    dealt.mapInArrow(run, MANIFEST).write.parquet(temp)
    manifest = spark.read.schema(MANIFEST).parquet(temp)

    def rename(batches):
        fs, root = _store(out)
        for batch in batches:
            for old, new in zip(*(batch.column(c).to_pylist() for c in ("temp", "name"))):
                if fs.get_file_info(f"{root}/{old}").type == pafs.FileType.File:
                    fs.move(f"{root}/{old}", f"{root}/{new}")
                elif fs.get_file_info(f"{root}/{new}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{root}/{new}")
            yield batch.select(["name"])

    manifest.mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()
    fs, root = _store(out)
    fs.move(f"{root}/{temp.rsplit('/', 1)[1]}", f"{root}/_manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


# ---------------------------------------------------------------- reading


def read(spark: SparkSession, out: str, parallel: int | None = None) -> DataFrame:
    """The records of the archives that the manifest names, one file at a time in each task.

    Of a response the payload's digest and size are computed from what is stored, and
    ``digest_ok`` says whether the header agrees; of a revisit they come from the header.
    """
    files = read_manifest(spark, out).select("name").repartition(parallel or spark.sparkContext.defaultParallelism * 2)

    schema = _schema(RECORD)

    def run(batches):
        fs, root = _store(out)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(io.BufferedReader(raw, 1 << 20)) as stream:
                    for head, block in records(stream):
                        _, _, payload = block.partition(CRLF + CRLF)
                        said = head["warc-payload-digest"].removeprefix("sha256:")
                        digest = hashlib.sha256(payload).hexdigest() if head["warc-type"] == "response" else said
                        size = len(payload) if head["warc-type"] == "response" else int(head["x-payload-length"])
                        block_ok = head["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
                        key, refers = (int(head[x]) if x in head else None for x in ("x-source-key", "x-refers-to-key"))
                        rows.append(dict(zip(schema.names, (key, head.get("warc-target-uri"), size, digest, head["warc-type"], refers, head["warc-record-id"], len(payload), block_ok and digest == said, name))))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, shards: int | None = None, roll_bytes: int = 64 << 20, **how) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    out = scratch_path(pages.sparkSession, "warc")
    write(pages, out, shards, roll_bytes, **how)
    return read(pages.sparkSession, out)


