"""Shared helpers: the scratch folder, hashed words, bit filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, a laptop), a temporary folder takes
    its place; on a cluster an unset folder is an error, as executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame, **names: str | Column) -> DataFrame:
    """Only the named inputs, under the operator's own names, so that extra columns can't clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in names.items()])


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key (a long) is not in the one column of ``gone``; null keys stay.

    The other side's column gets a name that no column of ``df`` has. Rows that a filter of the keys
    clears are not shuffled.
    """
    name = unused(df, "gone")
    gone = written(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), "gone")
    table = bit_filter(gone.select(F.xxhash64(name).alias("h")), "h", filter_bits(gone.count()))
    may = maybe(F.xxhash64(key), table)
    return df.where(~may).unionByName(df.where(may).join(gone.hint("shuffle_hash"), key == F.col(name), "left_anti"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if x not in taken)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of at most so many rows: copies, hashes and results are those
    of a piece, whatever number of rows Spark sends at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---------------------------------------------------------------- hashed words

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19
_IN_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IN_WORD[_c] = True
_IN_WORD[128:] = True
_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(_BLOCK + 1, base, dtype=np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["pow"], _TABLES["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dense_characters(buf: np.ndarray) -> np.ndarray:
    """Where (first bytes, UTF-8) characters of scripts without spaces are: Chinese, Japanese, Thai, Lao, Burmese, Khmer."""
    after = np.append(buf[1:], np.uint8(0))
    word = (buf >= 0xE3) & (buf <= 0xE9)
    word |= (buf == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    word |= (buf == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    word |= (buf == 0xF0) & (after >= 0xA0) & (after <= 0xBF)
    return word


def _hash_block(buf: np.ndarray, prefixes: tuple[int, ...], dense: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse = _powers()
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = _IN_WORD[buf]
    edges = np.flatnonzero(np.diff(flags))
    starts, ends = edges[0::2], edges[1::2]
    if dense and (buf >= 0xE0).any():
        more = np.union1d(starts, np.flatnonzero(dense_characters(buf) & (flags[1:-1] == 1)))
        starts, ends = more, ends[np.searchsorted(starts, more, side="right") - 1]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    if not prefixes:
        return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends
    levels = [mix((sums[np.minimum(ends, starts + p)] - sums[starts]) * inverse[starts] + np.uint64(p)) for p in prefixes]
    return np.stack(levels, axis=1), starts, ends


def hash_words(data: bytes, prefixes: tuple[int, ...] = (), dense: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends (bytes) of the words of ``data``.

    A word is a run of ASCII letters, digits and bytes above 127; with ``prefixes``
    there is a column of hashes for each number of first bytes. With ``dense``, each character of a
    script without spaces starts a word, which ends with its run. Long inputs are taken in blocks that end between words (or, within a word
    longer than a block, in the middle of it).
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    if len(buf) <= _BLOCK:
        return _hash_block(buf, prefixes, dense)
    parts, at = [], 0
    while at < len(buf):
        stop = min(len(buf), at + _BLOCK)
        if stop < len(buf):
            gaps = np.flatnonzero(~_IN_WORD[buf[at:stop]])
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
        h, s, e = _hash_block(buf[at:stop], prefixes, dense)
        parts.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def hashed_texts(texts: list[str | None], prefixes: tuple[int, ...] = (), dense: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Lower-case and hash many texts, in groups of about a block so that small texts share calls.

    Yields (first, last, bounds, hashes, starts, ends, data): texts first..last-1 have the words
    bounds[i]..bounds[i+1]-1. A null text has no words.
    """
    group: list[bytes] = []
    size = first = 0

    def flush(last: int):
        data = b"\n".join(group)
        lengths = np.array([len(x) + 1 for x in group], dtype=np.int64)
        hashes, starts, ends = hash_words(data, prefixes, dense)
        edges = np.concatenate(([0], np.cumsum(lengths)))
        return first, last, np.searchsorted(starts, edges), hashes, starts, ends, data

    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace") if isinstance(text, str) else b""
        if group and size + len(raw) > _BLOCK:
            yield flush(i)
            group, size, first = [], 0, i
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield flush(len(texts))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles inside each text: (hash, text number, first word, last word).

    A text of fewer words than ``width`` gives its whole sequence as one shingle, one of no words none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(count)
    first = bounds[:-1][text] + np.arange(len(text)) - (ends - count)[text]
    length = np.minimum(n, width)[text]
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(width):
        inside = k < length
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        out = np.where(inside, mix(out * np.uint64(_BASE) + (hashes[at] if len(hashes) else np.uint64(0))), out)
    return out, text, first, first + length - 1


# ---------------------------------------------------------------- bit filters

#: bits of the smallest and of the largest filter; the largest is 16 MB
LEAST_BITS, MOST_BITS = 18, 27


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys, as a power of two: about 16 a key where that fits.

    Beyond that a filter lets more strangers pass, which costs time but changes no result:
    whatever passes is joined with the keys themselves.
    """
    return min(MOST_BITS, max(LEAST_BITS, (16 * keys).bit_length()))


def bit_filter(keys: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A filter of ``2**bits`` bits over a column of 64-bit keys: no key is missed, some strangers pass.

    Its size is bounded, however many keys there are, so it can always be sent to all tasks.
    At most ``2**bits / 64`` rows come to the driver, as Arrow: as Python objects they would take many times their bytes.
    """
    k = F.col(column)
    words = (
        keys.select(k.bitwiseAND((1 << bits) - 1).alias("bit"))
        .groupBy(F.shiftrightunsigned("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def maybe(key: Column, table: np.ndarray) -> Column:
    """Whether a row may have one of the keys of a filter. Only the key goes through Python."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(table)

    # Arrow, not pandas, which each Python worker would load and keep
    @F.arrow_udf("boolean")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, keys.to_numpy().view(np.uint64)))

    return run(key)


def long_array(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs, bit for bit."""
    return np.ascontiguousarray(x).view(np.int64)

