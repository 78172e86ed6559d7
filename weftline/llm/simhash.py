"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 3-word shingles (repeats included) of the text with A-Z lower-cased, each hashed
with XXH64 (seed 42); a bit is set if it is set in over half of the hashes.

Links: each distinct fingerprint gets a row of Hamming distances to ``PIVOTS`` reference
fingerprints. The distances are kept by block of bits: the coordinate (block, pivot) is the number
of bits in which the block differs from the pivot's, and a distance to a whole pivot is the sum of
its blocks. By the triangle inequality two fingerprints within r bits differ by at most r in every
distance, and since at most r of ``BLOCKS`` blocks hold a difference, all coordinates of the other
blocks are equal. So pairs meet where the coordinates of ``BLOCKS - r`` blocks agree (a key for
each choice of blocks), are discarded if some distance differs by more than r, and only survivors
have their bits compared. Plain cells of single distances can't bring pairs together at scale: two
random fingerprints agree to 2 in one distance with a chance of 0.4, so enough of them to tell
fingerprints apart, each with its neighbours probed, multiply rows faster than they thin out pairs.

A bucket of more than ``hot`` fingerprints (a dense group of near copies) is dealt anew with
``FINE`` blocks of four bits, which leaves at most 16**r fingerprints a bucket. Nothing is capped:
every pair within r bits meets in some bucket.

Defined cases: a null or empty text has the fingerprint zero and is linked like any other; fewer
than three words give their whole sequence as one shingle; repeated rows and equal texts share a
fingerprint and thus a component; rows with a null id get the component of their fingerprint,
null if no row of the component has an id; ties don't arise, as the smallest id is unique; a very
long text is hashed whole, in blocks; an empty table gives no rows; extra columns are not looked at,
and ``keep_one`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mix, own_columns, pieces, without, written
from weftline.llm.components import components

SEED, WIDTH = 42, 3
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ROW = np.arange(8) * 256


def _votes(rows: bytes) -> np.ndarray:
    """How often each of the 64 bits is set in a run of 8-byte hashes."""
    b = np.frombuffer(rows, dtype=np.uint8).reshape(-1, 8)
    return (np.bincount((b + _ROW).ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF).ravel()


def fingerprint(text: str | None, block: int = 100_000) -> int:
    """The 64-bit SimHash of one whole text, unsigned; memory beside the words is bounded by ``block``."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, votes = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    n = len(words) - WIDTH + 1
    for at in range(0, n, block):
        part = words[at : at + block + WIDTH - 1]
        votes += _votes(b"".join([digest(b" ".join(w), SEED) for w in zip(part, part[1:], part[2:])]))
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in pieces(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": fp.view(np.int64)})

    return own_columns(docs, id=docs[id_col].cast("long"), text=text_col).mapInArrow(run, "id long, fp long")


#: reference fingerprints, and those of them whose coordinates make keys; blocks of bits, and those for dense groups
PIVOTS, KEYED, BLOCKS, FINE = 16, 10, 5, 16


def pivot_fingerprints(pivots: int) -> list[int]:
    """Reference fingerprints: fixed pseudo-random values, as signed longs."""
    return [int(x) for x in mix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [_signed(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]


def _coordinate(pivot: int, mask: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot)).bitwiseAND(F.lit(mask)))


def pivot_table(fps: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(fp, d0, ..): the Hamming distance of ``fp`` to each reference fingerprint."""
    return fps.select("fp", *[_coordinate(p, -1).cast("byte").alias(f"d{i}") for i, p in enumerate(pivot_fingerprints(pivots))])


def block_coordinates(blocks: int, pivots: int = KEYED) -> Column:
    """An array with a hash of the coordinates of each block."""
    refs = pivot_fingerprints(pivots)
    return F.array(*[F.xxhash64(*[_coordinate(p, mask) for p in refs]) for mask in _masks(blocks)])


def with_keys(rows: DataFrame, blocks: int, r: int) -> DataFrame:
    """``rows`` (with the fingerprint) once for each choice of all but r blocks: ``key`` is the choice and its blocks' coordinates."""
    left_out = F.array(*[F.array(*[F.lit(i) for i in c]) for c in combinations(range(blocks), r)])
    dealt = rows.withColumn("coordinates", block_coordinates(blocks)).withColumn("out", F.explode(left_out))
    kept = F.filter("coordinates", lambda _, i: ~F.array_contains("out", i))
    return dealt.select(*rows.columns, F.xxhash64("out", kept).alias("key"))


def _apart(pivots: int) -> Column:
    """The largest difference of two rows of the table in any distance."""
    return F.greatest(*[F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) for i in range(pivots)])


def met(table: DataFrame, blocks: int, r: int, pivots: int = PIVOTS) -> DataFrame:
    """Pairs of rows of the table that share a key and differ by at most r in every distance: (a, b), not yet verified."""
    cols = ["fp", *[f"d{i}" for i in range(pivots)]]
    dealt = with_keys(table.select(*cols), blocks, r)
    x, y = dealt.alias("x"), dealt.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (_apart(pivots) <= r)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def links(fps: DataFrame, max_bits: int = 2, pivots: int = PIVOTS, hot: int = 1024) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``fps`` within ``max_bits`` bits."""
    r = max_bits
    table = written(pivot_table(fps.select("fp").where("fp is not null").distinct(), pivots), "simhash-pivots")
    keys = with_keys(table.select("fp"), BLOCKS, r)
    # of most keys there is one fingerprint: only those of others are joined
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    shared = written(keys.join(sizes, "key"), "simhash-shared")
    cold = written(shared.where(F.col("n") <= hot).select("key", "fp").join(table, "fp"), "simhash-cold")
    x, y = cold.alias("x"), cold.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (_apart(pivots) <= r)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    dense = shared.where(F.col("n") > hot).select("fp").distinct()
    if not dense.isEmpty():
        pairs = pairs.union(met(written(table.join(dense, "fp"), "simhash-dense"), FINE, r, pivots))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= r)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, pivots: int = PIVOTS, hot: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id, links): one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach; ``links`` counts the other distinct
    fingerprints within ``max_bits`` bits.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fps")
    groups = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    pairs = written(links(groups, max_bits, pivots, hot), "simhash-links")
    comps = components(pairs).select(F.col("node").alias("fp"), "component")
    rooted = written(groups.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-rooted")
    # aggregates are written before they are joined, so that the join can split a component or fingerprint of many rows
    least = written(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    per_fp = rooted.join(least, "component").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return fps.join(written(per_fp, "simhash-per-fp"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id", "links")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id): the ids of ``docs`` that are not the smallest of their component."""
    return near_duplicates(docs, id_col, text_col, **how).where("doc_id <> component_id").select("doc_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest id stays.

    Rows with a null id stay; of rows that repeat the kept id, all with that id stay.
    """
    return without(docs, docs[id_col].cast("long"), copies(docs, id_col, text_col, **how))
