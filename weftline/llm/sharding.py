"""Weighted rendezvous hashing of stable record keys (Thaler and Ravishankar, 1998).

Each (key, shard) pair has a pseudo-random number u in (0, 1); a key goes to the shard with the
largest ``-weight / ln(u)``. Key, shards and weights alone decide. A new shard only takes keys
into itself; a changed weight only moves keys into or out of that shard.

Slots number the rows of a shard without a gap. Equal rows are one row with a count until they are
numbered, so a row that is a third of the table is not sorted in one task.

Defined cases: a null key is hashed as a value of its own (all null keys share a shard); rows
that repeat a key share its shard; ties (never seen in practice) go to the lower shard; an empty
table gives an empty result; a shard of weight zero or less gets nothing; very long texts count with
all their bytes; extra columns are not looked at. Slots follow the id, then a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import own_columns, unused, written


def rendezvous(key: str | Column, weights: list[float]) -> Column:
    """The shard (0-based) of a key among ``len(weights)`` shards."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("\x00null"))
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in live])
    # 52 bits of the hash, so that u is exact and never 0 or 1
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(k, s["i"]), 12).cast("double") + 0.5) / float(1 << 52)
    scored = F.transform(shards, lambda s: F.struct((-s["w"] / F.log(u(s))).alias("score"), (-s["i"]).alias("low")))
    return (-F.array_max(scored)["low"]).cast("int")


def assign(rows: DataFrame, key_col: str, shards: int, weights: list[float] | None = None, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of each, in place of any column of that name."""
    return rows.withColumn(name, rendezvous(rows[key_col], weights or [1.0] * shards))


def numbered(rows: DataFrame, shard: str = "shard", order: str = "doc_id", slot: str = "slot", pieces: int = 64, chunk: int = 10_000) -> DataFrame:
    """Gapless slots 0.. inside each shard, without bringing a shard to one task.

    A shard is dealt into ``pieces`` by a hash of the row; pieces are counted, their first slots
    are running sums over ``pieces`` rows a shard, and rows are numbered inside a piece. Copies of a
    row are numbered ``chunk`` at a time.
    """
    names = rows.columns
    piece, n, base, at, lo = (unused(rows, x) for x in ("piece", "n", "base", "at", "lo"))
    hashed = F.xxhash64(*[F.col(c) for c in names])
    dealt = written(rows.groupBy(*names).agg(F.count("*").alias(n)).withColumn(piece, F.pmod(hashed, F.lit(pieces)).cast("int")), "shard-rows")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(shard, piece).agg(F.sum(n).alias(n))
    first = sizes.select(shard, piece, F.coalesce(F.sum(n).over(before(shard).orderBy(piece)), F.lit(0)).alias(base))
    inside = F.coalesce(F.sum(n).over(before(shard, piece).orderBy(order, hashed)), F.lit(0))
    placed = dealt.withColumn(at, inside).join(first, [shard, piece]).select(*names, n, (F.col(base) + F.col(at)).alias(at))
    chunks = placed.withColumn(lo, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(chunk).cast("long")))).hint("rebalance")
    some = F.sequence(F.col(at) + F.col(lo), F.col(at) + F.least(F.col(lo) + chunk, F.col(n)) - 1)
    return chunks.select(*names, F.explode(some).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", pieces: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every document.

    size: UTF-8 bytes of the text (null: none) plus 16. grown_shard: where the document would be
    with one more shard, of the mean weight.
    """
    w = weights or [1.0] * shards
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = own_columns(docs, doc_id=id_col, size=(F.octet_length(text) + 16).cast("long"), text_crc32=F.crc32(text), shard=rendezvous(docs[id_col], w), grown_shard=rendezvous(docs[id_col], [*w, sum(w) / len(w)]))
    return numbered(rows, pieces=pieces)
