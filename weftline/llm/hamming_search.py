"""Exact top-k search over binary codes by incremental multi-index hashing.

(Norouzi, Punjani, Fleet: Fast Exact Search in Hamming Space with Multi-Index Hashing, 2014.)

A 64-bit code is cut into ``segments`` parts. Codes within distance ``m * (s + 1) - 1`` of a
query agree with it in some part up to ``s`` bits. Round ``s`` looks up, in each part, all
values at exactly ``s`` bits from the query's; a query is finished once the distance of its kth
verified code is inside what its rounds cover, and in its last round it only looks up the parts
that are still needed for that.

Defined cases: rows with a null id or a null code are neither queries nor results; repeated
rows (same id) count once per row; a table with fewer than k rows gives all of them; ties in
distance are broken by the smaller id. Equal codes are stored once, with their ``k`` smallest
ids (no other id of that code can be in a result), so a code that holds a third of all rows is
one row of the index. An empty table of codes or queries gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

BITS = 64


def sign_code(vector: str | Column) -> Column:
    """The code of a vector of up to 64 numbers: bit i is set where number i is above zero.

    Null for a null or empty vector; null elements count as zero; a longer vector is an error.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    bit = F.transform(v, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    fits = F.when(F.size(v) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits, the vector is longer")).cast("array<bigint>")).otherwise(bit)
    code = F.aggregate(fits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return F.when(F.size(v) > 0, code)


def _segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each part."""
    edges = [BITS * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _part(code: str, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(code), lo).bitwiseAND((1 << width) - 1)


def _masks(width: int, ones: int) -> Column:
    """All masks of a part with so many ones, as one constant."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(width), ones))), ",").cast("array<bigint>")


def build_index(codes: DataFrame, k: int, segments: int = 4) -> tuple[DataFrame, DataFrame]:
    """(distinct codes with their smallest ids, one index row per code and part); codes has id, code."""
    rank = Window.partitionBy("code").orderBy("id")
    kept = codes.where("id is not null and code is not null").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    distinct = written(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "mih-codes")
    parts = F.array(*[F.struct(F.lit(i).alias("part"), _part("code", lo, w).alias("value")) for i, (lo, w) in enumerate(_segments(segments))])
    index = written(distinct.select("code", F.explode(parts).alias("p")).select("p.part", "p.value", "code"), "mih-index")
    return distinct, index


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """The k nearest codes of each query: (query_id, neighbor_id, distance, rank).

    ``codes`` and ``queries`` have columns ``id`` and ``code`` (long). A query that is also in
    ``codes`` finds itself, at distance zero.
    """
    distinct, index = build_index(codes, k, segments)
    parts = _segments(segments)
    asked = written(queries.where("id is not null and code is not null").select(F.col("code").alias("q")).distinct(), "mih-queries")
    total = distinct.agg(F.sum(F.size("ids"))).first()[0] or 0
    found = None
    # bound: distance that is covered so far; kth: the kth distance found so far (null: fewer found)
    open_ = asked.select("q", F.lit(None).cast("int").alias("kth"))
    for s in range(max(w for _, w in parts) + 1):
        covered = segments * s - 1
        probes = None
        for i, (lo, w) in enumerate(parts):
            if s > w:
                continue
            # with parts 0..i-1 done at this radius, distances up to covered + i are provably complete
            mine = open_.where(F.col("kth").isNull() | (F.col("kth") > covered + i))
            here = mine.select("q", "kth", F.lit(i).alias("part"), F.explode(_masks(w, s)).alias("mask")).select("q", "kth", "part", _part("q", lo, w).bitwiseXOR(F.col("mask")).alias("value"))
            probes = here if probes is None else probes.unionByName(here)
        if probes is None:
            break
        # a merge join: the probes are many more than the estimate of their source says
        near = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        hits = probes.join(index.hint("merge"), ["part", "value"]).where(F.col("kth").isNull() | (near <= F.col("kth"))).select("q", "code", near.alias("distance")).distinct()
        joined = hits.join(distinct, "code").select("q", "code", "distance", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n"))
        found = joined if found is None else found.unionByName(joined).distinct()
        # the k best codes by (distance, smallest id) hold the k best rows
        best = Window.partitionBy("q").orderBy("distance", "first_id")
        found = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), f"mih-found-{s}")
        run = Window.partitionBy("q").orderBy("distance", "first_id").rowsBetween(Window.unboundedPreceding, 0)
        kth = found.withColumn("have", F.sum("n").over(run)).where(F.col("have") >= min(k, total)).groupBy("q").agg(F.min("distance").alias("kth"))
        left = asked.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > segments * (s + 1) - 1))
        open_ = written(left, f"mih-open-{s}")
        if open_.isEmpty():
            break
    items = found.join(distinct.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    top = items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    who = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return who.join(top, "q").select("query_id", "neighbor_id", "distance", "rank")
