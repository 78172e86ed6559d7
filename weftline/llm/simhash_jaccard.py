"""Near-dedup for a similarity threshold (pipelines), next to the SimHash bit-distance operator.

At a similarity of 0.8 on 5-word shingles two 64-bit SimHashes differ in about ten bits, where
blocks of bits no longer bring pairs together, and no number of bits is a bound: sets of that
similarity may differ in more. So no SimHash rejects a pair, and pairs meet by shared minima: a text's shingle
hashes fall into ``BINS`` bins, and each band of ``ROWS`` bin minima is a key that two texts of
similarity 0.8 share in one of the ``BANDS`` bands with a chance of 0.997. In buckets of up to
``SMALL`` texts all pairs meet. In a larger one about ``ANCHORS`` texts meet all others; after
that, only texts outside the bucket's largest group so far have anything left to join. Of those,
four times as many each round meet all texts of other groups, until every one has: no two
texts of a bucket are left unmet but those that are already in one group, and a group of near
copies needs no pairs beyond its anchors'. Pairs are discarded only by the sizes of their shingle
sets, the smaller of which has at least 0.8 of the larger one's shingles at a similarity of 0.8; all
others are verified by the exact Jaccard similarity of the sets.

Equal texts are one text with the smallest id. Defined cases: null and empty texts are equal
texts; a text of fewer than five words is one shingle; rows with a null id are left alone; rows that repeat
an id go or stay together; very long texts are hashed whole; an empty table gives no groups; ties
don't arise, as ids differ; extra columns come back as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, filter_bits, hashed_texts, long_array, mix, own_columns, passes, pieces, shingles, without, written
from weftline.llm.components import components

WIDTH, THRESHOLD, BINS, ROWS, BANDS, SMALL, ANCHORS = 5, 0.8, 256, 8, 32, 256, 32
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


_SEEDS = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _minima(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) minima per bin; an empty bin takes the minimum of all hashes under a function of
    its own, so that the rows of a band stay independent in short texts."""
    sig = np.full(n * BINS, _NONE)
    np.minimum.at(sig, text * BINS + (h >> np.uint64(56)).astype(np.int64), h)
    sig = sig.reshape(n, BINS)
    cuts = np.searchsorted(text, np.arange(n + 1))
    for i in range(n):
        empty = np.flatnonzero(sig[i] == _NONE)
        if len(empty) and cuts[i + 1] > cuts[i]:
            own = h[cuts[i] : cuts[i + 1]]
            own = np.unique(own) if len(own) > 2000 else own
            sig[i, empty] = mix(own[:, None] ^ _SEEDS[empty][None, :]).min(axis=0)
    return sig


def _set_sizes(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many distinct shingles each text has."""
    cuts = np.searchsorted(text, np.arange(n + 1))
    return np.array([len(np.unique(h[a:b])) for a, b in zip(cuts, cuts[1:])], dtype=np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, size, bands) of (id, text) rows: size of the shingle set and band keys."""

    def run(batches):
        for batch in pieces(batches):
            sizes, keys = [], []
            for lo, hi, bounds, hashes, *_ in hashed_texts(batch.column("text").to_pylist()):
                h, text, _, _ = shingles(hashes, bounds, width)
                sizes.append(_set_sizes(h, text, hi - lo))
                sig = _minima(h, text, hi - lo)
                band = np.zeros((hi - lo, BANDS), dtype=np.uint64)
                for b in range(BANDS):
                    k = np.full(hi - lo, b + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
                    band[:, b] = k
                keys.append(band)
            if sizes:
                n = sum(len(x) for x in sizes)
                flat = pa.array(long_array(np.concatenate(keys).ravel()))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "size": np.concatenate(sizes), "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)})

    return docs.select("id", "text").mapInArrow(run, "id long, size long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, hs): the distinct shingle hashes of the wanted ids (and of few others, that pass the filter)."""
    wanted = written(wanted, "near-wanted")
    table = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("id").alias("h")), "h", filter_bits(wanted.count())))
    src = docs.select("id", "text", F.xxhash64("id").alias("key"))

    def run(batches):
        for batch in pieces(batches):
            keys = np.array(batch.column("key").to_pylist(), dtype=np.int64).view(np.uint64)
            some = batch.filter(pa.array(passes(table.value, keys)))
            sets = []
            for lo, hi, bounds, hashes, *_ in hashed_texts(some.column("text").to_pylist()):
                h, text, _, _ = shingles(hashes, bounds, width)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                sets += [long_array(np.unique(h[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({"id": some.column("id"), "hs": pa.array(sets, pa.list_(pa.int64()))})

    return src.mapInArrow(run, "id long, hs array<long>").dropDuplicates(["id"])


def _verified(close: DataFrame, texts: DataFrame, threshold: float, label: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``threshold``."""
    close = written(close.distinct(), f"near-close-{label}")
    sets = written(shingle_sets(texts, close.select(F.explode(F.array("a", "b")).alias("id")).distinct()), f"near-sets-{label}")
    both = close.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hs").alias("hb")), "b")
    same = F.size(F.array_intersect("ha", "hb"))
    return written(both.where(same >= threshold * (F.size("ha") + F.size("hb") - same)).select("a", "b"), f"near-good-{label}")


def links(texts: DataFrame, skip: DataFrame | None = None, threshold: float = THRESHOLD, small: int = SMALL, anchors: int = ANCHORS) -> DataFrame:
    """Verified pairs (a, b) of the ids of (id, text) rows, but those of ``skip``; of rows that
    repeat an id one counts. Texts are scanned, not shuffled."""
    held = sketches(texts)
    held = written((held if skip is None else held.join(skip, "id", "left_anti")).dropDuplicates(["id"]), "near-sketches")
    cols = ["id", "size", "key"]
    members = written(held.select("id", "size", F.explode("bands").alias("key")), "near-members")

    def meet(xs: DataFrame, ys: DataFrame, unlike) -> DataFrame:
        x, y = xs.alias("x"), ys.alias("y")
        # a hair below the threshold, as products are rounded
        close = F.least("x.size", "y.size") >= (threshold - 1e-9) * F.greatest("x.size", "y.size")
        return x.join(y, (F.col("x.key") == F.col("y.key")) & unlike & close).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    # sizes are written, so that the join shuffles both sides and AQE can split a hot bucket
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    sized = written(members.join(sizes, "key"), "near-sized")
    few = sized.where(F.col("n") <= small)
    found = _verified(meet(few, few, F.col("x.id") < F.col("y.id")), texts, threshold, "few")
    left = sized.where(F.col("n") > small).select(*cols, F.lit(False).alias("met"))
    share = anchors
    while not left.isEmpty():
        comps = components(found).withColumnRenamed("node", "id")
        labelled = written(left.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-labelled")
        shares = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if(~F.col("met")).alias("open"))
        main = F.max(F.struct("n", "component", "open"))
        buckets = shares.groupBy("key").agg(main["component"].alias("main"), (F.sum("open") - main["open"]).alias("open")).where("open > 0")
        chosen = ~F.col("met") & (F.col("component") != F.col("main")) & (F.pmod(F.xxhash64("id", F.lit(share)), F.greatest(F.floor(F.col("open") / share), F.lit(1))) == 0)
        now = written(labelled.join(written(buckets, "near-buckets"), "key").withColumn("anchor", chosen), "near-round")
        pairs = meet(now.where("anchor"), now, F.col("x.component") != F.col("y.component"))
        found = found.unionByName(_verified(pairs, texts, threshold, "many"))
        left = now.select(*cols, (F.col("met") | F.col("anchor")).alias("met"))
        share *= 4
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gone: DataFrame | None = None, **how) -> DataFrame:
    """(id, group): every id of ``docs`` that is not the smallest of its group of equal or similar texts. Ids in the one column of ``gone``
    are in no group, as if ``docs`` were without them; they are told apart by id, so that no text is copied, shuffled or filtered again and again."""
    src = own_columns(docs, id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col], F.lit(""))).where("id is not null")
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    equal = src.select("id", *key)
    equal = written(equal if gone is None else equal.join(gone.toDF("id"), "id", "left_anti"), "near-equal")
    # written, so that the join shuffles both sides and AQE can split a large group of copies
    first = written(equal.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "near-first")
    copies = equal.join(first, ["k1", "k2"]).where("id <> first").select("id", "first").distinct()
    copies = written(copies, "near-copies")
    skip = copies.select("id")
    comps = components(links(src, skip=skip if gone is None else skip.union(gone), **how))
    moved = comps.where("node <> component")
    via = copies.join(comps.select(F.col("node").alias("first"), "component"), "first", "left").select("id", F.coalesce("component", "first").alias("group"))
    return moved.select(F.col("node").alias("id"), F.col("component").alias("group")).unionByName(via)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gone: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group, and without the ids in ``gone``, which are in no group."""
    drop = groups(docs, id_col, text_col, gone, **how).select("id")
    return without(docs, docs[id_col].cast("long"), drop if gone is None else drop.union(gone))
