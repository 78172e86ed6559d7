"""Benchmark decontamination: size-partitioned MinHash containment search.

(After Zhu, Nargesian, Pu, Miller: LSH Ensemble, 2016.) Test items are short, documents long, so
what counts is containment: the part of an item's distinct 5-word shingles that a document has.
MinHash bands over whole documents can't see this (the Jaccard similarity of a 40-shingle item
and a 20,000-word document is below 0.002), so the sketch is asymmetric: an item's sketch is its
bottom-k shingle hashes, with k set by the size partition of the item. An item of n shingles
that is contained to ``threshold`` misses at most ``n - ceil(threshold * n)`` of them, so with
k one more than that for the largest n of the partition, a document holds one of the k at
least: no contained item is lost, at any document length. Candidates are then verified by exact
shingle containment, on the words themselves.

Documents are scanned once. A task hashes all shingles of a text against two filters of bounded
size, built from the sketches and from all item shingles; documents without a sketch hit give
no rows, others give the shingles (as text) that may belong to an item. A document has no sketch of
its own, as all its shingles are looked at. Pairs of a document and an item that meet in the sketch
are candidates, and only their shingles are compared. Any number of items goes through joins, not a
broadcast.

Words: lower-cased runs of ASCII letters, digits and any non-ASCII characters.

Defined cases: null and empty texts have no shingles and match nothing; an item or a document
of fewer than five words has one shingle, its whole sequence; repeated items each match;
repeated rows of a document (same id) count as one document with the union of their shingles;
null ids of either side are kept out of the result; ties don't arise; very long texts are hashed
whole, in blocks; without documents or items there are no pairs; extra columns are not looked at, and
``clean`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, filter_bits, hashed_texts, long_array, own_columns, passes, pieces, shingles, without, written

#: the sketch filter has so many bits at least, as one stranger among a long document's shingles lets it through
WIDTH, THRESHOLD, DOC_BITS = 5, 0.8, 24


def _shingle_text(data: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> str:
    return b" ".join([data[starts[i] : ends[i]] for i in range(first, last + 1)]).decode("utf-8", "replace")


def _rows(texts, ids: pa.Array, width: int, keep) -> pa.RecordBatch:
    """One row (id, h, shingle) for each distinct shingle of each text that ``keep(hashes, text)`` lets through."""
    row, h, words = [], [], []
    for lo, _, bounds, hashes, starts, ends, data in hashed_texts(texts):
        sh, text, first, last = shingles(hashes, bounds, width)
        at = np.flatnonzero(keep(sh, text))
        row.append(text[at] + lo)
        h.append(sh[at])
        words += [_shingle_text(data, starts, ends, int(first[i]), int(last[i])) for i in at]
    rows = np.concatenate(row) if row else np.empty(0, np.int64)
    out = pa.RecordBatch.from_pydict({"id": ids.take(pa.array(rows)), "h": long_array(np.concatenate(h)) if h else np.empty(0, np.int64), "shingle": pa.array(words, pa.string())})
    return out


def item_shingles(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, h, shingle): the distinct shingles of each item."""

    def run(batches):
        for batch in pieces(batches):
            yield _rows(batch.column("text").to_pylist(), batch.column("id"), width, lambda sh, _: np.ones(len(sh), dtype=bool))

    src = own_columns(items, id=items[id_col].cast("long"), text=text_col).where("id is not null")
    return src.mapInArrow(run, "id long, h long, shingle string").distinct()


def sketch_size(n: int, threshold: float) -> int:
    """Bottom-k size for items of up to n shingles: one more than a contained item can miss."""
    return n - math.ceil(round(threshold * n, 9)) + 1



def sketches(shingled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n, sketch): the number of distinct shingles and the bottom-k hashes of each item.

    Size partitions are powers of two (an item's k is that of its partition's largest n, at most
    its own n).
    """
    edges = [1 << i for i in range(31)]
    n = shingled.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("h")).alias("hs"))
    k = F.coalesce(*[F.when(F.col("n") <= e, F.lit(sketch_size(e, threshold))) for e in edges])
    return n.select("id", "n", F.slice("hs", 1, F.least(F.col("n"), k).cast("int")).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, matched, item_shingles, containment) of every pair at or above ``threshold``."""
    spark = docs.sparkSession
    table = written(item_shingles(items, item_id_col, item_text_col, width), "decontam-items")
    sizes = written(sketches(table, threshold), "decontam-sketches")
    sketch = sizes.select("id", F.explode("sketch").alias("h"))
    in_sketch = spark.sparkContext.broadcast(bit_filter(sketch, "h", max(DOC_BITS, filter_bits(sketch.count()))))
    in_items = spark.sparkContext.broadcast(bit_filter(table, "h", filter_bits(table.count())))

    def keep(sh: np.ndarray, text: np.ndarray) -> np.ndarray:
        hit = passes(in_sketch.value, sh)
        if not hit.any():
            return hit
        some = np.zeros(int(text[-1]) + 1, dtype=bool)
        some[text[hit]] = True
        return some[text] & passes(in_items.value, sh)

    def run(batches):
        for batch in pieces(batches):
            yield _rows(batch.column("text").to_pylist(), batch.column("id"), width, keep)

    src = own_columns(docs, id=docs[id_col].cast("long"), text=text_col).where("id is not null")
    seen = written(src.mapInArrow(run, "id long, h long, shingle string").distinct(), "decontam-seen")
    # candidates: some shingle of the item's sketch is in the document
    candidates = written(seen.select(F.col("id").alias("doc_id"), "h").join(sketch.withColumnRenamed("id", "item_id"), "h").select("doc_id", "item_id").distinct(), "decontam-candidates")
    # verification of these: distinct item shingles that the document has, by their words
    wanted = candidates.join(table.withColumnRenamed("id", "item_id"), "item_id")
    matched = wanted.join(seen.withColumnRenamed("id", "doc_id"), ["doc_id", "h", "shingle"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"))
    pairs = matched.join(sizes.select(F.col("id").alias("item_id"), F.col("n").alias("item_shingles")), "item_id")
    share = F.col("matched") / F.col("item_shingles")
    return pairs.where(F.col("matched") >= F.ceil(F.round(F.col("item_shingles") * threshold, 9))).select("doc_id", "item_id", "matched", "item_shingles", share.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that contain an item; rows with a null id stay."""
    return without(docs, docs[id_col].cast("long"), contained(docs, items, id_col, **how).select("doc_id"))
