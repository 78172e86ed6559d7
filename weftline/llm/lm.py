"""Cross-entropy difference of two n-gram models (Moore and Lewis, 2010).

A target and a background model of the same kind share one vocabulary: every distinct word of all
documents and an end mark, nothing is cut off or mapped to an unknown word. A model is of orders one
and two, and a token's loss is the weighted mean of its losses under both:

- order one: ``(c(b) + UNSEEN) / (N + UNSEEN * V)``
- order two: ``(c(ab) + MASS / V) / (c(a) + MASS)``

with counts c, N tokens and V words. As every document is closed by the end mark, a word is a
context as often as it is a token (the start of a text counts as its end mark does), so the loss of
a document is a sum of one term for each of its words and one for each of its bigrams, and every
term needs a single count. The score is the mean over the tokens, the end mark included, of target
loss minus background loss; lower means more like the target. Matched: the target's counts are
scaled to the background's token total, so that smoothing weighs alike in both.

A document's own words are no evidence of what it is like: each is scored by the counts of all other documents, its own
occurrences taken off both models. So a document of the target and a like one that is not score alike. (Totals
and vocabulary, in which a document is next to nothing, stay those of all.)

All counts are over all documents and whole texts. Words and bigrams are 64-bit hashes. What occurs
once in all documents needs no row: without the document that has it, its count is zero. The rest is the model table; it grows with the
input and is never sent whole to a task:

- each task counts its grams and sends them by part, sorted, as packed differences; a part's counts
  meet in one task, which keeps what occurs more than once. Parts grow with the bytes of text, tasks that take
  one part after the other up to ``MOST_TASKS``;
- grams with a share of at least ``2**-HOT_BITS`` of all tokens, at most ``2**(HOT_BITS + 1)`` rows,
  go to all tasks, so that frequent grams are looked up where the text is read and none is hot;
- for the others each block of documents sends what it asks (once a document, with how often) to
  their parts; the rows of a part go ahead in the same sorted partition, and a task answers while
  questions stream by, holding one part's rows;
- a bit filter of the table (of bounded size, a stretch for each part) lets what occurs once stay at home.

Defined cases: null and empty texts have no tokens and score zero; repeated rows count as often as
they come, and each is scored; an empty target gives losses of the uniform share; null ids are scored
like any other, as background; very long texts are hashed in blocks, whole; an empty table gives no
rows; there are no ties. Extra columns are not looked at. Results are rounded to nine places, as the
order of sums is not fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import MOST_BITS, bit_filter, filter_bits, hashed_texts, maybe, mix, own_columns, pieces, written

#: weight of order two, unseen mass of orders one and two
WEIGHT, UNSEEN, MASS = 0.6, 0.5, 20.0
#: share of a gram that is sent to all tasks; tokens of a block of questions; grams that a task holds; bytes of text of a part
HOT_BITS, BLOCK_TOKENS, HELD, PART_BYTES, LEAST_PARTS = 18, 1 << 18, 1_000_000, 1 << 24, 256
#: reduce tasks, at any size
MOST_TASKS = 4096
#: in the number of a row's grams, the bit that says that the row is of the target
OF_TARGET = np.uint32(1 << 31)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_BASE = np.uint64(0x9E3779B97F4A7C15)
MESSAGE = "key int, kind int, a binary, b binary, c binary, d binary"
MODEL = "key int, size long, words long, n long, t long, a binary, b binary, c binary"
SUMS = "row long, doc_id long, n_tokens long, n_loss double, t_loss double, words long, pairs long"


def _packed(x: np.ndarray) -> bytes:
    """64-bit values, equal places of their bytes side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, words, bigrams, text of each) of groups of texts: a text of words has an end
    mark after them. The lowest bit tells bigrams (1) from words (0)."""
    for lo, hi, bounds, hashes, *_ in hashed_texts(texts):
        n = np.diff(bounds)
        full = n > 0
        size = n + full
        ends = np.cumsum(size)
        word = np.full(int(ends[-1]) if len(ends) else 0, END)
        word[np.arange(len(hashes)) + np.repeat(np.cumsum(full) - full, n)] = hashes
        before = np.concatenate(([START], word[:-1]))[: len(word)]
        before[(ends - size)[full]] = START
        yield lo, hi, word & ~np.uint64(1), mix(before * _BASE + word) | np.uint64(1), np.repeat(np.arange(hi - lo), size)


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    return (mix(gram) & np.uint64(parts - 1)).astype(np.int64)


def _by_part(gram: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the grams of each part, in their order."""
    part = _part(gram, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(part[order[lo]]), order[lo:hi]


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    key, kind, *columns = zip(*rows)
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int32()), "kind": pa.array(kind, pa.int32())} | {k: pa.array(x, pa.binary()) for k, x in zip("abcd", columns)})


def _counts(texts: DataFrame, kind: int, parts: int) -> DataFrame:
    """How often each word and bigram occurs in each task, by part: sorted grams as packed differences, and counts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit():
            gram, inverse = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            rows = [(p, kind, _packed(np.diff(gram[at], prepend=np.uint64(0))), _packed(n[at]), None, None) for p, at in _by_part(gram, parts)]
            for i in range(0, len(rows), 1024):
                yield _messages(rows[i : i + 1024])

        for batch in pieces(batches):
            for _, _, words, pairs, _ in _grams(batch.column("text").to_pylist()):
                if len(words):
                    held.append(np.unique(np.concatenate((words, pairs)), return_counts=True))
                if sum(len(g) for g, _ in held) > HELD:
                    yield from emit()
                    held.clear()
        if held:
            yield from emit()

    return texts.select("text").mapInArrow(run, MESSAGE)


def _model(counts: DataFrame, parts: int) -> DataFrame:
    """A row for each part: its words, their sums of n and t, and, packed, the grams that occur more than once with n and t."""

    def run(batches):
        key, held = None, []

        def emit():
            kinds, grams, ns = zip(*held)
            gram, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            of_target = np.repeat(np.array(kinds) == 1, [len(g) for g in grams])
            often = np.concatenate(ns)
            n, t = (np.bincount(inverse, weights=np.where(of_target == inside, often, 0)).astype(np.int64) for inside in (False, True))
            word, many = (gram & np.uint64(1)) == 0, n > 1
            values = [key, int(many.sum()), int(word.sum()), int(n[word].sum()), int(t[word].sum()), _packed(np.diff(gram[many], prepend=np.uint64(0))), _packed(n[many]), _packed(t[many])]
            return pa.RecordBatch.from_pydict({k: pa.array([v], kind) for k, v, kind in zip(("key", "size", "words", "n", "t", "a", "b", "c"), values, [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3])})

        for batch in pieces(batches):
            for k, kind, a, b in zip(*(batch.column(x).to_pylist() for x in ("key", "kind", "a", "b"))):
                if k != key and held:
                    yield emit()
                    held = []
                key = k
                held.append((kind, np.cumsum(_unpacked(a, np.uint64), dtype=np.uint64), _unpacked(b)))
        if held:
            yield emit()

    return counts.repartition(min(max(parts // 4, 1), MOST_TASKS), "key").sortWithinPartitions("key").mapInArrow(run, MODEL)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(row["a"], np.uint64), dtype=np.uint64), _unpacked(row["b"]), _unpacked(row["c"])


def _hot(model: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, n and t of the table's grams that occur at least so often; the caller bounds how many."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                gram, n, t = _opened(row)
                at = n >= least
                yield pa.RecordBatch.from_pydict({"gram": gram[at].view(np.int64), "n": n[at], "t": t[at]})

    got = model.mapInArrow(run, "gram long, n long, t long").toArrow()
    gram, n, t = (got.column(c).to_numpy() for c in ("gram", "n", "t"))
    order = np.argsort(gram.view(np.uint64))
    return gram.view(np.uint64)[order], n[order], t[order]


def _stretch(gram: np.ndarray, bits: int) -> np.ndarray:
    return (gram >> np.uint64(1)) & np.uint64(bits - 1)


def _filter(model: DataFrame, parts: int, bits: int) -> np.ndarray:
    """(parts, bytes) bits: each part has a stretch of its own, so the driver only puts them side by side."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flags = np.zeros(bits, dtype=bool)
                flags[_stretch(_opened(row)[0], bits).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict({"key": pa.array([row["key"]], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((parts, bits // 8), dtype=np.uint8)
    got = model.mapInArrow(run, "key int, bits binary").toArrow()
    for k, b in zip(got.column("key").to_pylist(), got.column("bits")):
        out[k] = np.frombuffer(b.as_buffer(), np.uint8)
    return out


def _may_be_in(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = _stretch(gram, table.shape[1] * 8).astype(np.int64)
    return (table[_part(gram, len(table)), at >> 3] >> (at & 7)) & 1 == 1


class _Losses:
    """Terms of words and bigrams under the background and the target model."""

    def __init__(self, n: int, t: int, vocabulary: int):
        self.total, self.vocabulary = n, max(vocabulary, 1)
        self.scale = n / t if t else 0.0

    def __call__(self, gram: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, out = (gram & np.uint64(1)) == 1, []
        for c, total in ((n.astype(np.float64), self.total), (t * self.scale, self.total if self.scale else 0)):
            word = WEIGHT * np.log(c + MASS) - (1 - WEIGHT) * (np.log(c + UNSEEN) - np.log(total + UNSEEN * self.vocabulary))
            out.append(np.where(pair, -WEIGHT * np.log(c + MASS / self.vocabulary), word))
        return tuple(out)


def _looked_up(known: tuple[np.ndarray, ...], losses: _Losses, gram: np.ndarray, often: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, n_loss, t_loss) of grams that a document has so often, by the counts of the others: zero where the gram is not
    known. ``inside``: whether the document is of the target."""
    found, n_loss, t_loss = np.zeros(len(gram), dtype=bool), np.zeros(len(gram)), np.zeros(len(gram))
    if not len(known[0]) or not len(gram):
        return found, n_loss, t_loss
    at = np.minimum(np.searchsorted(known[0], gram), len(known[0]) - 1)
    found = known[0][at] == gram
    at, own = at[found], often[found].astype(np.int64)
    n_loss[found], t_loss[found] = losses(gram[found], known[1][at] - own, known[2][at] - own * inside[found])
    return found, n_loss, t_loss


def _asked(rows: DataFrame, hot, table, losses: _Losses, parts: int) -> DataFrame:
    """The questions of each block of documents by part (kind 1: grams, how often, rows, grams of
    each row and whether it is of the target), and what needs no question (kind 2: rows, ids and tokens, sums, single words and bigrams)."""

    def block(ids: np.ndarray, doc: pa.Array, target: np.ndarray, held: list[tuple]) -> pa.RecordBatch:
        """``held``: (first text, words, bigrams, text of each) of the groups of a block."""
        first_text, count = held[0][0], held[-1][0] + held[-1][4] - held[0][0]
        gram, text = (np.concatenate([x for f, w, p, of, _ in held for x in pair(w, p, of + (f - first_text))]) for pair in (lambda w, p, of: (w, p), lambda w, p, of: (of, of)))
        size = np.bincount(text, minlength=count) // 2
        order = np.lexsort((gram, text))
        gram, text = gram[order], text[order]
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))) if len(gram) else np.empty(0, np.int64)
        often = np.diff(np.append(first, len(gram)))
        gram, text = gram[first], text[first]
        target = target[first_text : first_text + count]
        found, n_loss, t_loss = _looked_up(hot.value, losses, gram, often, target[text])
        ask = ~found & _may_be_in(table.value, gram)
        single, bigram = ~found & ~ask, (gram & np.uint64(1)) == 1
        sums = [np.bincount(text, weights=w, minlength=count) for w in (n_loss * often, t_loss * often, single & ~bigram, single & bigram)]
        ids, doc = ids[first_text : first_text + count], doc.slice(first_text, count)
        null = np.array([not x.is_valid for x in doc]) if doc.null_count else np.zeros(count, dtype=bool)
        who = np.stack([doc.fill_null(0).to_numpy(zero_copy_only=False), null.astype(np.int64), size - (size > 0)]).astype(np.int64)
        out = [(int(_part(ids[:1].view(np.uint64), parts)[0]), 2, ids.tobytes(), who.tobytes(), np.stack(sums[:2]).tobytes(), np.stack(sums[2:]).astype(np.int64).tobytes())]
        gram, text, often = gram[ask], text[ask], often[ask].astype(np.uint32)
        for p, at in _by_part(gram, parts):
            of = text[at]
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out.append((p, 1, gram[at].tobytes(), often[at].tobytes(), ids[of[start]].tobytes(), (np.diff(np.append(start, len(of))).astype(np.uint32) | np.where(target[of[start]], OF_TARGET, np.uint32(0))).tobytes()))
        return _messages(out)

    def run(batches):
        for batch in pieces(batches):
            ids, doc, held = batch.column("row").to_numpy(zero_copy_only=False), batch.column("doc_id"), []
            target = batch.column("of_target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, words, pairs, text in _grams(batch.column("text").to_pylist()):
                held.append((lo, words, pairs, text, hi - lo))
                if sum(len(x[1]) for x in held) >= BLOCK_TOKENS:
                    yield block(ids, doc, target, held)
                    held = []
            if held:
                yield block(ids, doc, target, held)

    return rows.mapInArrow(run, MESSAGE)


def _answered(messages: DataFrame, losses: _Losses, parts: int) -> DataFrame:
    """Sums of each row over the questions of a part; what a part doesn't know occurs once."""
    none_known = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

    def run(batches):
        key, known = None, none_known
        for batch in pieces(batches):
            out: list[tuple] = []
            for k, kind, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("key", "kind", "a", "b", "c", "d"))):
                if k != key:
                    key, known = k, none_known
                if kind == 0:
                    known = _opened({"a": a, "b": b, "c": c})
                    continue
                if kind == 2:
                    rows, (doc, null, n), sums, single = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64).reshape(3, -1), np.frombuffer(c).reshape(2, -1), np.frombuffer(d, np.int64).reshape(2, -1)
                    out.append((rows, doc, null == 1, n, *sums, *single))
                    continue
                gram, often = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)
                rows, length = np.frombuffer(c, np.int64), np.frombuffer(d, np.uint32)
                inside, length = (length & OF_TARGET) != 0, (length & ~OF_TARGET).astype(np.int64)
                found, n_loss, t_loss = _looked_up(known, losses, gram, often, np.repeat(inside, length))
                pair, cuts = (gram & np.uint64(1)) == 1, np.cumsum(length) - length
                sums = [np.add.reduceat(x, cuts) for x in (n_loss * often, t_loss * often, (~found & ~pair).astype(np.int64), (~found & pair).astype(np.int64))]
                none = np.zeros(len(rows), np.int64)
                out.append((rows, none, none == 0, none, *sums))
            if out:
                row, doc, null, n, *sums = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"row": row, "doc_id": pa.array(doc, mask=null), "n_tokens": n} | dict(zip(("n_loss", "t_loss", "words", "pairs"), sums)))

    return messages.repartition(min(max(parts // 4, 1), MOST_TASKS), "key").sortWithinPartitions("key", "kind").mapInArrow(run, SUMS)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of ``docs``.

    ``target``: the ids of the documents that make up the target corpus.
    """
    spark = docs.sparkSession
    src = own_columns(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    ids = written(own_columns(target, target_id=target[target_id_col].cast("long")).where("target_id is not null").distinct(), "lm-target")
    # texts that can't be of the target are not shuffled
    of_target = bit_filter(ids.select(F.xxhash64("target_id").alias("h")), "h", filter_bits(ids.count()))
    may = maybe(F.xxhash64("doc_id"), of_target)
    inside = F.col("doc_id") == F.col("target_id")
    chosen = src.where(may).join(ids.hint("merge"), inside, "left_semi")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max((LEAST_PARTS - 1).bit_length(), (size // PART_BYTES).bit_length())
    model = written(_model(_counts(src, 0, parts).unionByName(_counts(chosen, 1, parts)), parts), "lm-model")
    rows, vocabulary, n, t = (int(x or 0) for x in model.agg(*[F.sum(c) for c in ("size", "words", "n", "t")]).first())
    losses = _Losses(n, t, vocabulary)
    # at most 2**HOT_BITS words and as many bigrams have such a share
    top = _hot(model, max(n, 1) / (1 << HOT_BITS))
    hot = spark.sparkContext.broadcast(top)
    bits = max(8, (1 << min(MOST_BITS, filter_bits(rows))) // parts)
    table = spark.sparkContext.broadcast(_filter(model, parts, bits))

    known = model.select("key", F.lit(0).alias("kind"), "a", "b", "c", F.lit(None).cast("binary").alias("d"))
    marked = src.where(~F.coalesce(may, F.lit(False))).withColumn("of_target", F.lit(False)).unionByName(src.where(may).join(ids.hint("merge"), inside, "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("of_target")))
    rows = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "of_target")
    sums = _answered(known.unionByName(_asked(rows, hot, table, losses, parts)), losses, parts)
    total = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_loss", "t_loss", "words", "pairs")])
    # what occurs once does not occur in the other documents
    none = np.array([0])
    word, pair = ([float(x[0]) for x in losses(np.array([g], np.uint64), none, none)] for g in (0, 1))
    n_loss, t_loss = (F.col(f"{x}_loss") + F.col("words") * word[i] + F.col("pairs") * pair[i] for i, x in enumerate("nt"))
    each = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1).otherwise(1)
    return total.select(
        "doc_id", "n_tokens",
        F.round(t_loss / each, 9).alias("target_loss"),
        F.round(n_loss / each, 9).alias("background_loss"),
        F.round((t_loss - n_loss) / each, 9).alias("score"),
    )
