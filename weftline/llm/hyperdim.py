"""Language identification by hyperdimensional profiles (Joshi, Halseth and Kanerva, 2016).

Every character has a random vector of ``dims`` signs, made from its code point by a hash, so no table
of letters is learned or sent. A trigram is bound from its letters: the first permuted (rolled) twice, the second once,
the third not at all, multiplied sign by sign. A text is the bundle (sum) of the vectors of its trigrams, a language the
bundle of its training texts. A text gets the language whose prototype has the greatest cosine with its vector, after the
mean of the unit prototypes, which is what all languages have in common, is taken off both.

Trigrams are of lower-case letters and marks inside words, with a space before and after each word; everything else
ends a word. Sums are of whole numbers, so results don't depend on the partitioning.

Learning sums one vector a language and task, then over the tasks of a salt, then over salts: only ``dims``
numbers a language reach the driver and all tasks. More than ``MOST_LANGUAGES`` languages are refused.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be learned;
rows with a null language or a null id teach nothing, nor do texts without letters; ties go to the language that comes first; a text of any length is taken
whole, in blocks; repeated rows count as often as they come; an empty table gives an empty result; extra columns are not looked at. A language whose
training texts have no letters is not learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mix, own_columns, pieces

MOST_LANGUAGES = 1024
#: documents and characters that share calls, trigrams whose vectors exist at once
GROUP_TEXTS, GROUP_CHARS, GRAMS = 256, 1 << 20, 2048
SPACE = 32
_KIND = np.zeros(0x110000, dtype=np.uint8)  # 0: not looked up, 1: other, 2: mark, 3: letter
_KIND[SPACE] = 1


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _kinds(points: np.ndarray) -> np.ndarray:
    """Of each code point whether it is a letter (3), a mark (2) or something else (1)."""
    kinds = _KIND[points]
    if (kinds == 0).any():
        for p in np.unique(points[kinds == 0]).tolist():
            _KIND[p] = {"L": 3, "M": 2}.get(unicodedata.category(chr(p))[0], 1)
        kinds = _KIND[points]
    return kinds


def letters(points: np.ndarray, dims: int) -> np.ndarray:
    """(points, dims) bits: the signs of the vectors of some characters."""
    cells = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dims // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    return np.unpackbits(mix(cells).view(np.uint8).reshape(len(points), -1), axis=1)


def _grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, owner, trigram) of groups of texts: owners count from the first; a long text may come in several groups."""
    first, at, size = 0, [], 0

    def flush(last: int):
        points = np.concatenate([x for text in at for x in (text, [SPACE])]).astype(np.int64) if at else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(at)), [len(t) + 1 for t in at])
        points = np.where(_kinds(points) > 1, points, SPACE)
        points, owner = np.append(SPACE, points), np.append(0, owner)
        # one space between words; a word's trigrams are those with a letter in the middle
        keep = np.append(True, (points[1:] != SPACE) | (points[:-1] != SPACE))
        points, owner = points[keep], owner[keep]
        for lo in range(0, max(0, len(points) - 2), GROUP_CHARS):
            part, own = points[lo : lo + GROUP_CHARS + 2], owner[lo + 1 : lo + GROUP_CHARS + 1]
            gram = (part[:-2] << 42) | (part[1:-1] << 21) | part[2:]
            inside = part[1:-1] != SPACE
            yield first, own[: len(gram)][inside], gram[inside]

    for i, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") if text else np.zeros(0, dtype="<u4")
        if at and (size + len(points) > GROUP_CHARS or len(at) >= GROUP_TEXTS):
            yield from flush(i)
            first, at, size = i, [], 0
        at.append(points)
        size += len(points)
    yield from flush(len(texts))


def bundle(owner: np.ndarray, grams: np.ndarray, rows: int, dims: int) -> np.ndarray:
    """(rows, dims): the sum of the trigram vectors of each owner."""
    out = np.zeros((rows, dims))
    known, at = np.unique(grams, return_inverse=True)
    mask = np.int64((1 << 21) - 1)
    parts = [known >> 42, (known >> 21) & mask, known & mask]
    alphabet = np.unique(np.concatenate(parts))
    signs = letters(alphabet, dims)
    rolled = [np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs]
    places = [np.searchsorted(alphabet, p) for p in parts]
    # below 2**24 single precision is exact
    kind = np.float32 if len(grams) < 1 << 24 else np.float64
    order = np.argsort(at, kind="stable") if len(known) > GRAMS else None
    at, owner = (at, owner) if order is None else (at[order], owner[order])
    for lo in range(0, len(known), GRAMS):
        hi = min(len(known), lo + GRAMS)
        a, b = (0, len(at)) if order is None else np.searchsorted(at, (lo, hi))
        counts = np.bincount(owner[a:b] * (hi - lo) + at[a:b] - lo, minlength=rows * (hi - lo)).reshape(rows, -1)
        bits = rolled[0][places[0][lo:hi]] ^ rolled[1][places[1][lo:hi]] ^ rolled[2][places[2][lo:hi]]
        out += counts.astype(kind) @ (1 - 2 * bits.astype(kind))
    return out


def vectors(texts: list[str | None], dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, vectors, trigrams of each) of groups of texts."""
    start, total, n = 0, np.zeros((0, dims)), np.zeros(0, dtype=np.int64)
    for first, owner, grams in _grams(texts):
        rows = int(owner[-1]) + 1 if len(owner) else 0
        if first != start:
            yield start, total, n
            start, total, n = first, np.zeros((0, dims)), np.zeros(0, dtype=np.int64)
        if rows > len(total):
            total, n = np.concatenate((total, np.zeros((rows - len(total), dims)))), np.append(n, np.zeros(rows - len(n), dtype=np.int64))
        if rows:
            total[:rows] += bundle(owner, grams, rows, dims)
            n[:rows] += np.bincount(owner, minlength=rows)
    yield start, total, n


class Profiles:
    """Languages and their centred unit prototypes; ``mean`` is what was taken off."""

    def __init__(self, names: list[str], sums: np.ndarray):
        self.names = names
        unit = sums / np.linalg.norm(sums, axis=1, keepdims=True) if len(names) else sums
        self.mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(sums.shape[1])
        centred = unit - self.mean
        self.prototypes = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def cosines(self, sums: np.ndarray) -> np.ndarray:
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12) - self.mean
        return unit @ self.prototypes.T / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, dims: int = 2048, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages of all rows that are not held out."""
    if dims <= 0 or dims % 64:
        raise ValueError("dims is a multiple of 64")
    src = own_columns(docs, key=docs[id_col].cast("string"), lang=docs[lang_col].cast("string"), text=docs[text_col].cast("string"))
    rows = src.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key"))).select("lang", "text")
    salts = max(1, round(rows.rdd.getNumPartitions() ** 0.5))

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for _, some, _ in vectors([t for t, x in zip(texts, langs) if x == lang], dims):
                    sums[lang] = sums.get(lang, 0) + some.sum(axis=0)
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "salt": pa.array([salt] * len(sums), pa.int32()), "sums": pa.array([np.broadcast_to(v, (dims,)).astype("<i8").tobytes() for v in sums.values()], pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(dims, dtype=np.int64)
        for x in group.column("sums"):
            total += np.frombuffer(x.as_py(), dtype="<i8")
        return pa.table({"lang": group.column("lang").slice(0, 1), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, salt int, sums binary"
    parts = rows.mapInArrow(partial, kind).groupBy("lang", "salt").applyInArrow(summed, kind)
    out = parts.groupBy("lang").applyInArrow(summed, kind).orderBy("lang").limit(MOST_LANGUAGES + 1).select("lang", "sums").collect()
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    learned = [(r["lang"], s) for r in out if (s := np.frombuffer(r["sums"], dtype="<i8").astype(float)).any()]
    return Profiles([x for x, _ in learned], np.array([s for _, s in learned]).reshape(len(learned), dims))


def predict(text: Column, profiles: Profiles, docs: DataFrame) -> Column:
    """A struct of lang_pred and score (the greatest cosine, 0 where it is negative) for a text. It sees nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        p = shared.value
        dims = len(p.mean)
        langs, scores = [], []
        for i in range(0, len(texts), GROUP_TEXTS):
            some = texts.slice(i, GROUP_TEXTS).to_pylist()
            found, best = ["und"] * len(some), np.zeros(len(some))
            lettered = np.array([bool(t) and bool((_kinds(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")) == 3).any()) for t in some])
            for first, sums, _ in vectors(some, dims) if p.names else ():
                if not len(sums):
                    continue
                cosines = p.cosines(sums)
                top = cosines.argmax(axis=1)
                for k in np.flatnonzero(lettered[first : first + len(sums)]).tolist():
                    found[first + k], best[first + k] = p.names[top[k]], min(1.0, max(0.0, cosines[k, top[k]]))
            langs += found
            scores.append(best)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])

    return run(text.cast("string"))


def identify(docs: DataFrame, dims: int = 2048, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with profiles of the rows that are not held out."""
    profiles = train(docs, dims, id_col, text_col, lang_col)
    src = own_columns(docs, doc_id=id_col, held_out=held_out(docs[id_col]), found=predict(docs[text_col], profiles, docs))
    return src.select("doc_id", "held_out", F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))
