"""Line dedup by overlapping three-line windows.

A text is cut into lines at newlines and, unless ``within_lines`` is off, as a passage is often pasted into a longer line, after
sentence ends (``. `` ``! `` ``? `` and those of Chinese and Japanese). A line of more than
``LONG`` words is cut on, before words where a hash of the bytes on both sides is smallest among its
neighbours' (at least every ``LONG`` words): the places go by the words around them, so a passage
inside two long lines is cut alike in both. In scripts without spaces each character is a word.

Each run of three consecutive non-blank lines is a window. All windows are hashed and counted over
all documents; of a window that occurs more than once, the first occurrence (smallest doc_id, then
place) is kept and later ones cover their lines. Covered lines that follow one another merge into a
run, and runs are removed.

Texts are cut and hashed once, and the hashes written. Only windows that pass a bit filter of the
repeated hashes are dealt out a second time, so that unique ones are shuffled once, as 8 bytes. Only
texts that may lose lines are shuffled and cut again; the others pass by.

Defined cases: null and empty texts, and texts of fewer than three lines, stay as they are;
blank lines are in no window, and go if the lines on both sides of them go; every later occurrence goes, however small
(with ``min_words`` and ``min_chars``, merged runs below both stay);
a later occurrence that overlaps the first one in the same document leaves the first one's lines; rows that repeat both
doc_id and text are treated alike, so all or none of their lines go; null ids come last; very long texts are taken whole; an empty table
gives no rows; extra columns come back as they are, and the columns added get other names where a
column has theirs already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, dense_characters, filter_bits, long_array, maybe, mix, own_columns, passes, pieces, unused, written

#: scripts written without spaces between words
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\U00020000-\U0003ffff]")
#: words a line may have uncut, and words on each side that a cut is smallest among
LONG, NEAR = 12, 4
BLOCK, GAP = 1 << 20, b"\n" * 8
WINDOW = 3


def _n_words(line: str) -> int:
    return len(line.split()) if line.isascii() else len(_DENSE.sub(" x ", line).split())


def _cuts(data: bytes, within: bool = True) -> np.ndarray:
    """Where lines start (but the first) and the end, in bytes of UTF-8; ``within``: cut lines as well."""
    buf = np.frombuffer(data, dtype=np.uint8)
    n = len(buf)
    if not within:
        return np.unique(np.append(np.flatnonzero(buf == 10) + 1, n))
    pad = np.full(n + 16, 10, dtype=np.uint8)
    pad[8 : n + 8] = buf
    space = buf == 32
    before = pad[7 : n + 7]
    ends = (buf == 10) | (space & ((before == 46) | (before == 33) | (before == 63)))
    word = np.zeros(n, dtype=bool)
    word[1:] = space[:-1] & ~space[1:]
    if not data.isascii():
        # full stop, exclamation and question mark of Chinese and Japanese
        for mark in ("。", "！", "？"):
            x, y, z = mark.encode()
            ends |= (buf == z) & (before == y) & (pad[6 : n + 6] == x)
        word |= dense_characters(buf)
    edges = np.flatnonzero(ends) + 1
    if not len(edges) or edges[-1] < n:
        edges = np.append(edges, n)
    at = np.flatnonzero(word)
    line = np.searchsorted(edges, at, side="right")
    count = np.bincount(line, minlength=len(edges))
    inside = count[line] > LONG
    # the first bytes of a line are no place to cut
    inside &= at != np.concatenate(([0], edges))[line]
    at, line = at[inside], line[inside]
    if not len(at):
        return edges
    # the key of a place: the eight bytes on either side
    views = np.lib.stride_tricks.sliding_window_view(pad, 8)
    sides = [np.ascontiguousarray(views[x]).view(np.uint64).ravel() for x in (at, at + 8)]
    key = mix(mix(sides[0]) + sides[1])
    low = np.ones(len(at), dtype=bool)
    for k in range(1, NEAR + 1):
        apart = line[k:] != line[:-k]
        low[k:] &= apart | (key[k:] < key[:-k])
        low[:-k] &= apart | (key[:-k] <= key[k:])
    # what is longer still is cut at every LONG-th word from its start, which its own words have chosen
    first = np.flatnonzero(low | np.concatenate(([True], line[1:] != line[:-1])))
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    low |= (since > 0) & (since % LONG == 0)
    cut = np.zeros(n + 1, dtype=bool)
    cut[edges] = cut[at[low]] = True
    return np.flatnonzero(cut)


def _all_lines(texts: list[str | None], within: bool = True) -> Iterator[list[str]]:
    """The lines of each text, for groups of texts of about ``BLOCK`` bytes at once."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < BLOCK):
            group.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1])
            at += 1
        # so many ends between texts, that no key of a text has bytes of another one
        data = b"".join(x + GAP for x in group)
        cuts = _cuts(data, within)
        lengths = np.array([len(x) for x in group], dtype=np.int64)
        start = np.cumsum(lengths + len(GAP)) - lengths - len(GAP)
        lo, hi = np.searchsorted(cuts, start, side="right").tolist(), np.searchsorted(cuts, start + lengths, side="left").tolist()
        if not data.isascii():
            chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
            cuts, start = chars[cuts], chars[start]
        cuts = cuts.tolist()
        for text, a, b, s in zip(texts[at - len(group) : at], lo, hi, start.tolist()):
            if not text:
                yield []
                continue
            ends = [c - s for c in cuts[a:b]]
            yield [text[x:y] for x, y in zip([0, *ends], [*ends, len(text)])]


def lines_of(text: str) -> list[str]:
    """The lines of a text; joined they are the text again."""
    return next(_all_lines([text]))


def windows(lines: list[str], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, second hash, place, number of lines) of a text's lines: place is the window's first non-blank line."""
    lines = [s for x in lines if (s := x.strip())]
    n = len(lines) - width + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), len(lines)
    digest = xxhash.xxh3_128_digest
    each = np.frombuffer(b"".join([digest(x) for x in lines]), dtype=np.uint64).reshape(-1, 2)
    h = np.zeros((n, 2), dtype=np.uint64)
    for k in range(width):
        h = (h ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h[:, 0], (h[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.arange(n, dtype=np.int32), len(lines)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, text_key): with the key, rows that share an id but not a text are told apart."""
    return own_columns(docs, id=docs[id_col].cast("long"), text=text_col, text_key=F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))


def window_table(docs: DataFrame, id_col: str, text_col: str, width: int, within_lines: bool) -> DataFrame:
    """(id, text_key, h, g): two hashes of each window of the texts that have one, in their order."""

    def run(batches):
        for batch in pieces(batches):
            row, h, g = [], [], []
            for i, x in enumerate(_all_lines(batch.column("text").to_pylist(), within_lines)):
                h_, g_, _, _ = windows(x, width)
                if len(h_):
                    row.append(i)
                    h.append(h_)
                    g.append(g_)
            if row:
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in h]))).astype(np.int32))
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(rows), "text_key": batch.column("text_key").take(rows), "h": pa.ListArray.from_arrays(ends, pa.array(long_array(np.concatenate(h)))), "g": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(g)))})

    return keyed(docs, id_col, text_col).mapInArrow(run, "id long, text_key long, h array<long>, g array<int>")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, within_lines: bool = True) -> DataFrame:
    """(id, text_key, places): the non-blank lines of each document that later occurrences cover, if any."""
    held = written(window_table(docs, id_col, text_col, width, within_lines), "lines-windows")
    repeated = written(held.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "lines-repeated")
    table = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "h", filter_bits(repeated.count())))

    def places(batches):
        for batch in pieces(batches):
            ends = batch.column("h").offsets.to_numpy()
            h, g = (batch.column(c).flatten().to_numpy() for c in ("h", "g"))
            at = np.flatnonzero(passes(table.value, h.view(np.uint64)))
            row = np.searchsorted(ends - ends[0], at, side="right") - 1
            rows = pa.array(row)
            yield pa.RecordBatch.from_pydict({"h": h[at], "g": g[at], "id": batch.column("id").take(rows), "text_key": batch.column("text_key").take(rows), "place": (at - (ends - ends[0])[row]).astype(np.int32)})

    # rows of documents that repeat id and text stay in: they cover what the first of them covers, and making them distinct would shuffle all
    found = written(held.mapInArrow(places, "h long, g int, id long, text_key long, place int"), "lines-places")
    # nulls last: (is null, id) orders them so
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "place")
    first = found.groupBy("h", "g").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    # written, so that the join shuffles both sides and AQE can split a hot window
    met = found.join(written(first, "lines-first"), ["h", "g"])
    same_doc = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    later = met.where(~(same_doc & (F.col("place") == F.col("first.place"))))
    own = F.when(same_doc, F.sequence(F.col("first.place"), F.col("first.place") + (width - 1))).otherwise(F.array().cast("array<int>"))
    covered = F.array_except(F.sequence("place", F.col("place") + (width - 1)), own)
    return later.select("id", "text_key", F.explode(covered).alias("place")).groupBy("id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def large_runs(lines: list[str], places: list[int], min_words: int, min_chars: int) -> list[int]:
    """Of the (sorted) places those in runs that are too large to be chance; ``lines``: the non-blank ones."""
    out, at = [], 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            run = [lines[p].strip() for p in places[at:i]]
            if sum(map(len, run)) >= min_chars or sum(map(_n_words, run)) >= min_words:
                out += places[at:i]
            at = i
    return out


def cut(lines: list[str], places: set[int]) -> str:
    """The text of these lines without those non-blank lines; blank lines between two removed ones go as well."""
    out, i, gone, blanks = [], 0, False, []
    for x in lines:
        if not x.strip():
            blanks.append(x)
            continue
        now = i in places
        if not (gone and now):
            out += blanks
        blanks = []
        if not now:
            out.append(x)
        gone, i = now, i + 1
    return "".join(out + blanks)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0, min_chars: int = 0, within_lines: bool = True, **how) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and two more columns:
    ``n_removed`` and ``line_places`` (the non-blank lines removed)."""
    gone = written(removals(docs, id_col, text_col, within_lines=within_lines, **how), "lines-gone")
    key, text_key, places, n_removed, line_places = (unused(docs, x) for x in ("gone_id", "gone_key", "gone_places", "n_removed", "line_places"))
    mine = F.xxhash64(docs[id_col].cast("long"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    may = maybe(mine, bit_filter(gone.select(F.xxhash64("id", "text_key").alias("h")), "h", filter_bits(gone.count())))
    schema = docs.withColumns({n_removed: F.lit(0), line_places: F.array(F.lit(0))}).schema
    untouched = docs.where(~may).withColumns({n_removed: F.lit(0), line_places: F.array().cast("array<int>")})
    same = docs[id_col].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(text_key))
    touched = docs.where(may).join(gone.toDF(key, text_key, places).hint("shuffle_hash"), same, "left").select(*[docs[c] for c in docs.columns], places)

    def rewrite(batches):
        for batch in pieces(batches):
            texts = batch.column(text_col).to_pylist()
            lost = [x or [] for x in batch.column(places).to_pylist()]
            for i, every in enumerate(_all_lines(texts, within_lines)):
                lost[i] = large_runs([x for x in every if x.strip()], lost[i], min_words, min_chars) if lost[i] else []
                texts[i] = cut(every, set(lost[i])) if lost[i] else texts[i]
            kept = {c: batch.column(c) for c in docs_columns}
            kept[text_col] = pa.array(texts, type=batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_pydict(kept | {n_removed: pa.array([len(p) for p in lost], pa.int32()), line_places: pa.array(lost, pa.list_(pa.int32()))})

    docs_columns = docs.columns
    return untouched.unionByName(touched.mapInArrow(rewrite, schema))
