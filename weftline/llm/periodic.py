"""Periodic runs of words: seeds on the diagonals of a document, extended once each.

A run is a stretch of words with smallest period q (words q apart are the same) and at least
max(``least``, ``times`` * q) words, which no neighbouring word extends. On the diagonal of lag q it is a stretch of
matches of at least max(least, times * q) - q words. So for the lags of a class (lo, 2 lo] there is
a number k, the least such overlap, for which every run holds an occurrence of a k-gram twice, q
apart. As k is at least q, no occurrence lies between the two, or q were not the smallest period:
so only neighbouring occurrences of a k-gram are pairs, never all of them, and a pair of the class's lags
has that lag as its smallest period. Pairs are seeds: each is extended both ways to the first words that
differ; a table of the furthest word covered on each lag keeps seeds inside from being extended again.

k-grams are numbered by doubling: a 2m-gram is a pair of m-grams, and only those that occur twice are kept,
so the work beyond single words grows with what repeats. Numbers are of words, not of hashes: nothing
collides. Documents are taken in groups of bounded size and nothing is shuffled.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to the empty text; a text of any length is
taken whole; repeated rows and null ids are rows like others; an empty table gives an empty result; runs
of one start are ordered by period; of equally strong runs the first by (start, period) is the
strongest; extra columns are kept, the three results replace columns of their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words of a group of documents, in which they share calls
GROUP_WORDS = 1 << 18
RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def seed_length(lo: int, hi: int, least: int, times: int) -> int:
    """The words that a run with a period in (lo, hi] has at least to match itself one period on."""
    turn = least // times
    some = [q for q in (lo + 1, hi, turn, turn + 1) if lo < q <= hi]
    return min(max(least, times * q) - q for q in some)


def _pairs(rank: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams made of the gram at i and that at i + shift, where both occur twice: (places, starts of
    groups of equal grams), places in groups of two or more, ascending inside a group."""
    at = np.flatnonzero(rank[: max(0, len(rank) - shift)] >= 0)
    other = rank[at + shift]
    at, other = at[other >= 0], other[other >= 0]
    if len(at) < 2:
        return at[:0], at[:0]
    key = rank[at] * np.int64(len(rank)) + other
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    first = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(first) - 1
    again = np.bincount(group)[group] > 1
    return at[again], np.flatnonzero(first[again])


def _ranks(n: int, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the gram at each place, -1 where it occurs once."""
    rank = np.full(n, -1, dtype=np.int64)
    flags = np.zeros(len(places), dtype=np.int64)
    flags[starts] = 1
    rank[places] = np.cumsum(flags) - 1
    return rank


def _matches(words: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on (step 1) or before i (step -1) equal those lag words on."""
    n, size, at = len(words), 64, i
    while True:
        if step > 0:
            stop = min(at + size, n - lag)
            bad = np.flatnonzero(words[at:stop] != words[at + lag : stop + lag])
            if len(bad):
                return at + int(bad[0]) - i
            if stop == n - lag:
                return stop - i
            at = stop
        else:
            stop = max(0, at - size)
            bad = np.flatnonzero(words[stop:at] != words[stop + lag : at + lag])
            if len(bad):
                return i - (stop + int(bad[-1]) + 1)
            if stop == 0:
                return i
            at = stop
        size *= 2


def runs_of(words: np.ndarray, longest: int, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers, none of which exceeds ``longest`` words."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by these seeds")
    found, lo, hi, n = [], 0, 1, len(words)
    seen = np.bincount(words, minlength=1)
    rank, width = np.where(seen[words] > 1, words, -1).astype(np.int64), 1
    while times * (lo + 1) <= longest and (rank >= 0).any():
        k = seed_length(lo, hi, least, times)
        while 2 * width <= k:
            rank, width = _ranks(n, *_pairs(rank, width)), 2 * width
        places, starts = _pairs(rank, k - width)
        if not len(places):
            break
        lag = np.diff(places, append=0)
        ends = np.append(starts[1:], len(places)) - 1
        lag[ends] = 0
        seeds = np.flatnonzero((lag > lo) & (lag <= hi))
        at, lag = places[seeds], lag[seeds]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # of seeds that overlap on a diagonal the first is enough
        head = np.append(True, (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + k)) if len(at) else np.zeros(0, dtype=bool)
        covered: dict[int, int] = {}
        for i, q in zip(at[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, 0):
                continue
            start, end = i - _matches(words, i, q, -1), i + _matches(words, i, q, 1)
            covered[q] = end
            if end + q - start >= max(least, times * q):
                found.append((start, end + q - start, q))
        lo, hi = hi, 2 * hi
    return sorted(found, key=lambda r: (r[0], r[2]))


def _groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = text.split() if text else []  # of bytes: at space and \t to \r, nothing else
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words) + 1
    if group:
        yield group


def scan(texts: list[bytes | None], least: int, times: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    for group in _groups(texts):
        number: dict[bytes | int, int] = defaultdict(count().__next__)
        sequence: list[int] = []
        for d, words in enumerate(group):
            sequence.extend(map(number.__getitem__, words))
            sequence.append(number[d])  # a number of its own after each document: no word of bytes equals an int
        edges = np.concatenate(([0], np.cumsum([len(w) + 1 for w in group])))
        found = runs_of(np.array(sequence, dtype=np.int64), max(map(len, group)), least, times)
        owner = np.searchsorted(edges, [r[0] for r in found], side="right") - 1 if found else []
        own: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for d, (start, length, period) in zip(owner, found):
            own[int(d)].append((start - int(edges[d]), length, period))
        for d, words in enumerate(group):
            runs = own.get(d, [])
            if runs:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for start, length, period in runs:
                    change[start + period] += 1
                    change[start + length] -= 1
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                words_kept = [words[i] for i in kept.tolist()]
            else:
                words_kept = words
            yield len(words), runs, b" ".join(words_kept)


def with_runs(docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, ordered by start and period) and
    collapsed: the words that no run repeats, joined by a space. Only the text goes through Python."""

    @F.arrow_udf(f"n_words long, runs array<{RUN}>, collapsed string")
    def run(texts: pa.Array) -> pa.Array:
        n, counts, flat, kept = [], [0], [], []
        for i in range(0, len(texts), 512):
            for words, runs, collapsed in scan(texts.slice(i, 512).cast(pa.binary()).to_pylist(), least, times):
                n.append(words)
                flat.extend(runs)
                counts.append(len(flat))
                kept.append(collapsed)
        cols = np.array(flat, dtype=np.int64).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(3)], fields=list(_RUN))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    found = run(docs[text_col].cast("string"))
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    return docs.select(*[docs[c] for c in keep], F.inline(F.array(found)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared without rounding; null where there is none."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def listed(runs: Column) -> Column:
    """Runs as text: ``start,length,period`` and a line feed each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def repeat_words(text: Column, key: Column) -> Column:
    """Plants runs for tests of whole tables: of the texts whose key's CRC-32 h is a multiple of ten, word i from
    a = g % n on becomes word a + (i - a) % p, with g = h // 10 and p = 1 + (n - a) // (3 + g % 8). A null key plants nothing."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")).otherwise(text)

    # an array of one, so that the words are cut once and not for each of them
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.transform(F.array(words), planted)[0]).otherwise(text)
