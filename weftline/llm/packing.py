"""Mixture-controlled packing: deficit round-robin over source queues.

All documents are tokenised, each followed by an end id, and queued by source. Window by window of
``sequence_tokens`` every queue that has tokens left is credited its target share of the window and
serves whole grains of its credit; what is left below a grain is carried to the next window as the
queue's deficit. A queue that runs dry leaves its share to the others in proportion to theirs. So
after any number of windows each queue is within one grain of its target. A grain is one token, but
for a queue whose share of a window is below ``grain`` tokens: that one waits until so many are due,
or documents of rare sources would be cut into single tokens. The windows follow one another
without a gap and are cut into sequences of ``sequence_tokens``; documents are cut where a queue's
turn or a sequence ends. Only the last sequence is short.

Targets: ``targets`` names shares of sources; the others share what is left in proportion to their
tokens to the power ``temperature`` (1: the mix of the corpus, 0: all alike).

The schedule is arithmetic, not a loop over documents: credit is a piecewise linear function of the
tokens served, with one piece for each queue that runs dry, so a document's place in its queue gives
its windows, sequences and offsets, in whatever partition it lies. Places come from per-task counts:
a task numbers the tokens of each source it reads, and sums of (task, source) totals give where it
starts, so deficits carry across partitions, no queue is brought to one task, and texts are never
shuffled. What goes to all tasks are three numbers a source; more than ``MOST_SOURCES`` are refused.

Defined cases: a null or empty text has the end id alone; a null source is a queue of its own;
repeated rows are packed as often as they come, null ids like others; very long texts are encoded
whole; windows are looked at in bounded blocks; an empty table gives no rows; ties between
queues go by source name; targets for sources that don't occur are ignored, and a target of zero or
less is a very small one; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.common import pieces, written

END_ID = 1
#: characters up to which the faster library is used; its pattern fails on runs of near a million spaces
FAST_CHARS = 200_000
MOST_SOURCES, LEAST_SHARE, BLOCK_CELLS = 1 << 20, 1e-9, 1 << 21
TOKENISED = "row long, doc_id long, source string, n long, ids binary, task int, start long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, source string"


@lru_cache(maxsize=4)
def encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """A function from text to ids. With ranks of the same vocabulary a faster library is used for
    texts of up to ``FAST_CHARS``, after it has given the tokenizer's own ids on a probe."""
    tok = Tokenizer.from_file(tokenizer_path)
    plain = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    if ranks_path is None:
        return plain
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    special = {x["content"]: x["id"] for x in json.loads(tok.to_str())["added_tokens"] if x["special"]}
    enc = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    fast = lambda text: enc.encode_to_numpy(text, allowed_special="all")
    probe = "It's 2 o'clock,\n\n  naïve Köln  \t日本 🙂!! x" + "".join(special) + " end "
    if not np.array_equal(plain(probe), fast(probe)):
        raise ValueError(f"{ranks_path} does not give the ids of {tokenizer_path}")
    return lambda text: fast(text) if len(text) <= FAST_CHARS else plain(text)


def tokenised(docs: DataFrame, encode_args: tuple, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, n, ids, task, start): ids compressed; start counts the tokens of the
    same source before the row in its task. Written to the shared folder, as task numbers only
    hold for one run."""

    def run(batches):
        encode, pack = encoder(*encode_args), zstandard.ZstdCompressor(level=1)
        task, seen, row = TaskContext.get().partitionId(), {}, 0
        for batch in pieces(batches):
            sources = batch.column("source").to_pylist()
            n, ids, starts = [], [], []
            for text, source in zip(batch.column("text").to_pylist(), sources):
                got = np.append(encode(text) if text else np.empty(0, np.uint32), END_ID).astype("<u4")
                starts.append(seen.get(source, 0))
                seen[source] = starts[-1] + len(got)
                n.append(len(got))
                # low and high halves apart: the high ones are mostly zero
                ids.append(pack.compress(got.astype("<u2").tobytes() + (got >> 16).astype("<u2").tobytes()))
            size = len(n)
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(row, row + size), pa.int64()), "doc_id": batch.column("doc_id"), "source": batch.column("source"), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()), "task": pa.array([task] * size, pa.int32()), "start": pa.array(starts, pa.int64())})
            row += size

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"))
    return written(src.mapInArrow(run, TOKENISED), "packing-ids")


def shares(tokens: list[int], names: list[str | None], targets: dict[str, float] | None, temperature: float) -> np.ndarray:
    """The target share of each source, of sum 1."""
    free = np.array([float(n) ** temperature for n in tokens])
    named = np.array([targets.get(x, -1.0) if targets and x is not None and x in targets else np.nan for x in names])
    given = ~np.isnan(named)
    left = max(0.0, 1.0 - float(np.maximum(named[given], 0).sum()))
    share = np.where(given, named, left * free / max(float(free[~given].sum()), LEAST_SHARE))
    share = np.maximum(share, LEAST_SHARE)
    return share / share.sum()


class Schedule:
    """What each queue has served after so many windows, and where a queue's tokens come to lie."""

    def __init__(self, tokens: np.ndarray, share: np.ndarray, sequence_tokens: int, grain: int):
        self.tokens, self.share, self.size, self.total = tokens, share, sequence_tokens, int(tokens.sum())
        self.grain = np.where(share * sequence_tokens >= grain, 1, grain).astype(np.float64)
        # credit at which a queue runs dry, and the tokens that all have served by then
        self.dry = tokens / share
        order = np.argsort(self.dry, kind="stable")
        self.credits = np.concatenate(([0.0], self.dry[order]))
        left = np.maximum(1.0 - np.concatenate(([0.0], np.cumsum(share[order])[:-1])), 0.0)
        self.passed = np.concatenate(([0.0], np.cumsum(left * np.diff(self.credits))))

    def served(self, windows: np.ndarray) -> np.ndarray:
        """(windows, queues): tokens served before each of the windows."""
        at = windows * self.size
        credit = np.where(at >= self.total, np.inf, np.interp(at, self.passed, self.credits))[:, None]
        # a hair more, as a credit of whole grains may be rounded down
        whole = np.floor(np.where(np.isinf(credit), 0.0, credit) * self.share / self.grain + 1e-6) * self.grain
        return np.where(credit >= self.dry, self.tokens, np.minimum(whole.astype(np.int64), self.tokens))

    def served_of(self, windows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The same of one queue for each of the windows."""
        at = windows * self.size
        credit = np.where(at >= self.total, np.inf, np.interp(at, self.passed, self.credits))
        whole = np.floor(np.where(np.isinf(credit), 0.0, credit) * self.share[q] / self.grain[q] + 1e-6) * self.grain[q]
        return np.where(credit >= self.dry[q], self.tokens[q], np.minimum(whole.astype(np.int64), self.tokens[q]))

    def window_of(self, q: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The windows in which tokens of queues are served."""
        due = np.minimum(np.ceil((token + 1) / self.grain[q]) * self.grain[q] / self.share[q], self.dry[q])
        k = np.maximum(0, np.interp(due, self.credits, self.passed) // self.size - 2).astype(np.int64)
        late = np.arange(len(k))
        while len(late := late[self.served_of(k[late] + 1, q[late]) <= token[late]]):
            k[late] += 1
        early = np.flatnonzero(k)
        while len(early := early[(k[early] > 0) & (self.served_of(k[early], q[early]) > token[early])]):
            k[early] -= 1
        return k

    def visits(self, a: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, window) for the windows that serve tokens of each document: those from its first
        to its last, or those of its grains where these are fewer, as a rare source skips windows."""
        first, last, grain = self.window_of(q, a), self.window_of(q, a + n - 1), self.grain[q].astype(np.int64)
        span, grains = last - first + 1, (a + n - 1) // grain - a // grain + 1
        count = np.minimum(span, grains)
        doc = np.repeat(np.arange(len(n)), count)
        j = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        k, skips = first[doc] + j, (grains < span)[doc]
        d = doc[skips]
        k[skips] = self.window_of(q[d], np.maximum(a[d], (a[d] // grain[d] + j[skips]) * grain[d]))
        new = np.append(True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]))[: len(doc)]
        return doc[new], k[new]

    def layouts(self, a: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces (document, start, length, sequence, offset, window) of documents, the i-th at tokens
        a[i]..a[i]+n[i]-1 of queue q[i]; those of a document follow one another in order. Each window
        is looked at once for all of them."""
        doc, k = self.visits(a, n, q)
        start, end, where = (np.empty(len(doc), np.int64) for _ in range(3))
        order, step = np.argsort(k, kind="stable"), max(1, BLOCK_CELLS // (2 * len(self.tokens)))
        windows, begins = np.unique(k[order], return_index=True)
        begins = np.append(begins, len(doc))
        for lo in range(0, len(windows), step):
            some = windows[lo : lo + step]
            at = np.union1d(some, some + 1)
            done = self.served(at)
            upto = np.cumsum(done, axis=1)
            i = order[begins[lo] : begins[lo + len(some)]]
            x, qs = np.searchsorted(at, k[i]), q[doc[i]]
            start[i], end[i] = np.maximum(done[x, qs], a[doc[i]]), np.minimum(done[x + 1, qs], (a + n)[doc[i]])
            # all before the window, and what the queues before this one are served in it
            where[i] = upto[x, -1] + (upto[x + 1, qs] - done[x + 1, qs]) - upto[x, qs] + start[i]
        kept = end > start
        doc, k, start, where, length = doc[kept], k[kept], start[kept], where[kept], (end - start)[kept]
        # neighbours joined, then cut at the ends of sequences
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (where[1:] != (where + length)[:-1]))[: len(doc)])
        length = np.add.reduceat(length, head) if len(head) else length
        doc, k, start, where = doc[head], k[head], start[head], where[head]
        seq = where // self.size
        count = (where + length - 1) // self.size - seq + 1
        run = np.repeat(np.arange(len(doc)), count)
        seq = seq[run] + np.arange(len(run)) - (np.cumsum(count) - count)[run]
        begin = np.maximum(where[run], seq * self.size)
        size = np.minimum((where + length)[run], (seq + 1) * self.size) - begin
        return doc[run], start[run] - a[doc[run]] + begin - where[run], size, seq, begin - seq * self.size, k[run]

    def layout(self, a: int, n: int, q: int) -> list[tuple[int, int, int, int, int]]:
        """Pieces (start, length, sequence, offset, window) of one document."""
        return list(zip(*(x.tolist() for x in self.layouts(np.array([a]), np.array([n]), np.array([q]))[1:])))


def pack(docs: DataFrame, encode_args: tuple, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sequence_tokens: int = 2048, targets: dict[str, float] | None = None, temperature: float = 0.5, grain: int = 32) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, source).

    ``encode_args``: tokenizer file and, for speed, ranks file and pattern (see ``encoder``).
    """
    ids = tokenised(docs, encode_args, id_col, text_col, source_col)
    # a null source is not an empty one
    queue = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    parts = written(ids.groupBy("task", queue.alias("queue")).agg(F.sum("n").alias("tokens")), "packing-parts")
    own = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).toPandas().sort_values("queue")
    if len(own) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: put them into groups first")
    tokens, names = own["tokens"].to_numpy(np.int64), {x: i for i, x in enumerate(own["queue"])}
    share = shares(tokens.tolist(), [x[1:] if x else None for x in names], targets, temperature)
    shared = docs.sparkSession.sparkContext.broadcast((names, Schedule(tokens, share, sequence_tokens, grain) if len(tokens) else None))
    # where each source of each task starts in its queue
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("task", "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "packing-bases")
    placed = ids.withColumn("queue", queue).join(bases, ["task", "queue"]).select("doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("start")).alias("at"))

    def run(batches):
        unpack, (names, schedule) = zstandard.ZstdDecompressor(), shared.value
        for batch in pieces(batches):
            n, at = (batch.column(c).to_numpy() for c in ("n", "at"))
            q = np.array([names[x] for x in batch.column("queue").to_pylist()], dtype=np.int64)
            row, start, length, *rest = schedule.layouts(at, n, q)
            # pieces of a document follow one another, so one pass over the texts meets them all
            crcs, ends = [], np.searchsorted(row, np.arange(len(n)), side="right").tolist()
            spans = list(zip((4 * start).tolist(), (4 * (start + length)).tolist()))
            for size, packed, first, last in zip(n.tolist(), batch.column("ids").to_pylist(), [0, *ends], ends):
                halves = np.frombuffer(unpack.decompress(packed), dtype="<u2").astype("<u4")
                data = memoryview((halves[:size] | (halves[size:] << np.uint32(16))).astype("<u4").tobytes())
                crcs += [zlib.crc32(data[s:e]) for s, e in spans[first:last]]
            made = {c: pa.array(x, pa.int64()) for c, x in zip(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"), (start, length, crcs, n[row], *rest))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), **made, "source": batch.column("source").take(pa.array(row))})

    return placed.mapInArrow(run, PIECES)
