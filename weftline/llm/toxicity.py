"""Toxicity by maximum-scoring segments.

Token scores: log-odds of a token in toxic against clean documents, with an informative
Dirichlet prior in proportion to its pooled frequency (Monroe, Colaresi, Quinn: Fightin' Words,
2008). Whole words and beginnings of words (the first 4, 5, .. bytes, lower-cased) compete as tokens,
so that inflections can share one; in scripts without spaces every character starts a word, so that
beginnings are runs of characters: those whose log-odds are significantly above zero are listed, each
word counts as the listed beginning with the largest z, and the log-odds are estimated again on
these. All other words form one class, whose log-odds are slightly negative.

Passages: all maximal-scoring segments of a document's token scores, in one linear scan (Ruzzo
and Tompa, 1999). Since only listed tokens score above zero, the scan runs over those, with the
drift of the tokens between them added in one step.

Calibration: segment scores follow an extreme-value law (Karlin and Altschul, 1990): among n
clean tokens, ``K n exp(-lambda S)`` segments of score S are expected; lambda solves
sum p exp(lambda s) = 1 under the clean frequencies and K is fitted to the clean training
documents. A segment is significant if fewer than ``max_expected`` such are expected. Over the
r best segments the normalised scores add up; the least chance of such a sum by Karlin and
Altschul's sum statistic (1993) is the evidence of the document, which a logistic curve, fitted
on the training rows, turns into a probability.

Only ``labels.toxic`` and texts are learned from, on a sample of about ``max_per_class``
labelled rows of each class (ids whose hash is below a share); every document is scored, whole.

Defined cases: null and empty texts have no tokens, no passages and the score of no evidence;
documents with several labels count as toxic if any label says so; null labels and labels
without a document are left out; without toxic or clean training rows every score is the
training share of toxic rows (0 without rows); repeated rows are scored alike; ties between listed
beginnings of a word go to the shortest; null ids are scored like any other; very long texts are
hashed in blocks, whole; an empty table gives no rows; extra columns are not looked at, and
``drop_toxic`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import hashed_texts, long_array, own_columns, pieces, written

WHOLE = 1 << 40
PREFIXES = (4, 5, 6, 7, 9, 12, WHOLE)


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted hashes of the listed tokens
    scores: np.ndarray
    drift: float  # score of any other token
    scale: float  # lambda
    k: float
    max_expected: float
    intercept: float
    slope: float
    z: np.ndarray  # significance: of several listed beginnings of a word the largest holds
    prefixes: tuple[int, ...] = PREFIXES


# ---------------------------------------------------------------- segments


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) of a sequence whose tokens score
    ``scores`` at ``places`` (ascending, scores above zero) and ``drift`` (below zero) elsewhere."""
    total, last = 0.0, -1
    held: list[list] = []  # [sum before, sum through, first, last + 1, index of the nearest earlier one with a smaller sum before]
    for at, s in zip(places, scores):
        total += drift * (at - last - 1)
        item = [total, total + s, at, at + 1, -1]
        total, last = total + s, at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= item[0]:
                j = held[j][4]
            if j < 0 or held[j][1] >= item[1]:
                item[4] = j
                held.append(item)
                break
            # an earlier start with a lower sum before and a lower end: one longer segment
            item = [held[j][0], item[1], held[j][2], item[3], -1]
            del held[j:]
    return [(a, b, through - before) for before, through, a, b, _ in held]


def evidence(n: int, segments: list[tuple[int, int, float]], scale: float, k: float, max_expected: float) -> tuple[float, list[tuple[int, int, float]]]:
    """(-log of the least chance over the r best, the significant segments)."""
    if not segments:
        return 0.0, []
    base = math.log(max(k * n, 1e-12))
    normal = sorted(((scale * s - base, a, b, s) for a, b, s in segments), reverse=True)
    good = [(a, b, s) for x, a, b, s in normal if math.exp(min(-x, 50.0)) <= max_expected]
    best, run = 0.0, 0.0
    for r, (x, *_) in enumerate(normal[: max(1, len(good))], 1):
        run += x
        if run <= 0:
            continue
        # log P of a sum of r normalised scores, with a factor 2 ** r for having tried each r
        log_p = -run + (r - 1) * math.log(max(run, 1.0)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = max(best, -log_p)
    return best, sorted(good)


# ---------------------------------------------------------------- training


def held_out(id_col: str | Column = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(folds)) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_per_class: int) -> DataFrame:
    """(text, y) of about ``max_per_class`` labelled training documents of each class."""
    known = own_columns(labels, label_id=labels[id_col].cast("long"), y=labels[label_col].cast("int")).where("label_id is not null and y is not null").where(~held_out("label_id"))
    known = written(known.groupBy("label_id").agg(F.max("y").alias("y")).where("y in (0, 1)"), "toxicity-labels")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 31
    below = {y: min(steps, steps * max_per_class // n) for y, n in sizes.items()}
    limit = F.when(F.col("y") == 1, below.get(1, 0)).otherwise(below.get(0, 0))
    some = known.where(F.pmod(F.xxhash64("label_id"), F.lit(steps)) < limit)
    # about 2 * max_per_class ids
    return own_columns(docs, doc_id=docs[id_col].cast("long"), text=text_col).join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("text", "y")


def _token_counts(train: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """(token, t, c): occurrences of each beginning in toxic and clean rows."""

    def run(batches):
        for batch in pieces(batches):
            y = np.array(batch.column("y").to_pylist(), dtype=np.int64)
            for lo, hi, bounds, hashes, *_ in hashed_texts(batch.column("text").to_pylist(), prefixes, dense=True):
                toxic = np.tile(np.repeat(y[lo:hi], np.diff(bounds)), len(prefixes))
                u, inverse, n = np.unique(hashes.T.ravel(), return_inverse=True, return_counts=True)
                t = np.bincount(inverse, weights=toxic, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"token": long_array(u), "t": t, "c": n - t})

    return train.mapInArrow(run, "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def resolve(tokens: np.ndarray, z: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each word the number of its listed beginning with the largest z, or -1."""
    best = np.full(len(hashes), -1, dtype=np.int64)
    if not len(tokens):
        return best
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
    for level in range(hashes.shape[1]):
        h = hashes[:, level]
        some = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(tokens, h[some]), len(tokens) - 1)
        hit = tokens[at] == h[some]
        some, at = some[hit], at[hit]
        better = (best[some] < 0) | (z[at] > z[best[some]])
        best[some[better]] = at[better]
    return best


def _resolved_counts(train: DataFrame, tokens: np.ndarray, z: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in toxic and in clean rows of each listed token and, last, of all other words."""
    shared = train.sparkSession.sparkContext.broadcast((tokens, z))

    def run(batches):
        tokens, z = shared.value
        for batch in pieces(batches):
            y = np.array(batch.column("y").to_pylist(), dtype=np.int64)
            for lo, hi, bounds, hashes, *_ in hashed_texts(batch.column("text").to_pylist(), prefixes, dense=True):
                at = resolve(tokens, z, hashes)
                at[at < 0] = len(tokens)
                toxic = np.repeat(y[lo:hi], np.diff(bounds))
                n = np.bincount(at, minlength=len(tokens) + 1)
                t = np.bincount(at, weights=toxic, minlength=len(tokens) + 1).astype(np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"i": some, "t": t[some], "c": (n - t)[some]})

    out = np.zeros((2, len(tokens) + 1))
    got = train.mapInArrow(run, "i long, t long, c long").groupBy("i").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toPandas()
    out[0, got["i"].to_numpy(np.int64)], out[1, got["i"].to_numpy(np.int64)] = got["t"], got["c"]
    return out[0], out[1]


def _solve_scale(p: np.ndarray, s: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1."""
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 700.0)))) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method; n: weights."""
    w = np.zeros(2)
    z = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (n * (y - p)) - ridge * w
        h = (z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _terms(counts: DataFrame, totals: tuple[int, int], prior: float, min_z: float, min_score: float) -> DataFrame:
    """(token, z) of the tokens whose log-odds are significantly above zero."""
    n_t, n_c = totals
    alpha = F.greatest((F.col("t") + F.col("c")) * (prior / (n_t + n_c)), F.lit(1e-9))
    yt, yc = F.col("t") + alpha, F.col("c") + alpha
    score = F.log(yt / (n_t + prior - yt)) - F.log(yc / (n_c + prior - yc))
    scored = counts.select("token", "t", score.alias("score"), (score / F.sqrt(1 / yt + 1 / yc)).alias("z"))
    return scored.where((F.col("z") >= min_z) & (F.col("score") >= min_score) & (F.col("t") >= 3)).select("token", "z")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 20000, prior: float = 5000.0, min_z: float = 3.0, min_score: float = 2.5, max_expected: float = 0.05, prefixes: tuple[int, ...] = PREFIXES) -> Model:
    rows = written(training_rows(docs, labels, id_col, text_col, label_col, max_per_class), "toxicity-train")
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = -30.0 if not shares.get(1) else 30.0 if not shares.get(0) else math.log(shares[1] / shares[0])
    none = Model(np.empty(0, np.uint64), np.empty(0), -1.0, 1.0, 1.0, max_expected, share, 0.0, np.empty(0), prefixes)
    if not shares.get(0) or not shares.get(1):
        return none
    counts = written(_token_counts(rows, prefixes), "toxicity-counts")
    totals = counts.agg(F.sum("t"), F.sum("c")).first()
    if not totals[0] or not totals[1]:
        return none
    # each beginning of a word was counted: tokens a level
    per_level = (totals[0] // len(prefixes), totals[1] // len(prefixes))
    # bounded by the sample: a listed token occurs in it three times at least
    top = _terms(counts, per_level, prior, min_z, min_score).toPandas()
    if not len(top):
        return none
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens, z = tokens[order], top["z"].to_numpy(float)[order]
    t, c = _resolved_counts(rows, tokens, z, prefixes)
    alpha = np.maximum((t + c) * prior / (t.sum() + c.sum()), 1e-9)
    pt, pc = ((x + alpha) / (x.sum() + alpha.sum()) for x in (t, c))
    odds = np.log(pt) - np.log1p(-pt) - np.log(pc) + np.log1p(-pc)
    used = np.flatnonzero((odds[:-1] > 0) & (t[:-1] > 0))
    if not len(used):
        return none
    tokens, z, scores = tokens[used], z[used], odds[used]
    mass_t, mass_c = float(pt[used].sum()), float(pc[used].sum())
    drift = min(-1e-4, math.log((1 - mass_t) / (1 - mass_c)))
    scale = _solve_scale(np.append(pc[used], 1 - mass_c), np.append(scores, drift))
    first = Model(tokens, scores, drift, scale, 1.0, max_expected, 0.0, 1.0, z, prefixes)
    # K: as many segments of clean training documents above a floor as the law expects
    floor = 2.0
    stats = _segment_stats(rows, first, floor)
    clean = stats.where("y = 0").agg(F.sum("above"), F.sum("tokens")).first()
    k = (clean[0] + 1) / max((clean[1] or 0) * math.exp(-scale * floor), 1.0)
    second = Model(tokens, scores, drift, scale, k, max_expected, 0.0, 1.0, z, prefixes)
    # at most 2 * max_per_class rows, grouped by evidence
    seen = _segment_stats(rows, second, floor).groupBy("y", F.round("evidence", 2).alias("e")).agg(F.count("*").alias("n")).toPandas()
    a, b = _logistic(np.log1p(seen["e"].to_numpy(float)), seen["y"].to_numpy(float), seen["n"].to_numpy(float))
    return Model(tokens, scores, drift, scale, k, max_expected, a, b, z, prefixes)


def _scan(m: Model, texts: list[str | None]):
    """(tokens, segments) of each text."""
    for lo, hi, bounds, hashes, *_ in hashed_texts(texts, m.prefixes, dense=True):
        at = resolve(m.tokens, m.z, hashes)
        hits = np.flatnonzero(at >= 0)
        score = m.scores[at[hits]]
        cuts = np.searchsorted(hits, bounds)
        for i in range(hi - lo):
            a, b = cuts[i], cuts[i + 1]
            segments = maximal_segments((hits[a:b] - bounds[i]).tolist(), score[a:b].tolist(), m.drift) if b > a else []
            yield int(bounds[i + 1] - bounds[i]), segments


def _segment_stats(rows: DataFrame, m: Model, floor: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            n, above, ev = [], [], []
            for tokens, segments in _scan(m, batch.column("text").to_pylist()):
                n.append(tokens)
                above.append(sum(s >= floor for *_, s in segments))
                ev.append(evidence(tokens, segments, m.scale, m.k, m.max_expected)[0])
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "tokens": pa.array(n, pa.int64()), "above": pa.array(above, pa.int64()), "evidence": pa.array(ev, pa.float64())})

    return rows.mapInArrow(run, "y int, tokens long, above long, evidence double")


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence, n_tokens, passages): passages are the significant segments, as
    token numbers (first, last + 1) with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    kind = "array<struct<first:int,last:int,score:double>>"

    def run(batches):
        m = shared.value
        passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in pieces(batches):
            n, ev, found = [], [], []
            for tokens, segments in _scan(m, batch.column("text").to_pylist()):
                e, good = evidence(tokens, segments, m.scale, m.k, m.max_expected)
                n.append(tokens)
                ev.append(e)
                found.append([{"first": a, "last": b, "score": s} for a, b, s in good])
            e = np.array(ev, dtype=float)
            p = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(e), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "evidence": e, "n_tokens": pa.array(n, pa.int64()), "passages": pa.array(found, passage)})

    src = own_columns(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    return src.mapInArrow(run, f"doc_id long, score double, evidence double, n_tokens long, passages {kind}")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, n_tokens, passages) of every row."""
    out = score(docs, train(docs, labels, id_col, **how), id_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "n_tokens", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those that score at or above ``threshold``; decided row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **how))

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            ev = np.array([evidence(n, s, m.scale, m.k, m.max_expected)[0] for n, s in _scan(m, batch.column(text_col).to_pylist())], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(ev), -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
