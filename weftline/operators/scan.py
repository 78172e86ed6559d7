"""Running values by key that don't bring a key to one task: a scan in two passes.

Rows are range-partitioned by (keys, order), so that a key with a third of all rows lies in many parts and
many small keys share one. Each part is folded by itself; what the parts of a key before it came to is
carried in. As ranges are ordered by key first, only the keys at the edges of parts lie in more than one, so
at most two rows a part are carried, however many keys there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.operators.store import cut

PART, ROW, TIE = "__part", "__row", "__tie"


@dataclass
class Fold:
    """A running value: over a window, of a whole part, over the parts before, and joined with what is carried."""

    name: str
    inside: Callable[[WindowSpec], Column]
    whole: Column
    before: Callable[[Column, WindowSpec], Column]
    join: Callable[[Column, Column], Column]


def total(name: str, value: Column) -> Fold:
    """The sum so far; null values add nothing, and a sum of nulls alone is null."""
    both = lambda carried, own: F.coalesce(carried + own, carried, own)
    return Fold(name, lambda w: F.sum(value).over(w), F.sum(value), lambda c, w: F.sum(c).over(w), both)


def place(name: str) -> Fold:
    """The number of the row among its key's, from 1."""
    one = F.lit(1).cast("long")
    return Fold(name, lambda w: F.sum(one).over(w), F.sum(one), lambda c, w: F.sum(c).over(w), lambda carried, own: own + F.coalesce(carried, F.lit(0)))


def largest(name: str, value: Column) -> Fold:
    """The largest value so far."""
    return Fold(name, lambda w: F.max(value).over(w), F.max(value), lambda c, w: F.max(c).over(w), lambda carried, own: F.greatest(carried, own))


def last_known(name: str, value: Column) -> Fold:
    """The last value so far that is not null."""
    known = F.max_by(value, F.when(value.isNotNull(), F.col(ROW)))
    return Fold(name, lambda w: F.last(value, ignorenulls=True).over(w), known, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda carried, own: F.coalesce(own, carried))


def row_before(name: str, value: Column) -> Fold:
    """The value, null or not, in the row before this one; null for a key's first row."""
    held = F.struct(value.alias("v"))
    return Fold(name, lambda w: F.last(held).over(w.rowsBetween(-1, -1)), F.max_by(held, F.col(ROW)), lambda c, w: F.last(c).over(w), lambda carried, own: F.coalesce(own, carried)["v"])


def laid_out(rows: DataFrame, keys: list[str], order: list[Column], parts: int | None = None, tie: Column | None = None) -> DataFrame:
    """``rows`` in the shared folder with their part, a range of (keys, order, tie) about as large as the others, and
    with a number that ascends in that order. Ties follow ``tie``, or else a hash of all columns."""
    tied = rows.withColumn(TIE, F.xxhash64(*[F.col(c) for c in rows.columns]) if tie is None else tie)
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col(TIE)]
    ranged = tied.repartitionByRange(parts, *by) if parts else tied.repartitionByRange(*by)
    # the number of a row holds that of its partition
    return cut(ranged.sortWithinPartitions(*by).withColumn(ROW, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(ROW, 33)).drop(TIE))


def met(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Joined on ``names``, null being equal to null; of the right side the other columns are added."""
    other = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__right_{n}"))
    return left.join(other, same, how).drop(*[f"__right_{n}" for n in names])


def _crossing(laid: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in several parts: at most one for each part's end."""
    edges = laid.groupBy(PART).agg(F.min_by(F.struct(*keys), ROW).alias("first"), F.max_by(F.struct(*keys), ROW).alias("last"))
    ends, starts = edges.select("last.*", F.col(PART).alias("__a")), edges.select("first.*", F.col(PART).alias("__b"))
    return met(ends, F.broadcast(starts), keys, "inner").where(F.col("__a") < F.col("__b")).select(*keys).distinct()


def running(rows: DataFrame, keys: list[str], order: list[Column], folds: list[Fold], parts: int | None = None, tie: Column | None = None) -> DataFrame:
    """``rows`` with a column for each fold: its value over the rows of the same keys up to and with this one.

    ``order``: sort columns; rows that tie follow a hash of all their columns, or ``tie``. Null keys are a key.
    ``parts``: how many ranges; by default as many as the session shuffles into, fewer where data are small.
    """
    return over(laid_out(rows, keys, order, parts, tie), keys, folds).select(*rows.columns, *[f.name for f in folds])


def over(laid: DataFrame, keys: list[str], folds: list[Fold]) -> DataFrame:
    """``laid``, or some columns of what ``laid_out`` gave, with a column for each fold."""
    inside = Window.partitionBy(*keys, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    own = laid.withColumns({f.name: f.inside(inside) for f in folds})
    if not laid.agg(F.max(PART)).first()[0]:
        nothing = F.lit(None)
        return own.select(*laid.columns, *[f.join(nothing, F.col(f.name)).alias(f.name) for f in folds])
    crossing = _crossing(laid, keys)
    # at most two rows a part from here on
    wholes = met(laid, F.broadcast(crossing), keys, "left_semi").groupBy(*keys, PART).agg(*[f.whole.alias(f.name) for f in folds])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = wholes.select(*keys, PART, *[f.before(F.col(f.name), before).alias(f"__{f.name}") for f in folds])
    both = met(own, F.broadcast(carried), [*keys, PART])
    return both.select(*laid.columns, *[f.join(F.col(f"__{f.name}"), F.col(f.name)).alias(f.name) for f in folds])


def group_totals(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates of their key's group, which is summed in parts first and then joined: a
    key's rows stay where they are."""
    return met(rows, rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)
