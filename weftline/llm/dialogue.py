"""Repair of conversations: weighted interval parsing of their turns under a grammar of repairs.

A good conversation is ``(s?(ua)+)?`` in the initials of its roles. Turns may be kept (cost 0), given the role of
user or assistant (2) or deleted (3, and a must for blank and duplicate turns); empty turns of user or assistant
may be inserted anywhere (2). A truncated turn that stays costs 1 more.

The grammar is in Chomsky normal form. A nonterminal stands for what leads from one state of a conversation to
another (start, after system, after user, after assistant): X(p, q) -> X(p, r) X(r, q), or one edit of one turn,
or nothing with an insertion. A cell is a span of turns and holds for each nonterminal the least
(cost, audit), audit being the initials of the edits in order. Each cell is closed under insertions on both sides. Cells are
combined bottom-up by span length: turns, pairs, fours and so on up to blocks of ``BLOCK`` turns, then blocks of blocks.
As every X(p, q) splits wherever its span does, one split of a span gives all that all splits
would; so parsing takes a combination a turn, and blocks of one conversation are parsed in different tasks. Of two audits of one cell with equal
cost neither begins the other, so the lesser stays the lesser whatever precedes or follows.

Turns are ordered by number (nulls first), role, first 64 characters and MD5 of the text. A conversation's audit, a letter a
turn, is one value, so conversations beyond some ten million turns are out of reach.

Defined cases: a null role or text is one space; null conversation ids are one conversation; equal rows are as many turns,
all but the first duplicates; an empty table gives no rows; texts of any length are hashed and shuffled once, never parsed;
extra columns are not looked at; of repairs of equal cost the one with the ASCII-least audit is taken.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import own_columns, written
from weftline.operators import scan

# states: 0 start, 1 after system, 2 after user, 3 after assistant
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)], "": []}
INITIALS = ["s", "u", "a", ""]
FINE, TRUNCATED, MUST_GO = 0, 1, 2
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {pair: i for i, pair in enumerate(PAIRS)}
#: for each nonterminal the pairs of nonterminals that it may be made of
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in PAIRS]
BLOCK, FAN = 1024, 64
WHITE = " \t\n\x0b\x0c\r"
CELL = "array<struct<cost:long,audit:string>>"
_CELL = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

Cell = tuple[tuple[int, str] | None, ...]


class Repaired(NamedTuple):
    #: conv_id, place, step, edit, role, text: the turns that stay, ordered by place and step; inserted ones have edit I
    turns: DataFrame
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    conversations: DataFrame


def combine(x: Cell, y: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = x[i], y[j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best[0]:
                best = (cost, a[1] + b[1])
            elif cost == best[0]:
                audit = a[1] + b[1]
                if audit < best[1]:
                    best = (cost, audit)
        out.append(best)
    return tuple(out)


def _cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(entries.get(p) for p in PAIRS)


@lru_cache(maxsize=1)
def nothing() -> Cell:
    """The cell of an empty span: nothing, or insertions. Each round allows one more, until none helps."""
    stay = {p: (0, "") for p in PAIRS if p[0] == p[1]}
    one = _cell(stay | {p: (2, "I") for role in "ua" for p in STEPS[role]})
    now = one
    while (more := combine(now, one)) != now:
        now = more
    return now


@lru_cache(maxsize=64)
def leaf(kind: int) -> Cell:
    """The cell of one turn: three times its initial's number, plus its fault."""
    initial, fault = INITIALS[kind // 3], kind % 3
    entries: dict[tuple[int, int], tuple[int, str]] = {p: (3, "D") for p in PAIRS if p[0] == p[1]}
    if fault != MUST_GO:
        extra = int(fault == TRUNCATED)
        entries |= {p: (2 + extra, "R") for role in "ua" for p in STEPS[role]}
        entries |= {p: (extra, "K") for p in STEPS[initial]}
    return combine(combine(nothing(), _cell(entries)), nothing())


def parsed(cells: list[Cell]) -> Cell:
    """The cell of a span from those of its parts, by spans of twice the length each round."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def _as_arrow(cells: list[Cell]) -> pa.Array:
    return pa.array([[e and {"cost": e[0], "audit": e[1]} for e in c] for c in cells], _CELL)


def _parse_turns(kinds: Column) -> Column:
    @F.arrow_udf(CELL)
    def run(spans: pa.Array) -> pa.Array:
        return _as_arrow([parsed([leaf(k) for k in span]) for span in spans.to_pylist()])

    return run(kinds)


def _parse_cells(cells: Column) -> Column:
    @F.arrow_udf(CELL)
    def run(spans: pa.Array) -> pa.Array:
        return _as_arrow([parsed([tuple(e and (e["cost"], e["audit"]) for e in c) for c in span]) for span in spans.to_pylist()])

    return run(cells)


def _in_order(place: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])


def met(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Joined on ``names``, null being equal to null; of the right side the other columns are added."""
    other = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"right_{n}"))
    return left.join(other, same, how).drop(*[f"right_{n}" for n in names])


def _spelled(best: DataFrame) -> DataFrame:
    """(conv_id, place, edit, inserted, becomes): the edits of each turn, the roles inserted before it, and
    the role it gets; what is inserted at the end has the place after the last."""

    def run(batches):
        for batch in batches:
            for conv, audit in zip(batch.column("conv_id"), batch.column("audit")):
                edits = np.frombuffer(audit.as_py().encode(), dtype=np.uint8)
                made = edits != ord("D")
                # an even number of turns stay, but for a system turn in front
                odd = int(made.sum()) % 2
                roles = np.where((np.cumsum(made) - 1 - odd) % 2 == 0, "u", "a")
                own = np.flatnonzero(edits != ord("I"))
                spans = np.append(own, len(edits))
                start = np.append(0, own + 1)
                for lo in range(0, len(spans), 1 << 16):
                    at = range(lo, min(len(spans), lo + (1 << 16)))
                    last = len(own)
                    rows = {
                        "conv_id": pa.array([conv.as_py()] * len(at), batch.schema.field("conv_id").type), "place": pa.array([k + 1 for k in at], pa.int64()),
                        "edit": pa.array([chr(edits[own[k]]) if k < last else None for k in at], pa.string()), "inserted": pa.array(["".join(roles[start[k] : spans[k]]) for k in at], pa.string()),
                        "becomes": pa.array([str(roles[own[k]]) if k < last else None for k in at], pa.string()),
                    }
                    yield pa.RecordBatch.from_pydict(rows)

    kind = best.schema["conv_id"].dataType.simpleString()
    return best.select("conv_id", "audit").mapInArrow(run, f"conv_id {kind}, place long, edit string, inserted string, becomes string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None, block: int = BLOCK, fan: int = FAN) -> Repaired:
    """The repaired turns of all conversations, and what was wrong with each.

    gaps: turn numbers missing between the least and the largest; blank, duplicate (role and text seen earlier),
    truncated (does not end in ``.!?``): turns by their first fault; illegal: neighbours whose initials are not su, ua or au.
    """
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = own_columns(rows, conv_id=conv_col, turn=rows[turn_col].cast("long"), role=space(role_col), text=space(text_col))
    bare = F.rtrim("text", F.lit(WHITE))
    own = own.withColumns({"head": F.left("text", F.lit(64)), "digest": F.md5("text"), "initial": F.left("role", F.lit(1)), "blank": bare == "", "open": ~F.right(bare, F.lit(1)).isin(*".!?")})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]
    laid = scan.laid_out(own, ["conv_id"], order, parts, F.monotonically_increasing_id())
    folds = [scan.place("place"), scan.row_before("before", F.col("initial")), scan.row_before("turn_before", F.col("turn"))]
    placed = scan.over(laid.drop("text", "head"), ["conv_id"], folds)

    again = ["conv_id", "role", "digest"]
    first = placed.groupBy(*again).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = met(placed, first, again)
    c = F.col
    duplicate = ~c("blank") & F.coalesce(c("place") > c("first"), F.lit(False))
    truncated = ~c("blank") & ~duplicate & c("open")
    fault = F.when(c("blank") | duplicate, MUST_GO).when(truncated, TRUNCATED).otherwise(FINE)
    initial = F.when(c("initial") == "s", 0).when(c("initial") == "u", 1).when(c("initial") == "a", 2).otherwise(3)
    new_turn = c("turn").isNotNull() & (c("turn_before").isNull() | (c("turn_before") != c("turn")))
    bad = c("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    judged = seen.select(
        "conv_id", "turn", "place", scan.ROW, c("blank").cast("int").alias("blank"), duplicate.cast("int").alias("duplicate"), truncated.cast("int").alias("truncated"),
        F.coalesce(bad, F.lit(False)).cast("int").alias("illegal"), new_turn.cast("int").alias("new_turn"), (initial * 3 + fault).cast("int").alias("kind"),
    )
    judged = written(judged, "turns")

    spans = judged.groupBy("conv_id", F.floor((c("place") - 1) / block).alias("block")).agg(_in_order("place", "kind").alias("kinds"))
    cells = written(spans.select("conv_id", "block", _parse_turns(F.col("kinds")).alias("cell")), "cells")
    last = cells.agg(F.max("block")).first()[0] or 0
    while last > 0:
        joined = cells.groupBy("conv_id", F.floor(c("block") / fan).alias("block")).agg(_in_order("block", "cell").alias("cells"))
        cells, last = written(joined.select("conv_id", "block", _parse_cells(F.col("cells")).alias("cell")), "cells"), last // fan
    ends = F.array_min(F.array_compact(F.array(*[F.get("cell", F.lit(_AT[0, q])) for q in (0, 3)])))
    best = cells.select("conv_id", ends.alias("best")).select("conv_id", "best.cost", "best.audit")

    found = judged.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("new_turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal")]
    )
    conversations = met(found, best, ["conv_id"])

    edits = met(_spelled(best), judged.select("conv_id", "place", scan.ROW), ["conv_id", "place"]).where("coalesce(edit, 'I') <> 'D' or inserted <> ''")
    texts = laid.select(scan.ROW, c("role").alias("own_role"), c("text").alias("own_text"))
    full = edits.join(texts, scan.ROW, "left")
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    item = "array<struct<edit:string,role:string,text:string>>"
    filled = F.when(c("inserted") != "", F.transform(F.split("inserted", ""), lambda x: F.struct(F.lit("I").alias("edit"), name(x).alias("role"), F.lit("").alias("text")))).otherwise(F.array().cast(item))
    kept = F.when(c("edit").isin("K", "R"), F.array(F.struct("edit", F.when(c("edit") == "K", c("own_role")).otherwise(name(c("becomes"))).alias("role"), c("own_text").alias("text")))).otherwise(F.array().cast(item))
    turns = full.select("conv_id", "place", F.posexplode(F.concat(filled, kept)).alias("step", "item")).select("conv_id", "place", "step", "item.edit", "item.role", "item.text")
    return Repaired(turns, conversations)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's ``role:text``, joined by line feeds. A digest takes its bytes in order,
    so each conversation is read by one task, as a stream: what is held is the state of a hash."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        key, hasher = None, None
        for batch in batches:
            convs, done = batch.column("conv_id").to_pylist(), []
            for conv, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if hasher is None or conv != key:
                    if hasher is not None:
                        done.append((key, hasher.hexdigest()))
                    key, hasher = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    hasher.update(f"\n{role}:{text}".encode())
            if done:
                yield _rows(done, batch)
        if hasher is not None:
            yield _rows([(key, hasher.hexdigest())], batch)

    def _rows(done, batch):
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([k for k, _ in done], batch.schema.field("conv_id").type), "repaired_sha256": pa.array([h for _, h in done], pa.string())})

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Faults for tests of whole tables, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the turn, 1 empties it, 2 takes out
    its ``.!?``, 3 repeats it, 4 gives it to the user. A null is one space."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    w = F.col("way")
    out = own_columns(rows, conv_id="conv_id", turn="turn", role="role", text="text").withColumns({"way": way, "role": text("role"), "text": text("text")}).where("way <> 0")
    out = out.withColumns({"text": F.when(w == 1, "").when(w == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(w == 4, "user").otherwise(F.col("role"))})
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(w == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
