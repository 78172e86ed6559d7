"""Many patterns over values in one pass.

A pattern's required literals, one of which every match must hold, are searched for all patterns at once by an
Aho-Corasick automaton; a regular expression is only tried on texts in which one of its literals stands, or which have none to ask
for.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: patterns are a catalog that all tasks hold
MOST_PATTERNS = 100_000
FLAGS = re.IGNORECASE | re.MULTILINE


def literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds one; None where there is nothing to ask for."""
    try:
        tree = parser.parse(pattern, FLAGS)
    except (re.error, OverflowError):
        return None

    def needed(seq: Iterable) -> list[str] | None:
        """The best of a sequence's parts: all of them must match, so the literals of any one will do."""
        best: list[str] | None = None
        run = ""

        def offer(found: list[str] | None):
            nonlocal best
            if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, arg in seq:
            # letters with several lower cases or foldings are no literals
            if op is sre.LITERAL and chr(arg).isascii():
                run += chr(arg).lower()
                continue
            if run:
                offer([run])
                run = ""
            if op is sre.SUBPATTERN:
                offer(needed(arg[3]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                offer(needed(arg[2]))
            elif op is sre.ATOMIC_GROUP:
                offer(needed(arg))
            elif op is sre.BRANCH:
                ways = [needed(x) for x in arg[1]]
                offer([x for w in ways for x in w] if all(ways) else None)
        if run:
            offer([run])
        return best

    # k and s also match signs beyond ASCII, which no lower-case text shows
    found = needed(tree)
    return None if found is None or any(len(x) < 2 or "k" in x or "s" in x for x in found) else sorted(set(found))


class Patterns:
    """Numbered regular expressions, those that match a text found in one pass."""

    def __init__(self, patterns: dict[int, str]):
        import ahocorasick  # on executors; the library loads without it

        self.compiled, self.always = {}, []
        words = defaultdict(list)
        for i, p in patterns.items():
            try:
                self.compiled[i] = re.compile(p, FLAGS)
            except re.error:
                continue
            need = literals(p)
            if need is None:
                self.always.append(i)
            for x in need or ():
                words[x].append(i)
        self.automaton = ahocorasick.Automaton()
        for x, ids in words.items():
            self.automaton.add_word(x, tuple(ids))
        if words:
            self.automaton.make_automaton()
        self.any = bool(words)

    def candidates(self, text: str) -> set[int]:
        out = set(self.always)
        if self.any:
            for _, ids in self.automaton.iter(text.lower()):
                out.update(ids)
        return out

    def matching(self, text: str, among: set[int] | None = None) -> list[int]:
        return sorted(i for i in self.candidates(text) if (among is None or i in among) and self.compiled[i].search(text))


def numbered(rules: DataFrame, *columns: str) -> list[tuple]:
    rows = rules.select(*columns).distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return sorted(map(tuple, rows), key=repr)


def value_hits(values: DataFrame, rules: DataFrame, value: str = "value", group: str = "source") -> DataFrame:
    """``values`` once for each rule (rule, group, pattern) of their group that matches, with the column ``rule``: as a join on
    ``rlike``, with one pass over each value. Rules are of bounded number."""
    rows = [r for r in numbered(rules, "rule", group, "pattern") if None not in r]
    shared = values.sparkSession.sparkContext.broadcast(rows)

    def found(text: Column, of: Column) -> Column:
        @F.arrow_udf("array<string>")
        def run(texts: pa.Array, groups: pa.Array) -> pa.Array:
            by = defaultdict(dict)
            for i, (_, g, p) in enumerate(shared.value):
                by[g][i] = p
            patterns = {g: Patterns(p) for g, p in by.items()}
            return pa.array([[] if t is None or g not in patterns else [shared.value[i][0] for i in patterns[g].matching(t)] for t, g in zip(texts.to_pylist(), groups.to_pylist())], pa.list_(pa.string()))

        return run(text, of)

    return values.withColumn("rule", F.explode(found(F.col(value), F.col(group))))
