"""Many path globs and patterns in one pass over files: globs are grouped by the end that they demand, so a path is tried
against few of them; patterns as in ``operators.patterns``."""

from __future__ import annotations

import fnmatch
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.patterns import Patterns, numbered

#: fixed values: what is never searched
SKIPPED = (".min.js", ".bundle.js", ".map", ".lock")
MOST_FILE_BYTES = 524_288


class Globs:
    """Numbered path globs by the literal end that they demand."""

    def __init__(self, globs: Iterable[tuple[int, str]]):
        self.by_end: dict[str, list[tuple[int, re.Pattern]]] = defaultdict(list)
        for i, g in globs:
            low = g.lower()
            end = re.search(r"[^*?\[\]/]*$", low).group()
            ways = [low, low[3:]] if low.startswith("**/") else [low]
            self.by_end[end].append((i, re.compile("|".join(fnmatch.translate(w) for w in ways))))
        self.lengths = sorted({len(e) for e in self.by_end})

    def matching(self, path: str) -> set[int]:
        low, out = path.lower(), set()
        for n in self.lengths:
            for i, regex in self.by_end.get(low[len(low) - n :] if n else "", ()) if n <= len(low) else ():
                if i not in out and regex.match(low):
                    out.add(i)
        return out


def file_hits(spark: SparkSession, root: str, probes: DataFrame, most: int = 5) -> DataFrame:
    """(probe, path): for each probe the files whose path, relative to ``root``, matches one of its globs and whose text its pattern, at
    most ``most``, the first by path. ``probes``: probe, glob, pattern; a probe may have several rows. Each file is read
    once. Minified, bundled, map, lock and env files, empty ones, those over half a megabyte and those with a NUL are not searched."""
    rows = [r for r in numbered(probes, "probe", "glob", "pattern") if None not in r]
    shared = spark.sparkContext.broadcast(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    keep = (F.col("length") > 0) & (F.col("length") <= MOST_FILE_BYTES) & ~name.startswith(".env")
    for end in SKIPPED:
        keep = keep & ~F.lower("path").endswith(end)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    near = files.where(keep).select("path", F.when(F.startswith(plain, F.concat(base, F.lit("/"))), F.substr(plain, F.length(base) + 2)).otherwise(name).alias("relative"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = Globs((i, g) for i, (_, g, _) in enumerate(shared.value))
        patterns = Patterns({i: p for i, (_, _, p) in enumerate(shared.value)})
        for batch in batches:
            found = []
            for path, relative, content in zip(*(batch.column(c).to_pylist() for c in ("path", "relative", "content"))):
                among = globs.matching(relative)
                if among and b"\0" not in content:
                    found += [(shared.value[i][0], path) for i in patterns.matching(content.decode("utf-8", "replace"), among)]
            yield pa.RecordBatch.from_pydict({"probe": pa.array([p for p, _ in found], pa.string()), "path": pa.array([p for _, p in found], pa.string())})

    hits = near.mapInArrow(run, "probe string, path string").distinct()
    # the first by path, in each part and then in all: no probe's hits meet in one task
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    few = hits.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("r", first(["probe", "part"])).where(F.col("r") <= most)
    return few.withColumn("r", first(["probe"])).where(F.col("r") <= most).select("probe", "path")
