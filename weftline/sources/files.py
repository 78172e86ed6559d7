"""Sources: documents and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import history, rules
from weftline.sources.ranges import tail_sample  # noqa: F401  beside the other sources

PLAN = """plan_id string, capacities map<string,double>, atoms array<struct<id:string, operation:struct<kind:string, argv:array<string>, cwd:string>, profile:string, side_effect:boolean,
    depends_on:array<struct<atom:string, kind:string>>, accesses:array<struct<resource:string, mode:string>>, effects:array<struct<domain:string, key:string, mode:string>>, claims:array<struct<resource:string, units:double>>,
    cost:struct<duration_seconds:double, startup_seconds:double, memory_mb:double>,
    semantics:struct<idempotent:boolean, retryable:boolean, deterministic:boolean, cacheable:boolean, commutative:boolean, cancel_safe:boolean, splittable:boolean, reorderable:string>,
    assurance:struct<parse:string, control:string, effects:string, codegen:string, rank:double, blockers:array<string>>, batch:struct<key:string, strategy:string>>>, snapshots array<struct<path:string, sha256:string, size_bytes:bigint>>, _corrupt_record string"""
WORKER = "event string, scenario string, elapsed_seconds double, iterations long, work_units long"
TRACE = "type string, payload struct<type:string, call_id:string, name:string, namespace:string, input:string, arguments:string, cwd:string>"


def read_plans(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Plan documents as tables: units, edges, accesses, effects, claims, capacities, snapshots, broken.

    Units have the flags of their semantics, with the defaults of ``rules.default_semantics`` where the document
    says nothing (cacheable then is false, commutative false, reorderable unknown), the four assurances (unknown where nothing is said), their
    blockers, and batch_key and batch_strategy. A dependency without a kind is one on success; claims of a resource add
    up. ``broken``: file, count and, where it could be read, plan of the broken documents, which are in no other table.
    """
    read = spark.read.schema(PLAN).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))
    docs = read.where("_corrupt_record is null")
    atoms = docs.select("plan_id", F.explode("atoms").alias("a"))

    def part(field: str, *cols: Column) -> DataFrame:
        return atoms.select("plan_id", F.col("a.id").alias("unit_id"), F.explode(f"a.{field}").alias("x")).select("plan_id", "unit_id", *cols)

    kind = F.col("a.operation.kind")
    # what only reads, and changes nothing
    plain = F.when(F.coalesce("a.side_effect", F.lit(False)), F.lit(None).cast("string")).otherwise(kind)
    said = lambda c: F.col(f"a.semantics.{c}")
    flags = [rules.default_semantics(said(c), plain).alias(c) for c in ("idempotent", "retryable", "deterministic")]
    flags += [F.coalesce(rules.default_semantics(said("cacheable"), plain), F.lit(False)).alias("cacheable"), F.coalesce(said("commutative"), F.lit(False)).alias("commutative"), said("cancel_safe"), said("splittable"), F.coalesce(said("reorderable"), F.lit("unknown")).alias("reorderable")]
    sure = [F.coalesce(f"a.assurance.{c}", F.lit("unknown")).alias(f"{c}_assurance") for c in ("parse", "control", "effects", "codegen")]
    return {
        "units": atoms.select(
            "plan_id", F.col("a.id").alias("unit_id"), kind.alias("kind"), F.col("a.operation.argv").alias("argv"), F.col("a.operation.cwd").alias("cwd"), "a.profile", "a.side_effect", "a.cost", F.col("a.cost.duration_seconds").alias("duration_s"), *flags, *sure,
            F.col("a.assurance.rank").alias("rank"), F.coalesce("a.assurance.blockers", F.array().cast("array<string>")).alias("blockers"), F.col("a.batch.key").alias("batch_key"), F.col("a.batch.strategy").alias("batch_strategy"),
        ),
        "edges": part("depends_on", F.col("x.atom").alias("pred_id"), F.coalesce("x.kind", F.lit("success")).alias("kind")),
        "accesses": part("accesses", F.col("x.resource").alias("resource"), F.col("x.mode").alias("mode")),
        "effects": part("effects", F.col("x.domain").alias("domain"), F.col("x.key").alias("key"), F.col("x.mode").alias("mode")),
        "claims": part("claims", F.col("x.resource").alias("resource"), F.col("x.units").alias("units")).groupBy("plan_id", "unit_id", "resource").agg(F.sum("units").alias("units")),
        "capacities": docs.select("plan_id", F.explode("capacities").alias("resource", "capacity")),
        "snapshots": docs.select("plan_id", F.explode("snapshots").alias("x")).select("plan_id", "x.path", F.col("x.sha256").alias("digest"), "x.size_bytes"),
        "broken": read.where("_corrupt_record is not null").groupBy("file").agg(F.count("*").alias("documents"), F.max("plan_id").alias("plan_id")),
    }


def last_worker_line(stdout: Column) -> Column:
    """The last JSON line of an output whose event is worker_complete, as a struct; null if none."""
    parsed = F.transform(F.split(stdout, "\n"), lambda line: F.from_json(line, WORKER))
    return F.try_element_at(F.filter(parsed, lambda p: p["event"] == "worker_complete"), F.lit(-1))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, type, payload) of the lines that parse; numbers follow the order in the file.

    Files are read line by line and may be split: a line's number is its place in its block and the lines
    of the blocks before.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("from_at"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "from_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    parsed = lines.select("file", "block", "at", F.from_json("line", TRACE).alias("t")).where("t.type is not null")
    return parsed.join(blocks, ["file", "block"]).select("file", (F.col("earlier") + F.col("at") - F.col("from_at")).alias("line_no"), "t.type", "t.payload")


def calls(traces: DataFrame) -> DataFrame:
    """(file, call_id, tool, input): one row per tool of each call, the first line of a call id counts."""
    c = traces.where("type = 'response_item' and payload.type in ('function_call', 'custom_tool_call')")
    first = c.groupBy("file", "payload.call_id").agg(F.min_by("payload", "line_no").alias("p"))
    text = F.coalesce("p.input", "p.arguments", F.lit(""))
    tools = rules.tool_names(F.col("p.type"), F.col("p.name"), F.col("p.namespace"), text)
    return first.select("file", "call_id", F.explode(tools).alias("tool"), text.alias("input"))


def sessions_of(traces: DataFrame, project: str, within: int = 32) -> DataFrame:
    """Files whose first session header, within so many lines, names the project."""
    heads = traces.where((F.col("type") == "session_meta") & (F.col("line_no") < within))
    return heads.groupBy("file").agg(F.min_by("payload.cwd", "line_no").alias("cwd")).where(F.col("cwd") == project).select("file")


def newest_files(files: DataFrame, n: int) -> DataFrame:
    """The n newest of (path, modificationTime); ties by path."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of test reports; error counts before failure before skipped, else passed."""
    schema = "_classname string, _name string, _file string, _line int, _time double, error string, failure string, skipped string"
    x = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\x00").schema(schema).load(path)
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return x.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_time").alias("time_s"), outcome.alias("outcome"))


def read_growth(spark: SparkSession, path: str) -> DataFrame:
    """Growth snapshots; a broken document reads as empty. Downloads are summed over nested assets."""
    schema = "captured_at timestamp, stars long, forks long, traffic struct<views:long,clones:long>, releases array<struct<assets:array<struct<download_count:long>>>>"
    g = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    counts = F.flatten(F.transform("releases", lambda r: F.transform(r["assets"], lambda a: a["download_count"])))
    return g.withColumn("downloads", F.aggregate(F.coalesce(counts, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))).drop("releases")


_RUN = "run_id string, execution_realm string, generated_at timestamp, status string, commit string, wall_time_seconds double, serial_equivalent_seconds double, saved_seconds double, speedup_multiplier double"


def read_bench_history(spark: SparkSession, path: str, realm: str = "unknown") -> DataFrame:
    """(realm, run_id, generated_at, status, commit, wall_s, serial_s, saved_s, speedup) of history documents.

    The newer shape keeps a history per realm, the older one a single list; a document that has realms is
    read by them alone. A row's own realm counts before that of its list, of the older shape before the
    newest run's and then ``realm``. Run ids name their realm. A broken document, and items that are no
    objects, are dropped.
    """
    schema = f"realms map<string, struct<history: array<struct<{_RUN}>>>>, latest struct<{_RUN}>, history array<struct<{_RUN}>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    many = F.coalesce(F.size("realms"), F.lit(0)) > 0
    new = docs.where(many).select(F.explode("realms").alias("listed", "state")).select("listed", F.explode("state.history").alias("h"))
    old = docs.where(~many).select(F.coalesce("latest.execution_realm", F.lit(realm)).alias("listed"), F.explode("history").alias("h"))
    rows = new.unionByName(old).where("h is not null")
    named = history.clean_realm(F.coalesce("h.execution_realm", "listed"))
    out = rows.select(named.alias("realm"), "h.*")
    return out.select("realm", history.qualified(F.col("run_id"), F.col("realm")).alias("run_id"), "generated_at", "status", "commit", F.col("wall_time_seconds").alias("wall_s"), F.col("serial_equivalent_seconds").alias("serial_s"), F.col("saved_seconds").alias("saved_s"), F.col("speedup_multiplier").alias("speedup"))


PROJECT_RESULT = """id string, commit string, category string, repetitions int, environment map<string, string>, comparison struct<baseline: string, candidate: string>,
    parallel struct<wall_seconds: double, serial_seconds: double, speedup: double>, correctness struct<passed: boolean, method: string>"""


def read_project_results(spark: SparkSession, path: str, schema: str = PROJECT_RESULT) -> DataFrame:
    """One row per result of the wrapper documents (``results``, an array), with the document's
    schema_version; a document without results has no rows, a broken one is dropped."""
    docs = spark.read.schema(f"schema_version string, results array<struct<{schema}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return docs.select("schema_version", F.explode("results").alias("r")).where("r is not null").select("schema_version", "r.*")


def bench_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row shape for the single-realm and the per-realm history; an old row's realm is null."""
    return old.unionByName(new, allowMissingColumns=True)


def inventory(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """(path, length, ext) of all files below a folder, contents unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    for s in skip:
        f = f.where(~F.col("path").contains(f"/{s}/"))
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return f.withColumn("ext", F.when(ext == "", "[no-ext]").otherwise(F.lower(ext)))


def content_hits(spark: SparkSession, root: str, glob: str, pattern: str) -> DataFrame:
    """Paths whose path matches the glob and whose text matches the pattern; minified, map, lock
    and env files and files with a NUL are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.where(F.col("path").rlike(rules.glob_regex(glob)) & ~F.col("path").rlike(r"(\.min\.js|\.map|\.lock|/\.env[^/]*)$"))
    text = F.col("content").cast("string")
    return f.where((F.instr(text, "\x00") == 0) & text.rlike(pattern)).select("path")
