"""Row rules: durations, diagnostics, classes, tags."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: seconds taken for a unit that declares none, by kind
DEFAULT_SECONDS = {"read": 0.25, "test": 2.0, "build": 3.0, "compose_service": 2.0, "network": 1.0, "opaque": 1.5}
# fixed values: below these seconds a unit is too small to run alone, by profile
TINY_SECONDS = {"cpu": 0.2, "io": 0.1, "mixed": 0.15, "accelerator": 0.5}


def _mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def effective_duration(declared: Column, startup: Column, kind: Column) -> Column:
    start = F.coalesce(startup, F.lit(0.0))
    return F.when(declared.isNotNull(), F.greatest(F.lit(0.001), declared + start)).otherwise(F.coalesce(_mapped(DEFAULT_SECONDS, kind), F.lit(1.0)) + start)


def unit_flags(inferred: Column, declared: Column, writes: Column, resources: Column, estimate: Column, profile: Column) -> dict[str, Column]:
    """side_effect: inferred or declared; force_serial: a side effect without writes and resources; tiny."""
    effect = F.coalesce(inferred, F.lit(False)) | F.coalesce(declared, F.lit(False))
    return {"side_effect": effect, "force_serial": effect & (writes == 0) & (resources == 0), "tiny": F.coalesce(estimate < _mapped(TINY_SECONDS, profile), F.lit(False))}


def unit_class(force_serial: Column, tiny: Column, conflicting: Column, side_effect: Column) -> Column:
    return F.when(force_serial, "serial").when(tiny, "batch_candidate").when(conflicting | side_effect, "conditional").otherwise("parallel_ready")


def candidate_class(already: Column, blocked: Column, rewrite: Column, advisory: Column, native: Column) -> Column:
    return F.when(already, "already_parallel").when(blocked, "blocked").when(rewrite, "rewrite").when(advisory, "advisory").when(native, "native").otherwise("blocked")


def diagnostics(units: DataFrame, peaks: DataFrame) -> DataFrame:
    """(plan_id, unit_id, code, severity). ``units``: parse_assurance, control_assurance,
    effects_assurance, codegen_assurance, side_effect, retryable, cacheable, idempotent,
    deterministic; null flags are unknown, never true. ``peaks``: (plan_id, peak)."""
    u = units.join(peaks, "plan_id", "left")
    yes = lambda c: F.col(c).eqNullSafe(True)
    busy = F.coalesce("peak", F.lit(0)) > 1
    effects, parse, code = F.col("effects_assurance"), F.col("parse_assurance"), F.col("codegen_assurance")
    incomplete = (effects == "unknown") | ((effects == "partial") & (yes("side_effect") | busy))
    found = [
        (parse.isin("opaque", "invalid"), "OPAQUE_OR_INVALID_ATOM", "error"),
        (parse == "conservative", "CONSERVATIVE_PARSE", "warning"),
        (incomplete, "INCOMPLETE_EFFECT_MODEL", "error"),
        ((effects == "partial") & ~incomplete, "PARTIAL_EFFECT_MODEL", "warning"),
        (code == "opaque", "NON_EXECUTABLE_CODEGEN", "error"),
        (code == "native_delegate", "NATIVE_DELEGATE_REQUIRED", "error"),
        (yes("retryable") & ~yes("idempotent"), "UNSAFE_RETRY_CONTRACT", "error"),
        (yes("cacheable") & ~(yes("deterministic") & yes("idempotent") & ~yes("side_effect")), "UNSAFE_CACHE_CONTRACT", "error"),
    ]
    if "control_assurance" in units.columns:
        found.append((F.col("control_assurance") == "unknown", "UNKNOWN_CONTROL_FLOW", "error"))
    if "internal_kind" in units.columns:
        found.append(((F.col("internal_kind") == "unknown") & busy, "UNKNOWN_INTERNAL_PARALLELISM", "warning"))
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code_).alias("code"), F.lit(sev).alias("severity"))) for c, code_, sev in found]))
    return u.select("plan_id", "unit_id", F.explode(rows).alias("d")).select("plan_id", "unit_id", "d.code", "d.severity")


def plan_diagnostics(plans: DataFrame, units: DataFrame, pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """(plan_id, unit_id, other_id, code, severity) of whole plans: no unit, units in conflict that no
    dependency orders, claims that can't be met. ``pairs``: (plan_id, first, second, ordered, fenced) of
    ``conflicts.reorder_fences``; ``blocked``: (plan_id, unit_id, ..) of ``hosts.unsatisfiable``."""
    none = F.lit(None).cast(units.schema["unit_id"].dataType)
    empty = plans.select("plan_id").distinct().join(units.select("plan_id"), "plan_id", "left_anti").select("plan_id", none.alias("unit_id"), none.alias("other_id"), F.lit("EMPTY_ATOM_PLAN").alias("code"), F.lit("error").alias("severity"))
    loose = pairs.where(~F.col("ordered")).select("plan_id", F.col("first").alias("unit_id"), F.col("second").alias("other_id"), F.when(F.col("fenced"), "UNORDERED_SEMANTIC_CONFLICT").otherwise("SERIALIZED_REORDERABLE_CONFLICT").alias("code"), F.when(F.col("fenced"), "error").otherwise("warning").alias("severity"))
    unmet = blocked.select("plan_id", "unit_id").distinct().select("plan_id", "unit_id", none.alias("other_id"), F.lit("UNSATISFIABLE_RESOURCE_CLAIM").alias("code"), F.lit("error").alias("severity"))
    return empty.unionByName(loose).unionByName(unmet)


def coarse_rows(units: DataFrame) -> dict[str, DataFrame]:
    """Units that list what they read, write and share (arrays ``reads``, ``writes``, ``resources``; null: none)
    as typed rows: accesses(unit_id, resource, mode), effects(unit_id, domain, key, mode) and
    blockers(unit_id, blocker) for units, other than reads, that declare nothing."""
    modes = F.array(F.struct(F.col("reads").alias("r"), F.lit("read").alias("mode")), F.struct(F.col("writes").alias("r"), F.lit("overwrite").alias("mode")))
    accesses = units.select("unit_id", F.explode(modes).alias("m")).select("unit_id", F.explode("m.r").alias("resource"), "m.mode")
    cut = F.split("resource", ":", 2)
    effects = units.select("unit_id", F.explode("resources").alias("resource")).select("unit_id", F.when(F.size(cut) > 1, cut[0]).otherwise("logical-resource").alias("domain"), F.element_at(cut, -1).alias("key"), F.lit("write").alias("mode"))
    declared = F.col("kind") == "read"
    for c in ("reads", "writes", "resources"):
        declared = declared | (F.coalesce(F.size(c), F.lit(0)) > 0)
    blockers = units.where(~F.coalesce(declared, F.lit(False))).select("unit_id", F.lit("LEGACY_EFFECT_SET_INCOMPLETE").alias("blocker"))
    return {"accesses": accesses, "effects": effects, "blockers": blockers}


def routes(units: DataFrame, found: DataFrame) -> DataFrame:
    """(plan_id, route): direct without errors, else delegate if a native scheduler is asked for, else blocked."""
    per = found.groupBy("plan_id").agg(F.bool_or(F.col("severity") == "error").alias("bad"), F.bool_or(F.col("code") == "NATIVE_DELEGATE_REQUIRED").alias("native"))
    out = units.select("plan_id").distinct().join(per, "plan_id", "left")
    return out.select("plan_id", F.when(~F.coalesce("bad", F.lit(False)), "direct").when(F.col("native"), "delegate").otherwise("blocked").alias("route"))


def default_semantics(flag: Column, kind: Column, read_only: tuple[str, ...] = ("read",)) -> Column:
    """A read-only unit's flags default to true, others stay unknown."""
    return F.coalesce(flag, F.when(kind.isin(*read_only), F.lit(True)))


def gain(serial: Column, items: Column, workers: Column) -> Column:
    """Modelled parallel seconds: 15 % serial, .12 s a worker, .002 s an item (else .01 s a worker)."""
    known = F.coalesce(items, F.lit(0)) > 0
    w = F.greatest(F.lit(1), F.when(known, F.least(workers, items)).otherwise(workers))
    ipc = F.when(known, items * 0.002).otherwise(w * 0.01)
    return F.greatest(F.lit(0.0), serial * (F.lit(0.15) + F.lit(0.85) / w) + w * 0.12 + ipc)


# fixed values: words that ask for execution, for parallel work, for many things, for long work
EXECUTION = "(?i)(?:\\b(?:run|execute|test|lint|build|compile|benchmark|generate|render|scan|validate|verify|package|deploy|convert|process|refactor|optimi[sz]e)\\b|运行|执行|测试|检查|构建|编译|基准|生成|渲染|扫描|校验|验证|打包|部署|转换|处理|改造|优化|跑一下|跑一遍)"
PARALLEL = "(?i)(?:\\b(?:parallel|concurrent|concurrency|fan[- ]?out|shard(?:ed|ing)?|job matrix)\\b|并行|并发|多路|分片|任务矩阵)"
MULTIPLE = "(?i)(?:\\b(?:multiple|several|batch|each|every|all|matrix|across|independent|many)\\b|多个|多项|多组|批量|每个|全部|分别|独立|一批|多平台|多容器)"
LONG = "(?i)(?:\\b(?:long[- ]?running|slow|minutes?|hours?|five[- ]minute|time[- ]?consuming)\\b|长时间|耗时|分钟|小时|五分钟|5\\s*分钟)"


def request_class(text: Column) -> Column:
    return F.when(~text.rlike(EXECUTION), "direct").when(text.rlike(PARALLEL) | (text.rlike(MULTIPLE) & text.rlike(LONG)), "candidate").otherwise("inspect")


# fixed values: tags of a lower-cased call input
SIGNATURES = {
    "search": r"\b(?:rg|sed|find|fd|jq)\b",
    "tests": r"\b(?:pytest|unittest|ctest|vitest|jest|playwright|cypress|swift\s+test|go\s+test|cargo\s+test|npm\s+(?:run\s+)?test|pnpm\s+(?:run\s+)?test)\b",
    "experiment_python": r"(?:python\S*)[^\n]*(?:experiments/|-m\s+experiments\.)",
    "numerical_python": r"\b(?:numpy|scipy|cvxpy|blas|lapack|svd|eigen)\b",
    "latex": r"\b(?:latexmk|pdflatex|xelatex|bibtex|biber)\b",
    "pdf": r"\b(?:pdftoppm|pdfinfo|pdftotext|pdfseparate)\b",
    "image": r"\b(?:png|jpe?g|tiff?|heic|imagemagick|sips|vimage)\b",
    "video": r"\b(?:ffmpeg|videotoolbox|mp4|mov|mkv)\b",
    "audio": r"\b(?:wav|flac|mp3|audio|vdsp|speech)\b",
    "ml": r"\b(?:coreml|mlx|pytorch|torch|tensorflow|onnx|safetensors|inference)\b",
    "data": r"\b(?:parquet|csv|jsonl|etl|schema|dataset)\b",
    "database": r"\b(?:prisma|postgres(?:ql)?|migrat(?:e|ion)|seed(?:ing)?)\b",
    "runtime_parallelism": r"\b(?:processpoolexecutor|threadpoolexecutor|multiprocessing|worker_threads?|dispatchqueue|xargs\s+-p|gnu\s+parallel)\b",
    "vector_kernel": r"\b(?:simd|vdsp|vimage|bnns|accelerate\.framework|numpy|scipy|blas|lapack)\b",
    "serialization": r"\b(?:json\.parse|json\.stringify|orjson|simdjson|serde_json|csv|xml|yaml)\b",
    "streaming_io": r"\b(?:mmap|createreadstream|createwritestream|readstream|writestream|chunksize|chunk_size)\b",
    "cache": r"\b(?:ccache|sccache|incremental|content-addressed|\.next/cache|turbo\s+run)\b",
    "docker": r"\b(?:docker|podman|buildx)\b",
    "native_build": r"\b(?:cmake|ninja|cargo|go\s+build|clang|gcc|g\+\+)\b",
    "network": r"\b(?:curl|wget|rsync|scp|docker\s+pull)\b",
    "archive": r"\b(?:zip|tar|gzip|shasum|sha256sum)\b",
    "git": r"\bgit\s+(?:status|diff|show|log|add|commit|tag|push)\b",
    "audit": r"\b(?:audit|verify|verification|claims?|readiness|preflight)\b",
    "mutation": r"apply_patch",
    "remote": r"connector",
}
# fixed values: tags of the lower-cased tool names of a call
NAME_SIGNATURES = {"pdf": "view_image", "image": "view_image", "mutation": "apply_patch", "remote": "web__run|mcp__", "agent_orchestration": r"\b(?:collaboration\.|spawn_agent|send_message|wait_agent|list_agents)\b"}


def signatures(text: Column, names: Column | None = None) -> Column:
    low = F.lower(text)
    tags = [F.when(low.rlike(p), t) for t, p in SIGNATURES.items()]
    if names is not None:
        tags += [F.when(F.lower(names).rlike(p), t) for t, p in NAME_SIGNATURES.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


# fixed values: commands that change something, with the resources they hold and the reason
TRAITS = [
    (r"(?:^|\s)git\s+(?:add|commit|merge|rebase|reset|checkout|switch|tag|stash|cherry-pick)(?:\s|$)", ("git:index", "git:refs"), "mutates the repository index or refs"),
    (r"(?:migrate|migration|prisma\s+db\s+(?:push|seed)|alembic\s+upgrade|rails\s+db:|manage\.py\s+migrate)", ("database:default",), "appears to mutate a database schema or fixtures"),
    (r"(?:docker\s+compose|docker-compose)\s+(?:up|down|create|start|stop|restart|rm)", ("docker:compose",), "mutates one Docker Compose project"),
    (r"(?:^|\s)(?:npm|pnpm|yarn|bun|pip|uv|poetry)\s+(?:install|add|remove|update|sync)(?:\s|$)", ("dependencies",), "mutates a dependency environment or lockfile"),
    (r"(?:^|\s)(?:rm|mv|cp|touch|mkdir|install|tee)(?:\s|$)|(?:^|\s)sed\s+-i(?:\s|$)", (), "contains a filesystem-mutating command"),
    (r"(?:kubectl\s+(?:apply|delete|patch|scale)|terraform\s+(?:apply|destroy)|aws\s+.*(?:put|delete|update))", ("external-account:default",), "appears to mutate external infrastructure or an account"),
]


#: resources that belong to one folder: of two folders they don't meet
OF_FOLDER = ("git:index", "git:refs", "docker:compose", "dependencies")


def command_traits(command: Column, cwd: Column | None = None, kind: Column | None = None) -> dict[str, Column]:
    """side_effect, resources and reasons of a command line; with ``cwd``, resources of a folder name it (git's name the
    repository, so give its folder). A unit of the kind ``mutation`` changes something whatever its command."""
    held = lambda r: F.concat_ws(":", F.lit(r), cwd) if cwd is not None and r in OF_FOLDER else F.lit(r)
    low = F.lower(command)
    hits = [(F.coalesce(low.rlike(p), F.lit(False)), res, why) for p, res, why in TRAITS]
    any_hit = F.lit(False) if kind is None else F.coalesce(kind == "mutation", F.lit(False))
    for c, _, _ in hits:
        any_hit = any_hit | c
    resources = F.array_compact(F.array(*[F.when(c, held(r)) for c, rs, _ in hits for r in rs]))
    return {"side_effect": any_hit, "resources": resources, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, _, w in hits]))}


# fixed values: the option that bounds the inner workers of a tool
WORKER_FLAGS = {
    "make": "-j|--jobs", "gmake": "-j|--jobs", "ninja": "-j|--jobs", "pytest": "-n|--numprocesses", "jest": "--maxWorkers|--max-workers", "vitest": "--maxWorkers|--max-workers",
    "xargs": "-P|--max-procs", "docker-compose": "--parallel", "turbo": "--concurrency|--parallel|--max-parallel", "nx": "--concurrency|--parallel|--max-parallel", "lerna": "--concurrency|--parallel|--max-parallel",
}


def inner_workers(argv: Column) -> Column:
    """STRUCT(kind, tokens) of a command's own workers: bounded by a number, native, or unknown."""
    tool = F.element_at(F.split(F.try_element_at(argv, F.lit(1)), "/"), -1)
    line = F.concat(F.lit(" "), F.array_join(argv, " "), F.lit(" "))
    bound = F.lit(None).cast("string")
    for name, flags in WORKER_FLAGS.items():
        short = [f for f in flags.split("|") if len(f) == 2]
        glued = "|".join(short)
        pattern = rf"\s(?:(?:{flags})[ =]{'|(?:' + glued + ')' if glued else ''})0*([1-9][0-9]*)\s"
        bound = F.when(tool == name, F.regexp_extract(line, pattern, 1)).otherwise(bound)
    tokens = F.nullif(bound, F.lit("")).cast("int")
    kind = F.when(tokens.isNotNull(), "bounded").when(tool.isin(*WORKER_FLAGS), "native_scheduler").otherwise("unknown")
    return F.struct(kind.alias("kind"), tokens.alias("tokens"))


def quarantine(raw: Column, low: float, high: float) -> dict[str, Column]:
    """number (null if bad) and reason (null if good): not a boolean, a finite number, in bounds."""
    text = F.lower(F.trim(raw.cast("string")))
    value = text.try_cast("double")
    bad = F.when(text.isNull(), "null").when(text.isin("true", "false"), "boolean").when(value.isNull(), "not_a_number").when(F.isnan(value) | (F.abs(value) == float("inf")), "not_finite").when((value < low) | (value > high), "out_of_bounds")
    return {"number": F.when(bad.isNull(), value), "reason": bad}


def trusted_run(id_: Column, event: Column, sha: Column, branch: Column, conclusion: Column, events: list[str], workflow: Column | None = None, workflows: list[str] | None = None) -> Column:
    """The first reason not to trust a workflow run, null if it is trusted."""
    reason = F.when(F.coalesce(id_, F.lit(0)) <= 0, "id").when(~F.coalesce(sha.rlike("^[0-9a-f]{40}$"), F.lit(False)), "commit").when(F.coalesce(branch, F.lit("")) != "main", "branch").when(~F.coalesce(event.isin(*events), F.lit(False)), "event").when(F.coalesce(conclusion, F.lit("")) != "success", "conclusion")
    if workflow is None:
        return reason
    return F.when(~F.coalesce(workflow.isin(*(workflows or [])), F.lit(False)), "workflow").otherwise(reason)


def _composed(path: Column) -> Column:
    """Paths in one spelling: composed (NFC), then case-folded. Only those with other characters than ASCII are handed over."""

    @F.arrow_udf("string")
    def run(paths: pa.Array) -> pa.Array:
        # null where the path is plain
        return pa.array([p and unicodedata.normalize("NFC", p).casefold() for p in paths.to_pylist()], pa.string())

    return F.coalesce(run(F.when(path.rlike("[^\\x00-\\x7F]"), path)), F.lower(path))


def normal_path(path: Column) -> Column:
    """Composed and case-folded, with ``.`` and ``..`` folded and slashes single."""
    parts = F.filter(F.split(_composed(path), "/"), lambda p: (p != "") & (p != "."))
    fold = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/"))


def glob_regex(glob: str) -> str:
    """A case-insensitive pattern for a path glob; a leading ``**/`` may match nothing."""
    out, rest = "", glob
    if rest.startswith("**/"):
        out, rest = "(?:.*/)?", rest[3:]
    for part in re.findall(r"\*+|\?|\[!?\]?[^]]*\]|.", rest, re.DOTALL):
        if part[0] in "*?":
            out += ".*" if part[0] == "*" else "."
        elif part[0] == "[" and len(part) > 2:
            # a set of characters: only ! has a meaning of its own in a glob
            inside = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
        else:
            out += part if part.isalnum() else "\\" + part
    return f"(?is)^{out}$"


def tool_names(kind: Column, name: Column, namespace: Column, text: Column) -> Column:
    """Tools of a call: a function's qualified name; of a custom call every ``tools.X(``, else its name."""
    known = F.coalesce(name, F.lit("unknown"))
    own = F.when(F.coalesce(namespace, F.lit("")) != "", F.concat_ws(".", namespace, known)).otherwise(known)
    used = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\btools\.([A-Za-z0-9_]+)\s*\("), F.lit(1))
    return F.when((kind == "custom_tool_call") & (F.size(used) > 0), used).otherwise(F.array(own))


def hint_candidates(rows: DataFrame, label: str, hint: Column, most: int, key: str = "id") -> DataFrame:
    """(key, label, hinted): of rows with the same key the first by label, those that share a token with the hint first, then by
    key, at most ``most``."""
    one = rows.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    return one.withColumn("hinted", F.coalesce(hinted(F.col("label"), hint), F.lit(False))).orderBy(F.desc("hinted"), key).limit(most)


def hinted(label: Column, hint: Column) -> Column:
    """Whether label and hint share a token of three or more characters."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_-]{3,})"), F.lit(1))
    return F.arrays_overlap(tokens(label), tokens(hint))
