"""The registered queries of this subpackage, one per operation, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, dialogue, hamming_search, hyperdim, lines, lm, packing, periodic, pii, sharding, simhash, toxicity, warc

SHARDS = 40
#: tokenizer, its vocabulary as ranks, and the pattern that goes with it
ENCODER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.top_k(codes, codes.where("id % 50 = 0"), k=10)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "stored_bytes", "digest_ok")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "matched", "item_shingles", F.round("containment", 6).alias("containment"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.concat_ws(",", "line_places").alias("removed_lines"), "text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.per_document(table(spark, sf_dir, "documents"))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_tokens", "passages")


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ENCODER)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic.repeat_words(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.with_runs(planted).withColumn("best", periodic.strongest(F.col("runs")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"), F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdim.identify(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    fixed = dialogue.repair(dialogue.damaged(original))
    every = dialogue.met(dialogue.met(original.select("conv_id").distinct(), fixed.conversations, ["conv_id"]), dialogue.digests(fixed.turns), ["conv_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_hamming_topk, op2_warc, op3_decontaminate, op4_line_dedup, op5_simhash, op6_pii, op7_rendezvous, op8_toxic_segments, op9_cross_entropy, op10_packing, op11_periodic_runs, op12_language_id, op13_conversation_repair]
    return {f.__name__: f for f in made}


# ---------------------------------------------------------------- SQL on the same tables

# CRC-32 of ASCII text, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
_PLUS = "{{'cost': {0}.cost + {1}, 'audit': {0}.audit || '{2}', 'said': {0}.said || {3}}}"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _added(state: str, cost: str, edit: str, said: str, when: str = "true") -> str:
    """A state after an edit; null where the state or the condition is missing."""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {_PLUS.format(state, cost, edit, said)} END"


def _inserted(p: str) -> str:
    """The four states of ``p`` with insertions: nothing yet, after system, after user, after assistant."""
    u, a = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    user = _least(f"{p}2", *[_added(f"{p}{i}", "2", "I", u) for i in (0, 1, 3)])
    assistant = _least(f"{p}3", _added(f"{p}2", "2", "I", a), *[_added(f"{p}{i}", "4", "II", f"{u} || {a}") for i in (0, 1)])
    return f"{p}0 AS e0, {p}1 AS e1, {user} AS e2, {assistant} AS e3"


def _turn() -> str:
    """The four states after one more turn (initial, must_go, cut, role, text)."""
    stays, said = "NOT must_go", "chr(10) || role || ':' || text"
    gone = [_added(f"e{i}", "3", "D", "''") for i in range(4)]
    kept = lambda i, initial: _added(f"e{i}", "cut", "K", said, f"{stays} AND initial = '{initial}'")
    named = lambda i, role: _added(f"e{i}", "2 + cut", "R", f"chr(10) || '{role}:' || text", stays)
    return ", ".join([
        f"{gone[0]} AS s0", f"{_least(gone[1], kept(0, 's'))} AS s1", f"{_least(gone[2], *[f(i, x) for i in (0, 1, 3) for f, x in ((kept, 'u'), (named, 'user'))])} AS s2", f"{_least(gone[3], kept(2, 'a'), named(2, 'assistant'))} AS s3",
    ])


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"

ORACLES = {
    "op1_hamming_topk": """
        WITH codes AS (
            SELECT vec_id AS id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding[1:64], x -> CASE WHEN x > 0 THEN 1 ELSE 0 END::HUGEINT)), (a, b) -> a * 2 + b)::UBIGINT AS code
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
        pairs AS (
            SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
            FROM codes q, codes c WHERE q.id % 50 = 0)
        SELECT query_id, neighbor_id, distance, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM pairs)
        WHERE rank <= 10""",
    "op11_periodic_runs": f"""
        WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC.format("doc_id::VARCHAR")} AS h FROM documents),
        sized AS (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g FROM cut),
        planted AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < g % n THEN w[i + 1] ELSE w[g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM sized),
        words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM planted),
        same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
        lanes AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS lane FROM same),
        found AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM lanes GROUP BY doc_id, q, lane HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY 1),
        first AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM runs GROUP BY 1),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) AS r FROM runs) x WHERE r = 1)
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s AS start, b.l AS length, b.q AS period, b.l * 1000 // b.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN first f ON f.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS way FROM conversations),
        hurt AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE way <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS place, left(role, 1) AS initial,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
        judged AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
        faults AS (SELECT *, blank OR again AS must_go, CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM judged),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN again THEN 1 END) AS duplicate, sum(cut)::BIGINT AS truncated,
            count(CASE WHEN before || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal, count(*) AS n FROM faults GROUP BY 1),
        none AS (SELECT {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS e0, NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR) AS nil),
        walk AS (
            SELECT conv_id, 0::BIGINT AS place, e0 AS s0, nil AS s1, nil AS s2, nil AS s3 FROM counts, none
            UNION ALL SELECT conv_id, place, {_turn()} FROM (
                SELECT f.conv_id, f.place, f.initial, f.must_go, f.cut, f.role, f.text, {_inserted("w.s")} FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1) t),
        ended AS (SELECT conv_id, {_least("e0", "e3")} AS best FROM (SELECT w.conv_id, {_inserted("w.s")} FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.place) t)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
            sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
        bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
        n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY 1),
        m AS (SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN bs USING (s) GROUP BY 1, 2)
        SELECT doc_id, item_id, matched, item_shingles, round(matched / item_shingles, 6) AS containment
        FROM m JOIN n USING (item_id) WHERE matched >= ceil(round(item_shingles * 0.8, 9))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
