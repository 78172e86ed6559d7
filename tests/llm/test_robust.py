"""The same odd rows through every operator and stage: clashing columns, nulls, repeats, long texts, empty tables."""

import hashlib
import math
import os
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam, hamming_search, lines, lm, packing, pii, queries, sharding, simhash, simhash_jaccard, toxicity, warc
from weftline.llm.common import mix

#: names that operators use inside, and some that they return
CLASH = [
    "_id", "_key", "_places", "_hit", "_drop", "_drop_id", "_target", "gone", "gone_id", "gone_key", "gone_places", "n_removed", "line_places", "n_lines", "row", "target_id", "label_id", "item_id",
    "y", "h", "g", "id", "key", "code", "fp", "a", "b", "k", "digest", "size", "shard", "slot", "piece", "n", "base", "at", "lo", "part", "ids", "queue", "task", "start", "source_key", "text_key", "kind",
    "value", "label", "toxic", "shingle", "sketch", "bands", "group", "component", "node", "first", "payload", "url", "refers_to", "no_key", "before", "held_out", "score", "predicted", "spans", "window", "gram",
]
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
TEXTS = ["one two three four five six seven eight", None, "", "a", "one two three four five six seven eight", LONG, "tab\tand\x0bvt  twice", "Ünïcode ÉÉ text 日本", LONG + " end", "nul\x00 byte"]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts with null ids, repeated rows, and an extra column for each name."""
    rows = [(i, t, f"s{i % 2}" if i else None, "en") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, "en"), (None, TEXTS[0], "s1", "en"), (None, None, None, None), (3, "other text", "s0", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(f"{c}!") for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, TEXTS[0]), (2, None), (None, TEXTS[0]), (1, TEXTS[0])], "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH if c != "item_id"})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (3, 0, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (6, None, None), (0, 1, 1)], "doc_id long, toxic int, quality int").withColumns({c: F.lit(1) for c in CLASH if c != "toxic"})


def plain(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


FILTERS = {
    "lines": lambda d, i, l: lines.dedup(d),
    "decontam": lambda d, i, l: decontam.clean(d, i),
    "simhash": lambda d, i, l: simhash.keep_one(d),
    "jaccard": lambda d, i, l: simhash_jaccard.keep_one(d),
    "toxicity": lambda d, i, l: toxicity.drop_toxic(d, l),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_extra_columns(odd, items, labels, name):
    slim = odd.select("doc_id", "text", "source", "lang")
    got = FILTERS[name](odd, items, labels)
    assert got.columns[: len(odd.columns)] == odd.columns
    assert plain(got, slim.columns) == plain(FILTERS[name](slim, items.select("item_id", "text"), labels.select("doc_id", "toxic")), slim.columns)
    assert all(r[c] == f"{c}!" for r in got.collect() for c in CLASH)
    assert FILTERS[name](odd.limit(0), items, labels).count() == 0
    assert FILTERS[name](odd, items.limit(0), labels.limit(0)).count() <= odd.count()
    if name in ("simhash", "jaccard"):
        assert sum(r["doc_id"] is None for r in got.collect()) == 2


RESULTS = {
    "lm": lambda d, i, l: lm.cross_entropy_difference(d, l.where("quality = 1")),
    "pii": lambda d, i, l: pii.per_document(d),
    "sharding": lambda d, i, l: sharding.shard_documents(d, 5),
    "classify": lambda d, i, l: toxicity.classify(d, l),
    "packing": lambda d, i, l: packing.pack(d, queries.ENCODER),
    "simhash": lambda d, i, l: simhash.near_duplicates(d),
    "contained": lambda d, i, l: decontam.contained(d, i),
    "warc": lambda d, i, l: warc.round_trip(d, id_col="doc_id", url_col="source", payload_col="text"),
}


@pytest.mark.parametrize("name", RESULTS)
def test_results_ignore_extra_columns(odd, items, labels, name):
    names = RESULTS[name](odd, items, labels).columns
    names = [c for c in names if c not in ("file", "row", "shard_row")]
    slim = odd.select("doc_id", "text", "source")
    assert plain(RESULTS[name](odd, items, labels), names) == plain(RESULTS[name](slim, items.select("item_id", "text"), labels.select("doc_id", "toxic", "quality")), names)
    assert RESULTS[name](odd.limit(0), items, labels).count() == 0
    if name not in ("contained", "packing"):
        assert RESULTS[name](odd, items, labels).count() == odd.count()


def test_top_k_ignores_extra_columns(spark):
    codes = spark.createDataFrame([(i, i * 7 % 11) for i in range(40)] + [(None, 3), (3, None), (3, 21)], "id long, code long")
    more = codes.withColumns({c: F.lit(c) for c in CLASH if c not in ("id", "code")})
    want = plain(hamming_search.top_k(codes, codes, 3), ["query_id", "distance", "rank"])
    assert plain(hamming_search.top_k(more, more, 3), ["query_id", "distance", "rank"]) == want
    assert hamming_search.top_k(more.limit(0), more.limit(0)).count() == 0
    with pytest.raises(Exception, match="64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming_search.sign_code("v")).collect()


@pytest.mark.parametrize("least", [(0, 0), (10, 30)])
def test_line_dedup_equals_brute_force(spark, least):
    r = np.random.default_rng(11)
    pool = [f"line {i} with some words of its own" for i in range(12)] + ["x", "y z"]
    texts = ["\n".join(pool[int(j)] if r.random() < 0.9 else "" for j in r.integers(0, len(pool), r.integers(0, 25))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[4] + "\n" + texts[3]), (5, texts[5]), (6, texts[7])]
    got = sorted((repr(x["doc_id"]), x["text"]) for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), within_lines=False, min_words=least[0], min_chars=least[1]).collect())
    key = {t: i["k"] for t, i in ((x["text"], x) for x in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("k")).collect())}
    own = {row: [s.strip() for s in row[1].split("\n") if s.strip()] for row in set(rows)}
    seen = {}
    for row in sorted(own, key=lambda x: (x[0] is None, x[0] or 0, key[x[1]])):
        for p in range(len(own[row]) - 2):
            seen.setdefault(tuple(own[row][p : p + 3]), []).append((row, p))
    lost = {row: set() for row in own}
    for where in seen.values():
        first = where[0]
        for row, p in where[1:]:
            lost[row] |= set(range(p, p + 3)) - (set(range(first[1], first[1] + 3)) if row == first[0] else set())
    want = []
    for row in rows:
        gone, run = set(), []
        for p in [*sorted(lost[row]), None]:
            if run and p != run[-1] + 1 if p is not None else run:
                words = [own[row][q] for q in run]
                if sum(map(len, words)) >= least[1] or sum(len(w.split()) for w in words) >= least[0]:
                    gone |= set(run)
                run = []
            run.append(p)
        out, i, blanks, last = [], 0, [], False
        for line in row[1].splitlines(keepends=True):
            if not line.strip():
                blanks.append(line)
                continue
            if not (last and i in gone):
                out += blanks
            blanks, last = [], i in gone
            if i not in gone:
                out.append(line)
            i += 1
        want.append((repr(row[0]), "".join(out + blanks)))
    assert got == sorted(want)
    assert any(len(a[1]) < len(b) for a, b in zip(want, texts))


def test_warc_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    wide = spark.createDataFrame([(-(2**63), "u", "<p>" * 60), (2**63 - 1, "u", "<p>" * 60), (2**63 - 1, "u", "<p>" * 60), (None, None, "<p>" * 60), (7, "big", "long " * 1_000_000), (9, "null", None)], "page_id long, url string, html string")
    rows = pages.union(wide)
    first = {}
    for r in rows.collect():
        body = (r["html"] or "").encode()
        if len(body) >= 100 and r["page_id"] is not None:
            first[body] = min(first.get(body, 2**63), r["page_id"])
    want = []
    for r in rows.collect():
        body = (r["html"] or "").encode()
        to = first.get(body) if len(body) >= 100 and first.get(body) != r["page_id"] else None
        want.append((r["page_id"], len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    got = warc.round_trip(rows, shards=5).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert plain(got, got.columns) == sorted(want, key=repr)


def test_warc_shards_are_even(spark):
    """One stray id, dense ranges and a key that a third of the rows have leave no shard large."""
    rows = [(10**15, "u", "x" * 500)] + [(i, "u", f"{i} " * 100) for i in range(600)] + [(5000, "u", f"page {i} " * 60) for i in range(300)]
    planned, shards = warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string"), 8, "page_id", "url", "html", 100)
    n = [r["count"] for r in planned.groupBy("shard").count().collect()]
    assert shards == 8 == len(n) and max(n) < 2 * sum(n) / 8


def test_sharding_equals_brute_force(spark, odd):
    """The shard of a key by the scores themselves, and slots without a gap although a third of the rows are equal."""
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(7, "t7")] * 150, "doc_id long, text string")
    got = sharding.shard_documents(rows, 6).collect()
    keys = spark.range(300).select(F.col("id"), *[F.xxhash64(F.col("id").cast("string"), F.lit(s)).alias(f"h{s}") for s in range(7)]).collect()

    def best(r, n):
        return min(range(n), key=lambda s: (1.0 / -math.log((((r[f"h{s}"] & (2**64 - 1)) >> 12) + 0.5) / 2.0**52) * -1, s))

    shard = {r["id"]: (best(r, 6), best(r, 7)) for r in keys}
    assert all((r["shard"], r["grown_shard"]) == shard[r["doc_id"]] for r in got) and len(got) == 450
    assert all((r["size"], r["text_crc32"]) == (len(f"t{r['doc_id']}") + 16, zlib.crc32(f"t{r['doc_id']}".encode())) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    # the copies of a row are numbered in chunks, not sorted
    assert sorted(r["slot"] for r in sharding.numbered(rows.withColumn("shard", F.lit(0)), chunk=7).collect()) == list(range(450))


def test_toxicity_score_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    listed = dict(zip(m.tokens.tolist(), zip(m.z, m.scores)))
    texts = [r["text"] for r in docs.limit(150).collect()] + ["日本語の文章" * 5, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(rows, m).collect():
        score = []
        for w in re.findall("[0-9a-z\x80-\U0010ffff]+", (texts[r["doc_id"]] or "").lower()):
            starts = [i for i, c in enumerate(w) if i == 0 or re.match("[　-鿿]", c)]
            for s in starts:
                raw = w[s:].encode()
                hit = []
                for p in m.prefixes:
                    # the hash of a beginning is salted with its length
                    base = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(raw[:p])) & (2**64 - 1)
                    key = int(mix(np.array([(base + p) & (2**64 - 1)], np.uint64))[0])
                    if key in listed:
                        hit.append((listed[key][0], -p, listed[key][1]))
                score.append(max(hit)[2] if hit else m.drift)
        segments = [(a, b, sum(score[a:b])) for a, b in best_segments(score)]
        e, _ = toxicity.evidence(len(score), segments, m.scale, m.k, m.max_expected)
        assert r["n_tokens"] == len(score)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(m.intercept + m.slope * math.log1p(e)))), abs=1e-9)


def best_segments(s):
    """All maximal-scoring segments by repeated splitting, without recursion."""
    out, todo = [], [(0, len(s))]
    sums = np.concatenate(([0.0], np.cumsum(s)))
    while todo:
        a, b = todo.pop()
        if b <= a or max(s[a:b]) <= 0:
            continue
        best, low = (-1.0, 0, a, a), a
        for j in range(a + 1, b + 1):
            if sums[j] - sums[low] > best[0] + 1e-12:
                best = (sums[j] - sums[low], 0, low, j)
            if sums[j] <= sums[low]:
                low = j
        out.append((best[2], best[3]))
        todo += [(a, best[2]), (best[3], b)]
    return out


def shingle_set(t):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """Groups of ids at Jaccard 0.8, by counting shared shingles."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where, root = {}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = {}
    for i, s in sets.items():
        for x in s:
            for j in where.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            where[x].append(i)
    equal = {}
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    for i, t in texts.items():
        pairs.append((equal.setdefault(t or "", i), i))
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in texts}


def test_near_groups_of_the_given_table(spark):
    """Recall and precision against all pairs at similarity 0.8: no less than 0.99 of the links, nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near_groups({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = {r["id"]: r["group"] for r in simhash_jaccard.groups(docs).collect()}
    moved = {i: g for i, g in want.items() if i != g}
    right = sum(got.get(i) == g for i, g in moved.items())
    print("near copies", len(moved), "found", right)
    assert moved and right >= 0.99 * len(moved) and set(got) <= set(moved)


def test_pipeline(spark, tmp_path):
    """Planted toxic documents, passages, exact and near copies and benchmark items, stage by stage and as one run."""
    r = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{x}" for x in r.integers(0, 4000, n))
    texts = {i: say(150) for i in range(60)}
    for i in range(60, 120):
        texts[i] = say(60) + (" vile scum filth" * 8 if i % 2 else "") + " " + say(60)
    item = say(30)
    texts[200] = say(80) + " " + item + " " + say(80)
    passage = "\n".join(say(12) for _ in range(5))
    for i in (210, 211, 212):
        texts[i] = f"{say(100)}\n{passage}\n{say(100)}"
    for i in range(20):
        texts[300 + i] = texts[i]
        w = texts[20 + i].split()
        w[70] = "changed"
        texts[400 + i] = " ".join(w)
    texts[500], texts[501] = None, ""
    texts |= {1000 + i: say(400) for i in range(400)}
    labels = [(i, 1, int(i % 2)) for i in range(60, 120)] + [(i, 1, 0) for i in (*range(40), *range(1000, 1400))]
    doc = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], doc).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {x["doc_id"] for x in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns
        if name == "line_dedup":
            text = {x["doc_id"]: x["text"] for x in docs.collect()}
        if name == "simhash_dedup":
            want = near_groups({x["doc_id"]: x["text"] for x in before.collect()})
            assert ids[name] == {i for i, g in want.items() if i == g}
    toxic = {i for i in range(60, 120) if i % 2}
    assert len(toxic - ids["toxicity"]) >= 0.9 * len(toxic) and set(texts) - toxic == ids["toxicity"] - toxic
    assert ids["line_dedup"] == ids["toxicity"] and passage in text[210] and not any(x in text[211] + text[212] for x in passage.split("\n"))
    # line dedup has emptied the exact copies: one document without text is left of them all
    assert all(not (text[i] or "") for i in range(300, 320)) and len(ids["simhash_dedup"] & {*range(300, 320), 500, 501}) == 1
    assert ids["simhash_dedup"] >= {*range(60), 200}
    alone = {x["doc_id"] for x in corpus_pipeline.dedup_documents(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert alone == set(texts) - {*range(300, 320), *range(400, 420), 501}
    assert ids["simhash_dedup"] - ids["decontamination"] == {200} and ids["packing"] == ids["decontamination"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert plain(out, ["doc_id", "start", "length", "ids_crc32"]) == plain(docs, ["doc_id", "start", "length", "ids_crc32"])
    assert os.path.isdir(f"{tmp_path}/packing")


def test_pipeline_drops_what_simhash_links(spark):
    """Two texts that repeat one phrase differ in no bit to speak of, though most of their distinct shingles do."""
    phrase = " ".join(f"w{i}" for i in range(21))
    texts = [(i, " ".join([phrase] * 60 + [f"{tag}{j}" for j in range(60)])) for i, tag in ((1, "x"), (2, "y"))] + [(3, " ".join(f"z{j}" for j in range(300)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [1, 3]
    assert simhash_jaccard.keep_one(docs).count() == 3


def _plans(module, monkeypatch):
    """The plans of the intermediate tables that a module writes, by label."""
    plans, write = {}, module.written

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(module, "written", spy)
    return plans


def test_line_places_are_not_shuffled_to_be_distinct(spark, monkeypatch):
    text = "One here.\nTwo here.\nThree here.\nFour here.\n"
    rows = [(1, text), (1, text), (None, text), (2, text + text), (2, text + text), (None, text), (3, "Five.\nSix.\nSeven.\n"), (3, "Five.\nSix.\nSeven.\n")]
    plans = _plans(lines, monkeypatch)
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", text)] * 2 + [("2", "")] * 2 + [("None", "")] * 2 + [("3", "Five.\nSix.\nSeven.\n")] * 2)
    assert "Exchange" not in plans["lines-places"]


def test_document_dedup_filters_ids_not_texts(spark, odd, monkeypatch):
    """The same documents as one dedup after the other; tasks that sketch texts run no second Python worker for a filter."""
    base = [f"w{i}" for i in range(300)]
    near = [" ".join(base[:k] + ["x"] * n + base[k:]) for k, n in ((0, 0), (150, 1), (299, 1), (20, 9), (0, 0))]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    plans = _plans(simhash_jaccard, monkeypatch)
    for docs in (odd.select("doc_id", "text"), more):
        want = simhash_jaccard.keep_one(simhash.keep_one(docs)).collect()
        plans.clear()
        got = corpus_pipeline.dedup_documents(spark, docs, "").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        assert "ArrowEvalPython" not in plans["near-equal"] + plans["near-sketches"]


def test_filters_come_to_the_driver_as_numbers(spark):
    """Rows of a filter are no Python objects: what the driver takes is some bytes a row."""
    import tracemalloc

    from weftline.llm import common

    keys = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    common.bit_filter(keys.limit(10), "h")
    tracemalloc.start()
    table = common.bit_filter(keys, "h", 22)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(table) > 60_000 and peak < 40 * len(table)
    known = np.array([r["h"] for r in keys.limit(1000).collect()], dtype=np.int64).view(np.uint64)
    assert common.passes(table, known).all()
    assert not common.bit_filter(keys.where("false"), "h", 18).any()
