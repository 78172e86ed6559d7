"""Runs of words, languages and conversations: odd rows, and whole tables against brute force."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import dialogue, hyperdim, periodic, queries

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- runs


def brute_runs(w, least=6, times=4):
    """Every stretch of matches on every diagonal, and by hand whether a smaller period holds."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            stretch = w[s : s + length]
            if length >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_texts():
    rng = random.Random(5)
    for least, times in [(6, 4), (6, 4), (6, 4), (3, 3), (12, 3), (9, 5)]:
        texts = []
        for _ in range(150):
            w = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(0, 80))]
            for _ in range(rng.randint(0, 3)):
                if w:
                    a, p = rng.randrange(len(w)), rng.randint(1, 12)
                    for i in range(a, min(len(w), a + rng.randint(1, 60))):
                        w[i] = w[a + (i - a) % p]
            texts.append(" ".join(w))
        for text, (n, runs, kept) in zip(texts, periodic.scan([t.encode() for t in texts], least, times)):
            w = text.split()
            assert (n, runs, kept.decode()) == (len(w), brute_runs(w, least, times), collapse(w, runs))


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.array([1, 1, 1]), 3, 2, 2)


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t\r\n", "a", "a " * 6, "a " * 5, "a\x0bb\x0ca\x0db a b a b", "x " + "a b " * 4, "           ", "w " * 50_000]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, "a " * 6), (4, "a " * 6)], "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("s"), "n_words": F.lit(2)})
    got = periodic.with_runs(t)
    assert sorted(got.columns) == ["collapsed", "doc_id", "n_words", "runs", "start", "text"]
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][:9]) for r in got.collect()), key=repr)
    assert rows == sorted(
        [(0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 1, [], "a"), (4, 6, [(0, 6, 1)], "a"), (5, 5, [], "a a a a a"), (6, 8, [(0, 8, 2)], "a b"), (7, 9, [(1, 8, 2)], "x a b"), (8, 6, [(0, 6, 1)], " "), (9, 50_000, [(0, 50_000, 1)], "w"), (-1, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a")],
        key=repr,
    )
    assert periodic.with_runs(t.where("false")).count() == 0


def test_runs_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, D).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(WORD.findall(text or ""))
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r["collapsed_sha256"] == sha(collapse(w, runs))
    assert planted > 5 and any(r["n_runs"] for r in got.values())


# ---------------------------------------------------------------- languages


def brute_vector(text, dims):
    """The bundle of a text, trigram by trigram and sign by sign."""
    signs = lambda c: 1 - 2 * hyperdim.letters(np.array([ord(c)]), dims)[0].astype(int)
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    out = np.zeros(dims)
    for word in words:
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            out += np.roll(signs(a), 2) * np.roll(signs(b), 1) * signs(c)
    return out


def test_vectors_are_bundles_of_bound_letters(monkeypatch):
    texts = ["The cat, the hat.", "", None, "Ünïcode ÉÉ 日本語 text 42", "a", "123", "́x"] + ["ab cd"] * 3
    for chars, grams in [(1 << 20, 2048), (8, 3)]:
        monkeypatch.setattr(hyperdim, "GROUP_CHARS", chars)
        monkeypatch.setattr(hyperdim, "GRAMS", grams)
        got = {}
        for first, sums, _ in hyperdim.vectors(texts, 128):
            got |= {first + i: v for i, v in enumerate(sums)}
        for i, t in enumerate(texts):
            assert (got.get(i, np.zeros(128)) == brute_vector(t or "", 128)).all()


def test_language_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    dims, sums = 256, {}
    vectors = {r["doc_id"]: brute_vector((r["text"] or "")[:700], dims) for r in docs}
    for r in docs:
        if not out(r["doc_id"]):
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    names = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    mean = unit.mean(axis=0)
    short = spark.createDataFrame([(r["doc_id"], (r["text"] or "")[:700], r["lang"]) for r in docs], "doc_id long, text string, lang string").repartition(5)
    for r in hyperdim.identify(short, dims).collect():
        v = vectors[r["doc_id"]] / np.linalg.norm(vectors[r["doc_id"]]) - mean
        cosines = [float(v @ (u - mean) / np.linalg.norm(v) / np.linalg.norm(u - mean)) for u in unit]
        assert r["held_out"] == out(r["doc_id"]) and r["lang_pred"] == names[int(np.argmax(cosines))]
        assert abs(r["score"] - max(0.0, max(cosines))) < 1e-9


def test_held_out_languages_are_found(spark):
    got = queries.op12_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, ok = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and ok / n > 0.98
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_languages_of_odd_rows(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(8)] + [(i, "der schnelle braune fuchs springt über den faulen hund", "de") for i in range(8, 16)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "12 !? 34", "en"), (23, "the dog", None), (None, "xyz xyz", "xx"), (24, "́", "en"), (25, "the fox " * 60_000, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("key", "found", "score", "held_out", "salt", "sums", "lang_pred")})
    got = {r["doc_id"]: r for r in hyperdim.identify(t).collect()}
    assert all(got[i]["lang_pred"] == "en" for i in range(8)) and all(got[i]["lang_pred"] == "de" for i in range(8, 16))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (20, 21, 22, 24))
    assert got[23]["lang_pred"] == got[25]["lang_pred"] == "en" and got[None]["lang_pred"] in ("en", "de") and not got[None]["held_out"]
    assert hyperdim.identify(t.where("false")).count() == 0
    assert {r["lang_pred"] for r in hyperdim.identify(t.where("lang is null")).collect()} == {"und"}
    assert {r["lang_pred"] for r in hyperdim.identify(t.where("doc_id < 8 or doc_id = 23")).collect()} == {"en"}


def test_labels_and_ids_change_no_prediction(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    profiles = hyperdim.train(docs)
    a = docs.select("doc_id", hyperdim.predict(F.col("text"), profiles, docs).alias("x"))
    b = docs.select("doc_id", F.lit("zz").alias("lang"), "text").select("doc_id", hyperdim.predict(F.col("text"), profiles, docs).alias("x"))
    assert sorted(a.collect()) == sorted(b.repartition(3).collect())


# ---------------------------------------------------------------- conversations


def brute_repair(rows):
    """(counts, cost, audit, text) of one conversation after damage: left to right over all edits, by state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, kinds = set(), Counter(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        counts[kinds[-1]] += 1
    initials = [r[1][:1] for r in rows]
    counts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = sorted({r[0] for r in rows if r[0] is not None})
    counts["gaps"] = known[-1] - known[0] + 1 - len(known) if known else 0
    # states: "" nothing yet, s, u, a: the last role
    after = {"s": [""], "u": ["", "s", "a"], "a": ["u"]}
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if state in after[x]:
                        put(best, x, (cost + 2, audit + "I", (*out, f"{role}:")))
        return best

    for (_, role, text), kind in zip(rows, kinds):
        new, extra = {}, int(kind == "truncated")
        for state, (cost, audit, out) in inserted(best).items():
            put(new, state, (cost + 3, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            if state in after.get(role[:1], ()):
                put(new, role[:1], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
            for x, name in (("u", "user"), ("a", "assistant")):
                if state in after[x]:
                    put(new, x, (cost + 2 + extra, audit + "R", (*out, f"{name}:{text}")))
        best = new
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return counts, cost, audit, "\n".join(out)


def enumerated(initials, kinds, most=3):
    """The least (cost, audit) over every string of edits with few insertions."""
    found = []
    for edits in itertools.product("DKR", repeat=len(initials)):
        for spots in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(initials) + 1), k) for k in range(most + 1)):
            cost, audit, options = 2 * len(spots), "", [""]
            for i in range(len(initials) + 1):
                audit += "I" * spots.count(i)
                options = [o + x for o in options for x in ("".join(p) for p in itertools.product("ua", repeat=spots.count(i)))]
                if i == len(initials):
                    break
                e, k = edits[i], kinds[i]
                audit += e
                if e == "D":
                    cost += 3
                    continue
                cost += (0 if e == "K" else 2) + (k == 1) + (1000 if k == 2 else 0)
                options = [o + x for o in options for x in (initials[i] if e == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


def test_cells_hold_the_cheapest_repair():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 4)
        initials, kinds = [rng.choice("suax") for _ in range(n)], [rng.choice([0, 0, 1, 2]) for _ in range(n)]
        cell = dialogue.parsed([dialogue.leaf("suax".index(i) * 3 + k) for i, k in zip(initials, kinds)])
        assert min(x for x in (cell[0], cell[3]) if x) == enumerated(initials, kinds)


def test_cells_join_alike_wherever_they_split():
    rng = random.Random(4)
    for _ in range(60):
        leaves = [dialogue.leaf(rng.randrange(12)) for _ in range(rng.randint(2, 12))]
        whole = dialogue.parsed(leaves)
        for k in range(1, len(leaves)):
            assert dialogue.combine(dialogue.parsed(leaves[:k]), dialogue.parsed(leaves[k:])) == whole


def checked(rows, got):
    """``rows``: conv_id, turn, role, text after damage; ``got``: rows of the query by conversation."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    for conv, r in got.items():
        counts, cost, audit, text = brute_repair(by[conv]) if by[conv] else (Counter(), 0, "", "")
        assert [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] == [counts[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
        assert (r["cost"], r["audit"]) == (cost, audit) and r["repaired_sha256"] == sha(text), conv


def test_repair_query_is_brute_force(spark):
    for d in (D, "/root/testdata/sf0.01"):
        original = spark.read.parquet(f"{d}/conversations.parquet").collect()
        rows = []
        for conv, turn, role, text in original:
            way = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            if way:
                text = {1: "", 2: re.sub("[.!?]", "", text)}.get(way, text)
                rows += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
        got = {r["conv_id"]: r for r in queries.op13_conversation_repair(spark, d).collect()}
        assert set(got) == {r["conv_id"] for r in original}
        checked(rows, got)


def test_repair_of_odd_rows_in_small_blocks(spark):
    rng = random.Random(8)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "x"), (1, None, "assistant", "y."), (2, 1, "", " \t"), (3, 5, "tool", "t." + "z" * 300_000)]
    rows += [(9, rng.choice([None, i, i // 2]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["yes.", "no", "", None, f"text {i}."])) for i in range(700)]
    rows += [(10, 0, "user", "same.")] * 150
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("!") for c in ("place", "first", "head", "kind", "n", "step", "edit", "item", "cell", "block")})
    fixed = dialogue.repair(t, parts=6, block=8, fan=3)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.digests(fixed.turns).collect()}
    got = {r["conv_id"]: r.asDict() | {"repaired_sha256": hashes.get(r["conv_id"], sha(""))} for r in fixed.conversations.collect()}
    assert len(got) == 6
    checked([(c, n, " " if r is None else r, " " if x is None else x) for c, n, r, x in rows], got)
    assert dialogue.repair(t.where("false")).conversations.count() == 0 == dialogue.repair(t.where("false")).turns.count()


def test_damage_reads_nulls_as_spaces(spark):
    rows = [(c, n, None, None) for c in (None, 1) for n in [None, *range(40)]]
    got = dialogue.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = Counter()
    for c, n, _, _ in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if way:
            want[c, n, "user" if way == 4 else " ", "" if way == 1 else " "] += 2 if way == 3 else 1
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_conversation_repair"])
def test_queries_are_their_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    df = queries.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(x[c] for c in cols) for x in df.collect()) == sorted(r.fetchall())
