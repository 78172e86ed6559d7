"""Personal data: base patterns, and identifiers discovered by bootstrapped contexts.

DataFrame functions only: no Python code runs on the executors.

Base spans (leftmost, non-overlapping, per kind): e-mail addresses, IPv4 addresses with parts up
to 255, card numbers of 13 to 19 digits that pass Luhn's check, international phone numbers of 9
to 15 digits. The places of matches come from the text between them: splitting at a pattern
gives the gaps, extracting it the matches, and running sums of their lengths the starts.

Bootstrapping (after Riloff and Jones, Learning Dictionaries for Information Extraction by
Multi-Level Bootstrapping, 1999; Agichtein and Gravano, Snowball, 2000): seeds are the base spans
and, as a kind of their own, secrets: lower-case hexadecimal digests of 32, 40 or 64 digits. The one
to three words before a span, the one and two after it, and the words on both sides are its lexical
patterns. All identifier-like tokens (6 or more letters, digits and ``._@+-``, a digit among them)
are candidate instances with the same kinds of patterns. Rounds over the graph of patterns and
instances: a pattern's confidence for a kind is the share of its distinct instances that are of the
kind, weighted by their scores and smoothed; an instance's score is the chance that one of its
patterns is right. Candidates in a pattern with confidence of at least ``min_confidence`` and
``min_support`` sure instances become spans of its kind, unless they overlap a span of a seed.

Defined cases: null texts count as empty; documents without spans have zero counts and empty
lists; rows that repeat both id and text get the same result each; null ids keep their rows;
very long texts are read whole, their matches numbered by a window over the document's matches;
of patterns that hold for a candidate the one with the largest confidence decides its kind, in a tie
the kind that comes last by name; words of a pattern may have any length (long ones are hashed); an
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import own_columns, written

KINDS = ("email", "ip", "card", "phone")
#: base kinds, and those that only seeds and contexts find
ALL_KINDS = (*KINDS, "secret")
# possessive where the pattern can't need what it gives up; starts only where a run starts or a
# match has just ended, as a match from inside a run would have been found from its start
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])",
    "candidate": r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{6,}+",
}
#: pieces of text between spaces that words of a context are looked for in; a longer word is hashed
PIECES, WORD = 12, 48


def _gate(kind: str, text: Column) -> Column:
    """Cheap tests that every text with a match passes."""
    return {
        "email": text.contains("@"),
        "ip": text.contains(".") & text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9]"),
        "phone": text.contains("+"),
        "secret": text.rlike("[0-9a-f]{32}"),
        "candidate": text.rlike("[0-9]"),
    }[kind]


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    add = lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[a-f]"))
        .otherwise(True)
    )


def _words(gap: Column, side: int) -> Column:
    """The last (side -1) or first (1) three words of the text between two matches, lower-cased, digits as 0."""
    flat = F.translate(gap, "\t\n\r\x0b\x0c", "     ")
    near = F.substring_index(F.rtrim(flat) if side < 0 else F.ltrim(flat), " ", side * PIECES)
    short = F.transform(F.filter(F.split(near, " "), lambda w: w != ""), lambda w: F.when(F.char_length(w) > WORD, F.md5(w)).otherwise(F.regexp_replace(F.lower(w), "[0-9]", "0")))
    return F.slice(F.reverse(short) if side < 0 else short, 1, 3)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(id, text_key, kind, start, end, value, left, right): every valid match, places in code points;
    left and right: up to three words, nearest first."""
    src = keyed(docs, id_col, text_col)

    def found(kind: str) -> Column:
        gaps = F.transform(F.split("text", PATTERNS[kind], -1), lambda g: F.struct(F.char_length(g).alias("n"), _words(g, -1).alias("left"), _words(g, 1).alias("right")))
        matches = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(_gate(kind, F.col("text")), F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), matches.alias("matches")))

    by_kind = src.select("id", "text_key", F.explode(F.array(*[found(k) for k in kinds])).alias("f")).where("size(f.matches) > 0")
    n = F.size("f.matches")
    pieces = by_kind.select("id", "text_key", "f.kind", F.posexplode(F.arrays_zip(F.slice("f.gaps", F.lit(1), n).alias("gap"), F.slice("f.gaps", F.lit(2), n).alias("next"), F.col("f.matches").alias("value"))).alias("i", "p"))
    rows = pieces.select("id", "text_key", "kind", "i", F.col("p.gap.n").alias("gap"), F.col("p.gap.left").alias("left"), F.col("p.next.right").alias("right"), F.col("p.value").alias("value"))
    rows = rows.dropDuplicates(["id", "text_key", "kind", "i"])
    run = Window.partitionBy("id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(run)
    placed = rows.select("id", "text_key", "kind", "value", "left", "right", end.cast("long").alias("end"))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("id", "text_key", "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value", "left", "right")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return own_columns(docs, id=docs[id_col].cast("long"), text=text, text_key=F.xxhash64(text))


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a span: words before it, after it, and on both sides."""
    l, r = (lambda i: F.get(left, i)), (lambda i: F.get(right, i))
    made = [
        F.concat(F.lit("<1 "), l(0)), F.concat(F.lit("<2 "), l(1), F.lit(" "), l(0)), F.concat(F.lit("<3 "), l(2), F.lit(" "), l(1), F.lit(" "), l(0)),
        F.concat(F.lit(">1 "), r(0)), F.concat(F.lit(">2 "), r(0), F.lit(" "), r(1)), F.concat(F.lit("<> "), l(0), F.lit(" "), r(0)),
    ]
    return F.array_compact(F.array(*made))


def bootstrap(seeds: DataFrame, candidates: DataFrame, rounds: int = 3, min_confidence: float = 0.8, min_support: int = 5) -> DataFrame:
    """(pattern, kind, confidence, support) of the patterns that hold after ``rounds`` rounds.

    ``seeds``: (kind, value, left, right); ``candidates``: (value, left, right).
    """
    occurrences = seeds.select("kind", "value", "left", "right").unionByName(candidates.select(F.lit(None).cast("string").alias("kind"), "value", "left", "right"))
    edges = written(occurrences.select("kind", "value", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern")).distinct(), "pii-edges")
    # a pattern without enough instances can't hold, nor one without a sure instance
    of_pattern = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"), F.count("kind").alias("sure"))
    of_pattern = written(of_pattern.where((F.col("n") >= min_support) & (F.col("sure") > 0)).drop("sure"), "pii-patterns")
    live = written(edges.join(of_pattern, "pattern"), "pii-live")
    sure = live.where("kind is not null").select("kind", "value", F.lit(1.0).alias("score")).distinct()
    scores = written(sure, "pii-scores-0")
    held = None
    for i in range(1, rounds + 1):
        known = live.select("pattern", "value", "n").distinct().join(scores, "value")
        held = known.groupBy("pattern", "kind").agg(F.round(F.sum("score") / (F.max("n") + 1.0), 9).alias("confidence"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("support"))
        held = written(held.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence / 2)), f"pii-held-{i}")
        guess = live.where("kind is null").select("pattern", "value").distinct().join(held, "pattern")
        guess = guess.groupBy("kind", "value").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))), 9).alias("score"))
        scores = written(sure.unionByName(guess.join(sure.select("value"), "value", "left_anti")), f"pii-scores-{i}")
    return held.where(F.col("confidence") >= min_confidence)


def _by_place(rows: DataFrame, width: int = 256) -> DataFrame:
    """Each span once for each stretch of ``width`` characters that it touches."""
    place = lambda c: F.floor(c / width).cast("long")
    return rows.withColumn("stretch", F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1))))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text_key, kind, start, end, value, base, added): base spans, secrets that are seeds, and
    those that contexts add."""
    every = written(spans(docs, id_col, text_col, (*ALL_KINDS, "candidate")), "pii-spans")
    known = every.where("kind <> 'candidate'")
    lone = every.where("kind = 'candidate'")
    held = bootstrap(known, lone, **how)
    # the best pattern of a candidate decides its kind
    best = lone.select("id", "text_key", "start", "end", "value", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern")).join(held, "pattern")
    best = best.groupBy("id", "text_key", "start", "end", "value").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    # spans that overlap share a stretch of text
    b, c = _by_place(known).alias("b"), _by_place(best).alias("c")
    meet = (F.col("b.text_key") == F.col("c.text_key")) & (F.col("b.stretch") == F.col("c.stretch")) & F.col("b.id").eqNullSafe(F.col("c.id"))
    clash = c.join(b, meet & (F.col("b.start") < F.col("c.end")) & (F.col("c.start") < F.col("b.end")), "left_semi").select("id", "text_key", "start", "end").distinct().alias("x")
    same = (F.col("x.text_key") == F.col("y.text_key")) & (F.col("x.start") == F.col("y.start")) & (F.col("x.end") == F.col("y.end")) & F.col("x.id").eqNullSafe(F.col("y.id"))
    added = best.alias("y").join(clash, same, "left_anti").select("id", "text_key", F.col("best.kind").alias("kind"), "start", "end", "value", F.lit(False).alias("base"), F.lit(True).alias("added"))
    return known.select("id", "text_key", "kind", "start", "end", "value", (F.col("kind") != "secret").alias("base"), F.lit(False).alias("added")).unionByName(added)


def _joined(of: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(of), lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in ALL_KINDS]), s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts per kind, digest of the base spans, all spans,
    the number of all spans, of secrets, and of those that contexts added."""
    found = extract(docs, id_col, text_col, **how)
    number = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind")).cast("int")
    place = F.struct(number.alias("k"), "start", "end")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    more = [F.count("*").alias("n_spans"), F.count_if(F.col("kind") == "secret").alias("n_secret"), F.count_if(F.col("added")).alias("n_added")]
    per = found.groupBy("id", "text_key").agg(*counts, *more, F.collect_list(F.when(F.col("base"), place)).alias("b"), F.collect_list(place).alias("a"))
    longs = [*[f"n_{k}" for k in KINDS], "n_spans", "n_secret", "n_added"]
    # written, so that the join shuffles both sides and AQE can split repeated rows
    per = written(per.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), *longs, _joined(F.col("b")).alias("_base"), _joined(F.col("a")).alias("_all")), "pii-documents")
    rows = keyed(docs, id_col, text_col).select("id", "text_key")
    out = rows.join(per, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(F.col("id").alias("doc_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs[:4]], F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs[4:]])
