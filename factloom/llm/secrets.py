"""Secret scans in DataFrame operations only: fixed patterns and character Markov models.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a name such as token or
api_key, then = or :, then a value of 6 and more characters), ``access`` (AKIA and 16
or more of A-Z0-9) and ``hex`` (24 and more of 0-9a-f).  Positions are code points, ends exclusive.

Method.  Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: generated hexadecimal, base64 and
upper-case strings against the words and identifiers outside base spans in a bounded
sample of texts (``FIT_DOCS`` by the smallest id hash, each of at most ``FIT_CHARS``
characters).  Their log-ratio is a table of character pairs.  Every run of
``CANDIDATE`` characters that no base span touches is scored, with or without digits; if the
likelihood ratio is over ``e ** ODDS`` in favour of random, it becomes a span of kind
``markov``.  Base spans always stay.

Cost: a text is read a fixed number of times; offsets are running sums in blocks of the
root of their number (``_running``), and a candidate is folded over once, so neither a
very long run nor very many spans cost the square of their size.

Edge cases: null texts are empty; null ids are passed through; repeated rows are
scanned separately; an empty table trains the ordinary model on nothing (uniform) and
gives no rows; other columns, whatever they are called, are never read (``redact`` returns them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}"
FIT_DOCS, FIT_CHARS, FIT_STRINGS, ODDS, BACKING = 1500, 20_000, 1500, 12.0, 5.0
#: Code points of one segment of a text that is redacted.
SEGMENT = 4096
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero: int, combine) -> Column:
    """For each of the integers, all before it combined (``zero`` for the first)."""
    fold = lambda xs: F.aggregate(xs, F.lit(zero), combine)

    def over(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs).cast("double")))).cast("int")
        starts = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs)), w), lambda i: i <= F.size(xs))
        return _let(_let(width, lambda w: F.transform(starts(w), lambda i: F.slice(xs, i, w))), inside)

    def inside(blocks: Column) -> Column:
        def block(totals: Column):
            return lambda x, i: _let(fold(F.slice(totals, F.lit(1), i)), lambda base: F.transform(x, lambda v, j: combine(base, fold(F.slice(x, F.lit(1), j)))))

        return _let(F.transform(blocks, fold), lambda totals: F.flatten(F.transform(blocks, block(totals))))

    return _let(values, over)


def _located(found: Column, pieces: Column, good, kind: int) -> Column:
    """Spans of the matches whose place is given by the pieces between them."""
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("hit"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["hit"]["hit"]).alias("own"), x["hit"].alias("hit")))

    def spans(rows: Column) -> Column:
        before = _running(F.transform(rows, lambda x: x["gap"] + x["own"]), 0, lambda a, b: a + b)
        placed = F.zip_with(rows, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["own"]).alias("end"), x["hit"].alias("hit")))
        return F.transform(F.filter(placed, lambda x: good(x["hit"])), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(F.size(found) > 0, _let(sizes, spans)).otherwise(F.array().cast(_SPANS))


def _pairs(*columns: Column) -> Column:
    return F.arrays_zip(*columns)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the base spans by start, then kind (as numbered in ``KINDS``)."""
    text = F.col("text")
    found = docs.withColumns({
        "_a": F.regexp_extract_all(text, F.lit(ASSIGN), 0),
        "_k": F.regexp_extract_all(text, F.lit(ACCESS), 0),
        "_x": F.regexp_extract_all(text, F.lit(HEX), 0),
    })
    always = lambda hit: F.lit(True)
    long_value = lambda hit: F.length(hit["value"]) >= 6
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    located = F.array_sort(F.concat(
        _located(_pairs(F.col("_a").alias("hit"), values.alias("value")), F.split(text, ASSIGN), long_value, 0),
        _located(_pairs(F.col("_k").alias("hit")), F.split(text, ACCESS), always, 1),
        _located(_pairs(F.col("_x").alias("hit")), F.split(text, HEX), always, 2),
    ))
    # texts without any match never reach the splits
    some = (F.size("_a") > 0) | (F.size("_k") > 0) | (F.size("_x") > 0)
    return found.withColumn("base", F.when(some, located).otherwise(F.array().cast(_SPANS))).drop("_a", "_k", "_x")


def _bigrams(words: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters (at most the square of the ASCII set)."""
    cut = words.select(F.explode(F.expr("transform(sequence(2, length(w)), i -> substr(w, i - 1, 2))")).alias("g"))
    return {r["g"]: r["n"] for r in cut.groupBy("g").agg(F.count("*").alias("n")).collect()}


def _table(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """Log-ratio of the two models for each pair of ASCII codes, at 128 * first + second."""
    letters = [c for c in map(chr, range(128)) if c.isalnum() or c in "+/_-"]

    def rows(counts: dict[str, int]) -> dict[str, float]:
        """Log-probabilities of the second character, backed by how often it occurs at all."""
        second = {b: 1 + sum(counts.get(a + b, 0) for a in letters) for b in letters}
        total = sum(second.values())
        out = {}
        for a in letters:
            n = sum(counts.get(a + b, 0) for b in letters)
            for b in letters:
                out[a + b] = math.log((counts.get(a + b, 0) + BACKING * second[b] / total) / (n + BACKING))
        return out

    r, o = rows(random), rows(ordinary)
    out = [0.0] * (128 * 128)
    for a in letters:
        for b in letters:
            out[128 * ord(a) + ord(b)] = round(r[a + b] - o[a + b], 4)
    return out


def fit(docs: DataFrame, strings: int = FIT_STRINGS, rows: int = FIT_DOCS, max_chars: int = FIT_CHARS) -> list[float]:
    """Train both models from a bounded sample; the result is one table of 16,384 numbers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = spark.range(strings).select(F.explode(F.array(digest, b64, F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))).alias("w"))
    n = docs.count()
    cut = int(2**62 * min(1.0, rows / max(n, 1)))
    texts = docs.where((F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1)) < cut) & (F.length("text") <= max_chars))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), 0)).alias("w"))
    return _table(_bigrams(made), _bigrams(ordinary))


def scan(docs: DataFrame, table: list[float], odds: float = ODDS) -> DataFrame:
    """Adds ``base`` and ``found`` (all spans by start, then kind) to rows with a non-null ``text``."""
    spotted = base_spans(docs).withColumn("_c", F.regexp_extract_all("text", F.lit(CANDIDATE), 0))
    ratios = F.expr("cast(split('" + ",".join(f"{v:g}" for v in table) + "', ',') as array<double>)")

    def ratio(word: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(acc: Column, c: Column) -> Column:
            more = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(ratios, acc["last"] * 128 + F.ascii(c)))
            return F.struct(F.ascii(c).alias("last"), (acc["sum"] + more).alias("sum"))

        return F.aggregate(F.split(word, ""), start, step)["sum"]

    marked = _located(_pairs(F.col("_c").alias("hit")), F.split("text", CANDIDATE), lambda hit: ratio(hit["hit"]) > odds, 3)
    spotted = spotted.withColumn("_m", marked)
    # a candidate is apart from base spans if none before it reaches into it and none after it starts in it
    ends = lambda rows: F.transform(rows, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0)))
    starts = lambda rows: F.transform(rows, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(2**31 - 1)))

    def apart(rows: Column) -> Column:
        before = _running(ends(rows), 0, lambda a, b: F.greatest(a, b))
        after = F.reverse(_running(F.reverse(starts(rows)), 2**31 - 1, lambda a, b: F.least(a, b)))
        zipped = F.arrays_zip(rows.alias("span"), before.alias("before"), after.alias("after"))
        kept = F.filter(zipped, lambda x: (x["span"]["kind"] < 3) | ((x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"])))
        return F.transform(kept, lambda x: x["span"])

    all_ = F.array_sort(F.concat("base", "_m"))
    found = F.when(F.size("_m") == 0, F.col("base")).when(F.size("base") == 0, F.col("_m")).otherwise(_let(all_, apart))
    return spotted.withColumn("found", found).drop("_c", "_m")


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, table: list[float], odds: float = ODDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(plain, table, odds).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"),
    )


def redact(docs: DataFrame, table: list[float], mask: str = "[SECRET]", odds: float = ODDS) -> DataFrame:
    """All columns of ``docs``, secrets in ``text`` replaced by ``mask`` (overlapping spans by one); n_chars follows."""
    known = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = scan(known, table, odds)

    def cut(segments: Column):
        """The text from one place to another, from the segments that it touches."""

        def gap(at: Column, to: Column) -> Column:
            part = lambda k: F.substring(F.get(segments, k), F.greatest(at - k * SEGMENT, F.lit(0)) + 1, F.least(to - k * SEGMENT, F.lit(SEGMENT)) - F.greatest(at - k * SEGMENT, F.lit(0)))
            touched = F.sequence(F.floor(at / SEGMENT).cast("int"), F.floor((to - 1) / SEGMENT).cast("int"))
            return F.when(to > at, F.array_join(F.transform(touched, part), "")).otherwise("")

        return gap

    def masked(segments: Column) -> Column:
        gap = cut(segments)
        reached = _running(F.transform("found", lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        fresh = F.filter(F.arrays_zip(F.col("found").alias("span"), reached.alias("at")), lambda x: x["span"]["start"] >= x["at"])
        last = gap(F.array_max(F.transform("found", lambda s: s["end"])), F.length("text"))
        return F.array_join(F.concat(F.transform(fresh, lambda x: gap(x["at"], x["span"]["start"])), F.array(last)), mask)

    whole = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SEGMENT}}}"), 0)
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(_let(whole, masked))
    doc = F.col("doc").withField("text", F.when(F.col("doc.text").isNotNull(), F.col("clear")))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.size("found") > 0, F.length("clear").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars")))
    return scanned.withColumn("clear", text).select(doc.alias("doc")).select("doc.*")
