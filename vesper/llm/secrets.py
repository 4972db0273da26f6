"""Secret scans: key patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: those that are too short never match, which equals dropping them.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Pattern of the class, pattern of what it must hold, bits of entropy that some window must reach; the first class that fits counts.
CLASSES = (
    (r"^[0-9A-Fa-f]+$", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    (r"^[A-Za-z0-9]+$", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.6),
    (r"", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.8),
)
#: Parts (between slashes) that look random but aren't secret: UUIDs, dated or versioned names, samples, one character over and over.
ALLOWED = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|dummy|placeholder|redacted|^(\w)\1+$|^[a-z]++(?:[-_][a-z]++)*+[-_](?:19|20)[0-9]{2}[0-9-]*$|0123456789|abcdefgh"
_NAME = r"(?:[A-Z]++(?![a-z])|[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+)"
#: Parts that are plain words, as in paths: three letters or more, also Capitalised, inHumps, or joined by - and _. Possessive, as repeated groups recurse.
PLAIN = rf"^(?=.{{3}}){_NAME}(?:[-_]{_NAME})*+$"
MARK = "[SECRET]"

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"
#: Entries of a block of a running total, and the unit of entropy terms (whole numbers, so that sums never drift).
SCAN_BLOCK, UNIT = 256, 1 << 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: as a lambda's variable, it isn't part of the expressions that use it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op: Callable[[Column, Column], Column], block: int = SCAN_BLOCK) -> Column:
    """Running results of op over an array of ints (not empty), from 0.

    A fold that appends copies what it has, so each block of values is folded by itself, from the result of the
    blocks before it.
    """
    fold = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def joined_up(blocks: Column) -> Column:
        before = fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op)), F.lit(0))
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.slice(fold(b, F.get(at, i)), 2, F.size(b)))))

    return let(values, lambda v: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, block)), joined_up))


def _matches(text: Column, pattern: str, body: Callable[[Column, Column], Column], none: Column) -> Column:
    """body(matches, pieces between them) of the leftmost non-overlapping matches, or none."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(whole, lambda m: let(F.split(text, pattern, -1), lambda g: body(m, g)))).otherwise(none)


def _placed(m: Column, g: Column, kind: int, value: Callable[[Column], Column] = lambda x: x) -> Column:
    ends = running(F.zip_with(m, F.slice(g, 1, F.size(m)), lambda x, gap: F.length(x) + F.length(gap)), lambda a, b: a + b)
    span = lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value(x).alias("value"))
    return F.zip_with(m, ends, span).cast(_SPAN)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Start, end (code points), kind and value of each match; the pieces between the matches give the positions."""
    return _matches(text, pattern, lambda m, g: _placed(m, g, kind), F.array().cast(_SPAN))


def _assigned(text: Column, least: int = 12) -> Column:
    """Spans of assigned values, and the text with these spans blanked, of the same length."""
    value = lambda x: F.regexp_extract(x, ASSIGN, 2)

    def body(m: Column, g: Column) -> Column:
        blank = F.transform(m, lambda x: F.when(F.length(value(x)) >= least, F.repeat(F.lit(" "), F.length(x))).otherwise(x))
        rest = F.array_join(F.zip_with(g, F.concat(blank, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return F.struct(F.filter(_placed(m, g, 0, value), lambda x: F.length(x["value"]) >= least).alias("spans"), rest.alias("rest"))

    return _matches(text, ASSIGN, body, F.struct(F.array().cast(_SPAN).alias("spans"), text.alias("rest")))


def max_entropy(s: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """The highest Shannon entropy (bits) of the characters of any `window` consecutive characters of s; with `enough`,
    that of the first window that reaches it, if one does.

    The counts of the window's characters are carried along, twelve to a whole number. A step takes one character in
    and one out, and of the sum of c * log2(c) over the counts only the terms of those two change. A shorter string is
    one window.
    """
    if not 0 < window < 32:
        raise ValueError("a count has five bits")
    terms = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(window + 2)])
    term = lambda c: F.get(terms, c)

    def slid(codes: Column, n_words: Column) -> Column:
        n = F.size(codes)
        width = F.least(F.lit(window), n)

        def step(acc: Column, i: Column, goal: Column) -> Column:
            new, old, full = F.get(codes, i), F.get(codes, i - width), i >= width
            count = lambda x: F.call_function("shiftright", F.get(acc["counts"], x["word"]), x["bit"]).bitwiseAND(F.lit(31)).cast("int")
            one = lambda x, k: F.when(x["word"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])).otherwise(F.lit(0).cast("long"))
            counts = F.transform(acc["counts"], lambda c, k: c + one(new, k) - F.when(full, one(old, k)).otherwise(F.lit(0).cast("long")))
            s = acc["s"] + let(count(new), lambda c: term(c + 1) - term(c)) + F.when(full, let(count(old), lambda c: term(c - 1) - term(c))).otherwise(F.lit(0).cast("long"))
            moved = let(s, lambda s: F.struct(counts.alias("counts"), s.alias("s"), F.when(i >= width - 1, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least")))
            return F.when((acc["least"] <= goal) | F.coalesce(full & (old == new), F.lit(False)), acc).otherwise(moved)

        begin = F.struct(F.array_repeat(F.lit(0).cast("long"), n_words).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit((1 << 63) - 1).cast("long").alias("least"))
        goal = F.lit(-1).cast("long") if enough is None else F.floor((F.log2(width.cast("double")) - enough) * width * UNIT)
        least = let(goal, lambda g: F.aggregate(F.sequence(F.lit(0), n - 1), begin, lambda acc, i: step(acc, i, g))["least"])
        return F.log2(width.cast("double")) - least / UNIT / width

    def coded(chars: Column) -> Column:
        place = lambda k: F.struct(F.floor(k / 12).cast("int").alias("word"), (k % 12 * 5).cast("int").alias("bit"))
        return let(F.array_distinct(chars), lambda kinds: let(F.transform(chars, lambda c: place(F.array_position(kinds, c) - 1)), lambda codes: slid(codes, F.ceil(F.size(kinds) / 12).cast("int"))))

    return let(F.filter(F.split(s, ""), lambda c: c != ""), lambda chars: F.when(F.size(chars) > 0, coded(chars)).otherwise(0.0))


def _random(value: Column) -> Column:
    bits = None
    for shape, must, least in CLASSES:
        asked = F.when(value.rlike(must), F.lit(least))
        bits = F.when(value.rlike(shape), asked) if bits is None else bits.when(value.rlike(shape), asked)
    return let(bits, lambda b: b.isNotNull() & ~value.rlike(ALLOWED) & (max_entropy(value, enough=b) >= b))


def _secret_parts(candidate: Column) -> Column:
    """Spans of what is random in a candidate.

    Plain and allowed parts (between slashes) are blanked, and excuse nothing else. What is left in one piece is judged
    as a whole, and if that isn't random, part by part.
    """
    blank = lambda p: F.when(p.rlike(PLAIN) | p.rlike(ALLOWED), F.regexp_replace(p, ".", " ")).otherwise(p)
    left = F.array_join(F.transform(F.split(candidate["value"], "/", -1), blank), "/")
    left = F.replace(F.replace(left, F.lit(" /"), F.lit("  ")), F.lit("/ "), F.lit("  "))
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))

    def judged(run: Column) -> Column:
        parts = F.when(F.contains(run["value"], F.lit("/")), moved(_spans(run["value"], f"[^/]{{{WINDOW},}}", 3), run["start"])).otherwise(F.array().cast(_SPAN))
        found = F.filter(F.concat(F.array(run), parts), lambda p: _random(p["value"]))
        return F.when(F.get(found, 0) == run, F.array(run)).otherwise(found)

    return let(left, lambda x: moved(F.flatten(F.transform(_spans(x, f"[^ ]{{{WINDOW},}}", 3), judged)), candidate["start"]))


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns of docs), text and spans; columns of any name are safe in row.

    Candidates are sought outside assigned values. One that lies within an access or hex span is that span, as those
    are runs of a candidate's characters, so that a set difference of whole numbers removes it.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    held = held.withColumn("assigned", _assigned(F.col("text")))
    held = held.withColumn("base", F.concat("assigned.spans", _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2)))
    held = held.withColumn("more", _spans(F.col("assigned.rest"), CANDIDATE, 3))
    # length and start as one number; its hash is the exclusive or of both halves, which start and end would make collide
    place = lambda x: F.shiftleft((x["end"] - x["start"]).cast("long"), 32) + x["start"]
    random = F.array_except(F.transform(F.flatten(F.transform("more", _secret_parts)), place), F.transform("base", place))
    held = held.withColumn("more", F.when(F.size("more") > 0, random).otherwise(F.array().cast("array<long>")))
    start = lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    found = F.transform("more", lambda p: F.struct(start(p).alias("start"), F.lit(3).alias("kind"), (start(p) + F.shiftright(p, 32).cast("int")).alias("end")))
    ordered = F.sort_array(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))), found))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(ordered, lambda x: F.struct(F.get(kinds, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return held.select("row", "text", spans.alias("spans"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `spans` to docs: array of (kind, start, end), code points, end exclusive, by start and then kind.

    assign (a value of 12 or more after a key's name), access, hex, and entropy: candidate strings of 20 or more
    characters outside assigned values that are none of those, less their plain and allowed parts, some window of which is as random as its
    character class asks. Works on DataFrame functions alone, over the whole text, in time that is linear in it. Null or empty text: no
    spans. All other columns and all rows of docs stay; a column named spans is replaced. Empty table: no rows.
    """
    return _found(docs, text_col).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "spans"], "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """docs with each secret (overlapping spans are one) of text_col replaced by `mark`; null stays null."""
    text, spans = F.col("text"), F.col("spans")
    # four bytes a code point, so that a piece is found by its place; the mark of byte order in front keeps one that the text has
    piece = lambda wide, a, b: F.decode(F.concat(F.lit(bytes([0, 0, 0xFE, 0xFF])), F.substring(wide, a * 4 + 1, (b - a) * 4)), "UTF-32")

    def rebuilt(wide: Column, ends: Column) -> Column:
        done = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        kept = F.transform(spans, lambda x, i: let(done(i), lambda at: F.when(x["start"] >= at, F.concat(piece(wide, at, x["start"]), F.lit(mark))).otherwise("")))
        return F.concat(F.array_join(kept, ""), piece(wide, F.element_at(ends, -1), F.length(text)))

    done = let(F.encode(text, "UTF-32"), lambda wide: let(running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda ends: rebuilt(wide, ends)))
    clean = F.when(F.size("spans") > 0, done).otherwise(F.col(f"row.`{text_col}`")).alias(text_col)
    return _found(docs, text_col).select(*[clean if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the SHA-256 of the joined pattern spans, and all spans joined, for each document."""
    found = scan(docs.select(id_col, text_col), text_col)
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
