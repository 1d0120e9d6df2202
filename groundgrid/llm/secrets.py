"""Secret scans (10): patterns of known secrets, and windows of high entropy.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, scan

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group whose length counts, least length. The runs of two patterns are bounded
#: from below in the pattern itself, which leaves the matches of that length as they are.
BASE = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16)]
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kind, characters of the class, window (also the least length of a candidate), least bits of entropy a character.
CLASSES = [
    ("entropy_hex", _DIGITS + "abcdefABCDEF", 20, 3.0),
    ("entropy_upper", _UPPER + _DIGITS, 20, 3.4),
    ("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_=-", 20, 3.8),
]
#: A candidate that one of these finds is no secret: one kind of letters only, digits only, UUIDs.
ALLOW = [r"^[a-z_=/+-]+$", r"^[A-Z_=/+-]+$", r"^[A-Za-z][a-z_=/+-]+$", r"^[0-9=/+_-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"]
#: Counting sequences and marked examples, in either case: they part a candidate, and the rest of it is judged by itself.
WORDS = ["abcdefghij", "0123456789", "placeholder", "example", "xxxxxx"]
#: Windows begin in stretches of this many characters.
STRETCH = 256
#: Counts of five bits (windows have at most 31 characters) in a long.
PACKED = 12
SPAN = "struct<start:int,end:int,kind:int>"
KINDS = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """(start, text) of all leftmost non-overlapping matches whose group has that length: the
    pieces between the matches, from a split by the same pattern, give their places."""
    whole, part, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    found = "struct<start:int,text:string>"

    def step(at, r):
        start = at + F.char_length(r["gap"])
        hit = F.when(F.char_length(r["g"]) >= least, F.array(F.struct(start.alias("start"), r["m"].alias("text")))).otherwise(F.array().cast(f"array<{found}>"))
        return start + F.char_length(r["m"]), hit

    return F.when(text.rlike(pattern), scan(rows, F.lit(0), found, step)).otherwise(F.array().cast(f"array<{found}>"))


def _bits(count: Column, width: int) -> Column:
    """count * log2(count) for counts up to width, from a table."""
    return F.get(F.array(*[F.lit(float(n * math.log2(n)) if n else 0.0) for n in range(width + 2)]), count.cast("int"))


def _joined(spans: Column, start: Column, end: Column, kind: int) -> Column:
    """Ordered spans and one more that begins no earlier: joined with the last where they overlap."""
    new = lambda at: F.array(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind")))
    last = F.try_element_at(spans, F.lit(-1))
    return F.when(F.coalesce(last["end"] >= start, F.lit(False)), F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), new(last["start"]))).otherwise(F.concat(spans, new(start)))


def _windows(found: Column, kind: int, alphabet: str, width: int, least: float) -> Column:
    """Spans of a candidate (start, text) that windows of that entropy cover, overlapping ones merged.

    The candidate is cut into stretches of bounded length, each with the width - 1 characters
    that follow, so that every window lies in one. In a stretch the state holds the count of
    each character of the class and the sum of count * log2(count); a step adjusts both by the
    character that leaves and the one that enters.
    """

    def stretches(chunks):
        following = lambda i: F.left(F.coalesce(F.get(chunks, i + 1), F.lit("")), F.lit(width - 1))
        return F.transform(chunks, lambda c, i: F.struct((found["start"] + i * STRETCH).alias("at"), F.concat(c, following(i)).alias("s")))

    def hot(stretch):
        codes = F.transform(F.slice(F.split(stretch["s"], ""), F.lit(1), F.char_length(stretch["s"])), lambda ch: F.instr(F.lit(alphabet), ch))
        return let(F.struct(stretch["at"].alias("at"), codes.alias("codes")), lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r["codes"])), begin, lambda state, i: step(r, state, i))["spans"])

    def count(state, code):
        return F.call_function("shiftright", F.get(state["counts"], (code / PACKED).cast("int")), (code % PACKED * 5).cast("int")).bitwiseAND(F.lit(31))

    def one(code, word):
        return F.when((code / PACKED).cast("int") == word, F.call_function("shiftleft", F.lit(1).cast("long"), (code % PACKED * 5).cast("int"))).otherwise(F.lit(0).cast("long"))

    def step(r, state, i):
        enters, leaves = F.get(r["codes"], i - 1), F.when(i > width, F.get(r["codes"], i - 1 - width)).otherwise(0)
        out = count(state, leaves)  # 0 for code 0, which no character has
        into = count(state, enters) - F.when(leaves == enters, 1).otherwise(0)
        total = state["sum"] - F.when(leaves > 0, _bits(out, width) - _bits(out - 1, width)).otherwise(0.0) + _bits(into + 1, width) - _bits(into, width)
        counts = F.transform(state["counts"], lambda c, word: c + one(enters, word) - F.when(leaves > 0, one(leaves, word)).otherwise(F.lit(0).cast("long")))
        is_hot = (i >= width) & (F.lit(math.log2(width)) - total / width >= least)
        spans = F.when(is_hot, _joined(state["spans"], r["at"] + i - width, r["at"] + i, kind)).otherwise(state["spans"])
        return F.struct(total.alias("sum"), counts.alias("counts"), spans.alias("spans"))

    begin = F.struct(F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0).cast("long"), len(alphabet) // PACKED + 1).alias("counts"), _none().alias("spans"))
    cut_up = let(F.regexp_extract_all(found["text"], F.lit(f".{{1,{STRETCH}}}"), F.lit(0)), stretches)
    return F.aggregate(F.flatten(F.transform(cut_up, hot)), _none(), lambda spans, s: _joined(spans, s["start"], s["end"], kind))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.char_length(m["text"])).alias("end"), F.lit(kind).alias("kind")))


def _marked(text: Column) -> Column:
    """The text with the known words blanked out, place by place."""
    for word in WORDS:
        text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
    return text


def _uncovered(both: Column) -> Column:
    """The added spans that no base span covers; one pass in order of start, base spans first, with the farthest end of a base span so far."""
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), (s["kind"] >= len(BASE)).alias("added"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(end, s):
        new = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.when(s["added"], end).otherwise(F.greatest(end, s["end"])), F.when(s["added"] & (s["end"] > end), new).otherwise(_none())

    return scan(ordered, F.lit(-1), SPAN, step)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, end, kind), code points, end exclusive,
    by start and then kind (an index into KINDS).

    base_spans: matches of the BASE patterns. spans: those, and what the entropy windows of
    CLASSES add in candidates (runs of the class's characters, WORDS left out) that ALLOW
    doesn't know, unless a base span covers it. No shuffle; whole texts, in time that grows with
    their length. Null and empty texts have no spans; repeated rows keep theirs each; columns of
    docs so named are replaced.
    """
    text, (plain,) = F.coalesce("text", F.lit("")), fresh(docs, "plain")
    base = F.flatten(F.array(*[_spans(_matches(text, p, g, n), k) for k, (_, p, g, n) in enumerate(BASE)]))
    allowed = F.lit("|".join(f"(?:{a})" for a in ALLOW))
    added = []
    for k, (_, alphabet, width, least) in enumerate(CLASSES, len(BASE)):
        found = F.filter(_matches(F.col(plain), f"[{alphabet}]{{{width},}}", 0, width), lambda m: ~F.rlike(m["text"], allowed))
        added.append(F.flatten(F.transform(found, lambda m: _windows(m, k, alphabet, width, least))))
    docs = docs.withColumn(plain, _marked(text)).withColumn("base_spans", F.array_sort(base)).withColumn("spans", F.flatten(F.array(*added)))
    both = F.array_sort(F.concat("base_spans", F.when(F.size("spans") > 0, _uncovered(F.concat("base_spans", "spans"))).otherwise(_none())))
    return docs.withColumn("spans", both).drop(plain)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
