"""Secrets: base patterns, and strings whose characters are too evenly spread.

Everything runs as DataFrame expressions.  Candidate strings are long runs of
key-like characters with a digit and a letter.  Each belongs to a character
class; a window slides over it, the counts of its characters are kept up to
date as one enters and one leaves, and the greatest Shannon entropy of a window
is held against the class's threshold.  Known harmless shapes are let pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, spans

KINDS = ("assign", "access", "hex")
#: Fixed by the contract.  A maximal run of hex digits is a match anyway, so only runs of 32 or more are looked at.
PATTERNS = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{32,}+",
}
BEFORE_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
NEEDS = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}"}
#: Characters of a candidate string at least, and of the window: in fewer characters chance alone makes few repeats.
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Character classes in the order in which they are tried: (name, shape, alphabet, least bits of a window).
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdef", 3.0),
    ("alnum", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 3.4),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
#: A string of letters or of digits alone is a word or a number, however even; such parts are not scored.
MIXED = ("[0-9]", "[A-Za-z]")
#: Harmless candidates as a whole: UUIDs, and words joined by - or _ or / with short numbers at the end.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]*+(?:[/_=-]++[A-Za-z]*+)++(?:[0-9]{1,8}+(?:[/_=-]++[0-9]{1,8}+)*+)?+$",
)
#: Harmless parts of a candidate: placeholders and sequences with up to 32 characters on either side that no separator cuts off, and runs of one character.
#: What is left on either side of a part is scored on its own, so a part never hides what is far from it.
ALLOWED_PART = r"(?i)[^/_=-]{0,32}(?:example|sample|dummy|placeholder|changeme|xxxx|your[_-]|abcdefghij|0123456789|1234567890)[^/_=-]{0,32}|(.)\1{7,}+"


def _assign(v: Column) -> Column:
    return F.length(F.regexp_replace(v, BEFORE_VALUE, "")) >= 8


TESTS = {"assign": _assign, "access": lambda v: F.length(v) >= 16, "hex": None}


def base_spans(text: Column) -> Column:
    every = [F.when(text.rlike(NEEDS[k]), spans.matches(text, PATTERNS[k], k, i, TESTS[k])).otherwise(spans.none()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*every))


def window_entropy(v: Column, alphabet: str, window: int) -> Column:
    """The greatest entropy in bits of window consecutive characters of v, 0 if it is shorter.

    counts holds how often each character of the alphabet is in the window, and
    s the sum of c log2 c over them; the entropy is log2(window) - s / window.
    The string is split into characters once, so the work is linear in its length.
    """
    gain = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(window + 1)])
    at = lambda a, i: F.element_at(a, i)

    def over(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = at(places, i)
            leaves = F.when(i > window, at(places, F.greatest(i - window, F.lit(1)))).otherwise(0)

            def moved(p: Column) -> Column:
                # leave first, so that no count passes the window
                less = F.when(p["o"] > 0, F.transform(acc["counts"], lambda c, j: c - F.when(j == p["o"] - 1, 1).otherwise(0))).otherwise(acc["counts"])
                s = acc["s"] - F.when(p["o"] > 0, at(gain, F.when(p["o"] > 0, at(acc["counts"], F.greatest(p["o"], F.lit(1)))).otherwise(1))).otherwise(0.0)

                def entered(q: Column) -> Column:
                    total = q["s"] + at(gain, at(q["less"], p["i"]) + 1)
                    counts = F.transform(q["less"], lambda c, j: c + F.when(j == p["i"] - 1, 1).otherwise(0))
                    return F.struct(counts.alias("counts"), total.alias("s"), F.when(i >= window, F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"]).alias("best"))

                return spans.let(F.struct(less.alias("less"), s.alias("s")), entered)

            return spans.let(F.struct(enters.alias("i"), leaves.alias("o")), moved)

        start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda acc: acc["best"])

    places = F.transform(F.split(v, ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.when(F.length(v) >= window, spans.let(places, over)).otherwise(0.0)


def too_even(v: Column) -> Column:
    """Whether a candidate string has a part with a window above its class's threshold, and no harmless shape."""

    def part(x: Column) -> Column:
        by_class = None
        for name, shape, alphabet, bits in CLASSES:
            over = window_entropy(F.lower(x) if name == "hex" else x, alphabet, LEAST) >= bits
            by_class = F.when(x.rlike(shape), over) if by_class is None else by_class.when(x.rlike(shape), over)
        mixed = F.length(x) >= LEAST
        for m in MIXED:
            mixed = mixed & x.rlike(m)
        return F.when(mixed, by_class.otherwise(False)).otherwise(False)

    harmless = v.rlike(ALLOWED[0])
    for shape in ALLOWED[1:]:
        harmless = harmless | v.rlike(shape)
    return F.when(harmless, False).otherwise(F.exists(F.split(F.regexp_replace(v, ALLOWED_PART, " "), " "), part))


def all_spans(text: Column) -> Column:
    """struct(base, spans): base spans, and with them the strings of high entropy that no base span touches."""

    def both(base: Column) -> Column:
        more = F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), spans.matches(text, CANDIDATE, "entropy", len(KINDS), too_even)).otherwise(spans.none())
        more = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    return spans.let(base_spans(text), both)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row of docs; null and empty texts have none, repeated rows are found each.

    Spans are in order of start, then kind; an entropy span that a base span touches is left out.  Other columns are ignored.
    """
    found = docs.select(F.col(doc_id), all_spans(F.coalesce(text, F.lit(""))).alias("_found"))
    return found.select(doc_id, "_found.base", "_found.spans")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = shared.documents(spark, sf_dir)

    def shown(f: Column) -> Column:
        return F.struct(*[spans.count(f["base"], k).alias(f"n_{k}") for k in KINDS], spans.digest(f["base"]).alias("base_sha256"), spans.joined(f["spans"]).alias("spans"))

    return docs.select("doc_id", spans.let(all_spans(F.coalesce("text", F.lit(""))), shown).alias("x")).select("doc_id", "x.*")
