"""Spans of pattern matches in texts, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, rank: int, kind: string, end: int, value: string, context: string>"


def none() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(values: Column, of: Callable[[Column], Column], step: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each element of an array of ints, of (a sum or the like) those before it, put together by step.

    Blocks keep the work well below the square of the length.
    """

    def run(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        whole = F.transform(blocks, lambda b: of(F.slice(a, b * block + 1, F.lit(block))))
        return let(whole, lambda w: let(F.transform(blocks, lambda b: of(F.slice(w, F.lit(1), b))), lambda starts: F.transform(a, lambda x, i: step(F.element_at(starts, F.floor(i / block).cast("int") + 1), of(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block))))))

    return F.when(F.size(values) > 0, let(values, run)).otherwise(F.expr("CAST(array() AS array<int>)"))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of ints, the sum of those before it."""
    return _before(sizes, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v), lambda a, b: a + b)


def most_before(values: Column) -> Column:
    """For each element of an array of ints, the greatest of those before it, 0 at least."""
    return _before(values, lambda x: F.coalesce(F.array_max(x), F.lit(0)), lambda a, b: F.greatest(a, b))


def matches(text: Column, pattern: Column | str, kind: str, rank: int, test: Callable[[Column], Column] | None = None, context: int = 0) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches that pass the test, in order, in code points.

    The pieces between matches tell where they are: a match begins after all
    pieces and matches before it.  context: that many code points of the pieces
    on both sides are kept too.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        n = F.size(found)
        before = F.slice(pieces, F.lit(1), n)
        rows = F.arrays_zip(before.alias("before"), found.alias("m"), F.slice(pieces, F.lit(2), n).alias("after"), sums_before(F.zip_with(before, found, lambda g, m: F.length(g) + F.length(m))).alias("at"))

        def one(x: Column) -> Column:
            start = x["at"] + F.length(x["before"])
            near = F.concat(F.right(x["before"], F.lit(context)), F.lit(" "), F.left(x["after"], F.lit(context))) if context else F.lit(None).cast("string")
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"), near.alias("context"))

        return F.when(n > 0, F.transform(F.filter(rows, lambda x: test(x["m"])) if test else rows, one)).otherwise(none())

    return let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, F.lit(-1)).alias("pieces")), place)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)


#: Code points in a block of a text that is cut in many places.
CUT = 4096


def redacted(text: Column, spans: Column, labels: dict[str, str]) -> Column:
    """text with each span, in order of start, in place of its label; a span that begins inside an earlier one is part of it.

    The text is cut into blocks once, so that each piece is found without going through what is before it.
    """
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])

    def build(x: Column) -> Column:
        blocks = x["blocks"]

        def between(a: Column, z: Column) -> Column:
            i, j = F.floor(a / CUT).cast("int"), F.floor(z / CUT).cast("int")
            part = lambda k, start, n: F.substring(F.coalesce(F.get(blocks, k), F.lit("")), start, n)
            return F.when(z <= a, "").when(i == j, part(i, a % CUT + 1, z - a)).otherwise(F.concat(part(i, a % CUT + 1, F.lit(CUT)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(1), z % CUT)))

        rows = F.arrays_zip(spans.alias("s"), most_before(F.transform(spans, lambda s: s["end"])).alias("at"))
        pieces = F.transform(rows, lambda r: F.when(r["s"]["start"] >= r["at"], F.concat(between(r["at"], r["s"]["start"]), F.element_at(names, r["s"]["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("blocks")), build))
