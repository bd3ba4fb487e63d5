"""Regex matches with their places, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of this many matches are added up one by one; before them whole strips are.
STRIP = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def split_matches(text: Column, pattern: str, **groups: int) -> Column:
    """Struct of the matches `m`, leftmost and non-overlapping, the stretches `g` around them, one more, and named groups; null without a match."""
    parts = {"m": 0} | groups
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(n)).alias(name) for name, n in parts.items()]
    return F.when(text.rlike(pattern), F.struct(F.split(text, pattern, -1).alias("g"), *found))


def with_starts(found: Column, each: Callable[[Column, Column, Column], Column]) -> Column:
    """`each(found, position among the matches, start in characters)` for every match.

    Lengths are summed by strips first, so a text with very many matches takes
    up to STRIP steps for each of them, not as many as it has.
    """

    def placed(f: Column) -> Column:
        widths = F.transform(f["m"], lambda x, i: F.length(x) + F.length(F.get(f["g"], i)))

        def by_strip(w: Column) -> Column:
            strips = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STRIP).cast("int")), lambda b: total(F.slice(w, b * STRIP + 1, F.lit(STRIP))))
            before = F.aggregate(strips, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

            def start(b: Column, i: Column) -> Column:
                s = F.floor(i / STRIP).cast("int")
                return F.get(b, s) + total(F.slice(w, s * STRIP + 1, i - s * STRIP)) + F.length(F.get(f["g"], i))

            return let(before, lambda b: F.transform(f["m"], lambda x, i: each(f, i, start(b, i))))

        return let(widths, by_strip)

    return let(found, placed)

