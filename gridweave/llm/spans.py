"""Matches of a regular expression with their places, in Spark's own functions.

``split`` gives what lies between the matches and ``regexp_extract_all`` the matches themselves; adding
up their lengths gives places in code points. Both search from left to right without overlap. The
expressions below match in linear time on Java's engine: possessive repeats, and look-behind that lets
a search begin at the start of a run only, which gives the same matches, since a later start in the
same run fails where the first does. Matches are gathered in blocks, so that time grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
BLOCK = 256


def none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def between(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (b, m, v): the text before each match since the last one, the match, and its ``group``."""
    parts = F.split(text, pattern, -1)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in (("m", 0), ("v", group or 0))]
    return F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("b"), *found)


def gathered(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """What ``step`` gives (the next state, a span) for each of ``items`` in turn, as an array of type ``kind``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))

    def one(acc: Column, x: Column) -> Column:
        after, span = step(acc, x)
        return F.struct(*(after[n].alias(n) for n in state), F.concat(acc["found"], F.array(span)).alias("found"), acc["done"].alias("done"))

    def block(acc: Column, b: Column) -> Column:
        begin = F.struct(*(acc[n].alias(n) for n in state), none(kind).alias("found"), acc["done"].alias("done"))
        return F.aggregate(b, begin, one, lambda a: F.struct(*(a[n].alias(n) for n in state), none(kind).alias("found"), F.concat(a["done"], F.array(a["found"])).alias("done")))

    start = F.struct(*(v.alias(n) for n, v in state.items()), none(kind).alias("found"), none(f"array<{kind}>").alias("done"))
    return F.aggregate(blocks, start, block, lambda a: F.flatten(a["done"]))


def matches(text: Column, pattern: str, kind: str, group: int | None = None) -> Column:
    """Array of (kind, start, end, value); value is the match, or its ``group``. Empty unless the text matches."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        return {"at": end}, F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["v"].alias("value"))

    return F.when(text.rlike(pattern), gathered(between(text, pattern, group), {"at": F.lit(0)}, SPAN, step)).otherwise(none())


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """(kind, start, end, value) by start, then by kind as listed, then by end."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def outside(new: Column, old: Column) -> Column:
    """Those of ``new`` that overlap none of ``old``."""
    return F.filter(new, lambda n: ~F.exists(old, lambda o: overlap(n, o)))
