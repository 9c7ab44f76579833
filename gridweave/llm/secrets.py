"""Operator 6 [native]: secrets by patterns, and by sliding-window entropy of candidate strings.

Three base patterns find assigned values, access keys and long hexadecimal strings. Beyond these, every
unbroken run of letters, digits, ``+`` and ``-`` is looked at (``/``, ``=`` and ``_`` join words and names to
values, so runs end there), less what base spans cover; what is left and has WINDOW characters or more is a
candidate. It belongs to a character class (hex: one case of hexadecimal digits; mixed: lower case, upper case
and digits; plain: letters of one case and digits), and a window of WINDOW characters slides along it: the count
of each character and the sum of c log2 c are updated by the character that enters and the one that leaves, and
the window's Shannon entropy is log2(WINDOW) less that sum over WINDOW. A candidate whose highest entropy reaches
its class's threshold becomes a span of kind ``entropy``, unless an allow-list pattern matches that candidate.

Defined results: a null or empty text has no spans; a very long candidate takes time in proportion to
its length; repeated rows are reported each; an empty table gives no row; extra columns are carried whatever
their names and those named like a result replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm import spans
from gridweave.llm.shared import back, renamed, text_or_empty


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = f"{any_case('password')}|{any_case('passwd')}|{any_case('secret')}|{any_case('token')}|{any_case('api')}_?{any_case('key')}"
ASSIGN = rf"""({KEYS})["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+-])[A-Za-z0-9+-]{{{WINDOW},}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-"
#: Least entropy in bits of a window, by class.
THRESHOLDS = {"hex": 3.05, "mixed": 3.75, "plain": 3.55}
#: Strings that look random and are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your-",
    r"0123456789abcdef|abcdefghijklmnop|ABCDEFGHIJKLMNOP",
    r"^[0-9+-]+$",
)


def base_spans(text: Column) -> Column:
    assign = F.filter(spans.matches(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= 8)
    return F.concat(assign, spans.matches(text, ACCESS, "access"), spans.matches(text, HEX, "hex"))


def char_class(value: Column) -> Column:
    digit, lower, upper = value.rlike("[0-9]"), value.rlike("[a-z]"), value.rlike("[A-Z]")
    return (
        F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & (lower | upper), "hex")
        .when(digit & lower & upper, "mixed")
        .when(digit & (lower | upper), "plain")
    )


def top_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of the windows of ``value``, by incremental counts."""
    at = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    weight = F.array(*(F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(window + 2)))
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    state = F.struct(F.lit(0).alias("n"), zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("least"))
    pairs = F.arrays_zip(at.alias("new"), F.concat(F.array_repeat(F.lit(0), window), at).alias("old"))
    every = F.filter(pairs, lambda x: x["new"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        counts, new, old = acc["counts"], x["new"], x["old"]
        grown, lost = F.get(counts, new), F.get(counts, old)
        moved = (old > 0) & (old != new)
        total = acc["sum"] + F.when((old == new), F.lit(0.0)).otherwise(F.get(weight, grown + 1) - F.get(weight, grown) + F.when(moved, F.get(weight, lost - 1) - F.get(weight, lost)).otherwise(0.0))
        after = F.transform(counts, lambda c, j: c + F.when((j == new) & (old != new), 1).otherwise(0) - F.when((j == old) & moved, 1).otherwise(0))
        full = acc["n"] + 1 >= window
        least = F.when(full & ((acc["least"] < 0) | (total < acc["least"])), total).otherwise(acc["least"])
        return F.struct((acc["n"] + 1).alias("n"), after.alias("counts"), total.alias("sum"), least.alias("least"))

    return F.aggregate(every, state, step, lambda acc: F.log2(F.lit(float(window))) - acc["least"] / window)


def suspicious(value: Column) -> Column:
    kind = char_class(value)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    least = F.create_map(*(F.lit(x) for k, t in THRESHOLDS.items() for x in (k, t)))
    return F.when(kind.isNull() | allowed, False).otherwise(top_entropy(value) >= least[kind])


def uncovered(runs: Column, base: Column) -> Column:
    """What of ``runs`` lies in no span of ``base``, in pieces of WINDOW characters and more."""

    def pieces(r: Column) -> Column:
        # base spans over the run by their start, each ending where the furthest so far does
        over = F.array_sort(F.transform(F.filter(base, lambda s: spans.overlap(s, r)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        begins = F.transform(F.sequence(F.lit(0), F.size(over)), lambda k: F.greatest(r["start"], F.coalesce(F.array_max(F.transform(F.slice(over, F.lit(1), k), lambda s: s["end"])), r["start"])))
        ends = F.concat(F.transform(over, lambda s: s["start"]), F.array(r["end"]))
        piece = lambda x: F.struct(r["kind"].alias("kind"), x["a"].alias("start"), x["b"].alias("end"), F.substring(r["value"], x["a"] - r["start"] + 1, x["b"] - x["a"]).alias("value"))
        return F.transform(F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: x["b"] - x["a"] >= WINDOW), piece)

    return F.flatten(F.transform(runs, lambda r: F.when(F.exists(base, lambda s: spans.overlap(s, r)), pieces(r)).otherwise(F.array(r))))


def with_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (kind, start, end, value), in order."""
    d, own = renamed(docs.drop("base_spans", "spans"))
    text = text_or_empty(own["text"])
    seen = d.select(*own.values(), base_spans(text).alias("_base"), spans.matches(text, CANDIDATE, "entropy").alias("_runs"))
    extra = F.filter(uncovered(F.col("_runs"), F.col("_base")), lambda s: suspicious(s["value"]))
    both = seen.select(*own.values(), spans.ordered(F.col("_base"), KINDS).alias("_old"), spans.ordered(F.concat("_base", extra), KINDS).alias("_all"))
    return both.select(*back(own), F.col("_old").alias("base_spans"), F.col("_all").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    base = F.col("base_spans")
    return found.select("doc_id", *(spans.count(base, k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))
