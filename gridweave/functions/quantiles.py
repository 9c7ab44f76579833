"""Exact quantiles of groups of any size.

Spark's ``percentile`` holds the different values of a group in one task. Groups of more than ``most`` rows are handled
by radix selection: a double has a 64-bit image of the same order, and a pass counts, for all groups and wanted ranks at
once, the 256 cells of the image's next eight bits below the bits that are known, which gives eight more. After a pass a
rank's cell holds at most ``most`` rows or one value, or another pass follows; after eight passes the image is known, so
that there is an end whatever the values. Results equal ``percentile``'s to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions.tables import stored

MOST = 1_000_000  #: rows of a group, or of a cell of it, that one task may hold
BROADCAST_MOST = 50_000  #: rows of the table of wanted cells that are sent to all tasks; a larger one is joined
SLOTS = 64 // 8


def image(x: Column) -> Column:
    """A long for each double, of the same order, NaN being the largest; zeros of both signs are equal.

    The exponent comes from a logarithm, set right by comparisons with exact powers of two; scaling by powers of two and
    the fraction are exact."""
    a = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(a)).cast("int")
    e = near - (two(near) > a).cast("int") + (a >= 2 * two(near)).cast("int")
    one = F.lit(2.0**52)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((a / two(e) - 1) * one).cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    size = F.when(F.isnan(a), F.lit((2047 << 52) + 1)).when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def quantiles(df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, float], most: int | None = None, nan: bool = False) -> DataFrame:
    """keys, n (values that are neither null nor NaN) and a column for each of ``wanted``; groups without values have no row.

    With ``nan`` NaN is a value too, larger than all others, as it is for ``percentile`` and DuckDB."""
    most = MOST if most is None else most
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(*keys, x.alias("_x")).where("_x is not null" if nan else "_x is not null and not isnan(_x)")
    direct = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile("_x", F.lit(q)).alias(name) for name, q in wanted.items()))
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n"))
    largest, groups = sizes.agg(F.max("n"), F.count_if(F.col("n") > most)).first()
    if (largest or 0) <= most:
        return direct(d)
    g = F.struct(*keys) if keys else F.lit(0)
    large = _few(sizes.where(F.col("n") > most).select(g.alias("_g"), "n"), groups)
    own = d.withColumn("_g", g)
    rows = stored(own.join(large.select("_g"), "_g", "left_semi").select("_g", "_x", image(F.col("_x")).alias("_i")), "values")
    found = _selected(rows, stored(large, "sizes"), groups, wanted, most)
    found = found.select(*(F.col("_g")[k].alias(k) for k in keys), "n", *wanted)
    return found.unionByName(direct(own.join(large.select("_g"), "_g", "left_anti").select(*keys, "_x"))) if keys else found


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_MOST else df


def _prefix(known: int) -> Column:
    """The first ``known`` bytes of an image."""
    return F.shiftright("_i", 64 - 8 * known) if known else F.lit(0).cast("long")


def _selected(rows: DataFrame, sizes: DataFrame, groups: int, wanted: dict[str, float], most: int) -> DataFrame:
    """_g, n and the wanted quantiles of all groups of ``rows`` (_g, _x, _i)."""
    at = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for name, q in wanted.items()))
    each = sizes.select("_g", "n", F.explode(at).alias("w")).select("_g", "n", "w.*", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    zero = F.lit(0).cast("long")
    open_ = each.select("_g", "rank").distinct().select("_g", "rank", zero.alias("_p"), zero.alias("below"))
    few = groups * 2 * len(wanted)
    for known in range(SLOTS):
        cells = _few(open_.select("_g", "_p").distinct(), few)
        inside = rows.withColumn("_p", _prefix(known)).join(cells, ["_g", "_p"])
        counts = inside.groupBy("_g", "_p", _prefix(known + 1).alias("_next")).agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.coalesce(F.sum("c").over(W.partitionBy("_g", "_p").orderBy("_next").rowsBetween(W.unboundedPreceding, -1)), zero)  # at most 256 rows
        near = open_.select("_g", "rank", "_p", "below").join(counts.withColumn("before", before), ["_g", "_p"])
        held = near.where((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c")))
        open_ = stored(held.select("_g", "rank", F.col("_next").alias("_p"), (F.col("below") + F.col("before")).alias("below"), "c", "lo", "hi"), "cells")
        if open_.where((F.col("c") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
    same = open_.where("lo = hi").select("_g", "rank", F.col("lo").alias("v"))
    rest = open_.where("lo < hi")
    values = rows.withColumn("_p", _prefix(known + 1)).join(_few(rest.select("_g", "_p").distinct(), few), ["_g", "_p"]).groupBy("_g", "_p", "_x").agg(F.count("*").alias("c"))
    last = F.sum("c").over(W.partitionBy("_g", "_p").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))  # at most ``most`` rows
    placed = rest.select("_g", "_p", "rank", "below").join(values.withColumn("last", last), ["_g", "_p"])
    hit = placed.where((F.col("rank") - F.col("below") < F.col("last")) & (F.col("rank") - F.col("below") >= F.col("last") - F.col("c")))
    found = same.unionByName(hit.select("_g", "rank", F.col("_x").alias("v")))
    two = each.join(found, ["_g", "rank"]).groupBy("_g", "n", "name", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    between = (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
    return two.groupBy("_g", "n").agg(*(F.max(F.when(F.col("name") == name, exact)).alias(name) for name in wanted))


def median(df: DataFrame, keys: list[str], value: Column | str, name: str, most: int | None = None) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, most)
