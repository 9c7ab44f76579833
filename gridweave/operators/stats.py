"""Robust and moment statistics of groups, as aggregates of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q

MAD_SCALE = 1.4826


def mad(df: DataFrame, keys: list[str], value: str, name: str = "mad", many: bool = False) -> DataFrame:
    """keys, n, name: 1.4826 times the median distance from the median, exact, in two aggregations.

    ``many``: the keys are many and each has few rows, as buckets of time; without it groups may be of any size."""
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))
    mid = d.groupBy(*keys).agg(F.median("_v").alias("_m")) if many else Q.median(d, keys, "_v", "_m").drop("n")
    joined = d.join(mid if many else F.broadcast(mid), keys) if keys else d.crossJoin(F.broadcast(mid))  # a row a key
    away = F.abs(F.col("_v") - F.col("_m"))
    if many:
        return joined.groupBy(*keys).agg(F.count("*").alias("n"), (MAD_SCALE * F.median(away)).alias(name))
    return Q.median(joined, keys, away, "_d").select(*keys, "n", (MAD_SCALE * F.col("_d")).alias(name))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, top (99.9 % of |x|), most (max |x|), bias-corrected skew and excess kurtosis."""
    x, n = F.col(value), F.col("n")
    d = df.where(x.isNotNull())
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.max(F.abs(x)).alias("most"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    top = Q.quantiles(d, keys, F.abs(x), {"top": 0.999}).drop("n")
    g = g.join(top, keys) if keys else g.crossJoin(F.broadcast(top))  # one row
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return g.withColumns({"skew": skew, "kurt": kurt}).drop("g1", "g2")


def corr(x: Column, y: Column) -> Column:
    """Correlation of columns that are null together; null where one of them does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def serial(df: DataFrame, keys: list[str], value: str, chunk: int, closed_up: bool = False) -> DataFrame:
    """keys, n, rho1, roll_c, noise_share of the values that are there, nulls closed up; with ``closed_up`` also across
    rows of other keys, by a running number in each key."""
    d = df.where(F.col(value).isNotNull())
    if closed_up and keys:
        return _serial_by_key(d, keys, value, chunk)
    keys_too = {f"_p_{k}": k for k in keys}
    d = O.with_previous(d.select(*keys, "s", value), {"_prev": value} | keys_too, chunk)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_p_{k}") == F.col(k))
    return _serial_sums(d.withColumn("_prev", F.when(same, F.col("_prev"))), keys, value)


def _serial_sums(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    pair = F.col("_prev").isNotNull()
    x, y = F.when(pair, F.col(value)), F.col("_prev")
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), corr(x, y).alias("rho1"), F.covar_samp(x, y).alias("cov"))
    roll = F.when((F.col("n") >= 3) & (F.col("cov") < 0), F.sqrt(-F.col("cov")))
    rho = F.when(F.col("n") > 2, F.col("rho1"))
    return out.select(*keys, "n", rho.alias("rho1"), roll.alias("roll_c"), noise_share(rho).alias("noise_share"))


def _serial_by_key(d: DataFrame, keys: list[str], value: str, chunk: int) -> DataFrame:
    """As ``serial``: the last value of a key in a chunk of time is handed to the key's next chunk."""
    d = d.select(*keys, "s", value, F.floor(F.col("s") / chunk).alias("_k"))
    ends = d.groupBy(*keys, "_k").agg(F.max_by(value, "s").alias("_end"))
    carry = ends.select(*keys, "_k", F.lag("_end").over(W.partitionBy(*keys).orderBy("_k")).alias("_in"))  # a row a chunk
    w = W.partitionBy(*keys, "_k").orderBy("s")
    d = d.withColumns({"_prev": F.lag(value).over(w), "_first": F.row_number().over(w) == 1}).join(carry, [*keys, "_k"])
    d = d.withColumn("_prev", F.when(F.col("_first"), F.col("_in")).otherwise(F.col("_prev")))
    return _serial_sums(d, keys, value)


def noise_share(rho: Column) -> Column:
    return F.when(rho.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), -2 * rho)))


def survival(df: DataFrame, value: str, points: int = 250) -> DataFrame:
    """u, share: P(|X| > u) at ``points`` geometric steps from the median of |X| (zeros left out) to its largest.

    A value's step follows from its logarithm, put right by one against the exact edges; steps are counted in one
    aggregation, and a sum over the ``points`` counts gives the shares."""
    d = df.select(F.abs(value).alias("x")).where("x > 0")
    mid = Q.median(d, [], "x", "lo").where("n > 0")
    ends = mid.crossJoin(F.broadcast(d.agg(F.max("x").alias("hi"))))  # one row each
    ends = ends.withColumn("u", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), i / (points - 1))))
    near = F.when((F.col("x") > F.col("lo")) & (F.col("hi") > F.col("lo")), F.floor(F.log(F.col("x") / F.col("lo")) / F.log(F.col("hi") / F.col("lo")) * (points - 1))).otherwise(F.lit(0)).cast("int")
    base = F.greatest(F.lit(0), near - 1)
    # how many edges lie below the value: those before ``base``, and of the next few those that do
    under = base + sum((F.coalesce((F.get("u", base + k) < F.col("x")).cast("int"), F.lit(0)) for k in range(4)), F.lit(0))
    counts = d.crossJoin(F.broadcast(ends)).groupBy(under.alias("under")).agg(F.count("*").alias("c"))  # one row
    edges = ends.select("n", F.posexplode("u").alias("i", "u")).join(counts.withColumn("i", F.col("under") - 1), "i", "left")
    above = F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0))  # ``points`` rows
    return edges.select("i", "u", (above / F.col("n")).alias("share"))


def envelope(df: DataFrame, value: str, step: int) -> DataFrame:
    return df.groupBy((F.floor(F.col("s") / step) * step).alias("s")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.median(value).alias("mid"))


def variance_decomposition(df: DataFrame, day: str, value: str, least: int) -> DataFrame:
    """days, n, within, between, share of variance between days; population variances, days of ``least`` rows and more."""
    x = F.col(value)
    days = df.where(x.isNotNull()).groupBy(day).agg(F.count("*").alias("n"), F.sum(x).alias("z"), F.sum(x * x).alias("zz")).where(F.col("n") >= least)
    return split_variance(days, [])


def split_variance(days: DataFrame, keys: list[str]) -> DataFrame:
    """The same from power sums n, z, zz of days."""
    n, z, zz = F.col("n"), F.col("z"), F.col("zz")
    total = days.groupBy(*keys).agg(F.count("*").alias("days"), F.sum(n).alias("n"), F.sum(z).alias("z"), F.sum(F.greatest(F.lit(0.0), zz - z * z / n)).alias("w"), F.sum(z * z / n).alias("q"))
    within, between = F.col("w") / n, F.greatest(F.lit(0.0), F.col("q") / n - F.pow(z / n, F.lit(2.0)))
    return total.where("days >= 2").select(*keys, "days", "n", within.alias("within"), between.alias("between"), (between / (within + between)).alias("share"))


def ar1(df: DataFrame, keys: list[str], value: str, step: int, chunk: int) -> DataFrame:
    """keys, pairs, rho: correlation of a value with the one a step before, both of the same keys."""
    d = O.with_lagged(df, {"_prev": (value, 1)} | {f"_p_{k}": (k, 1) for k in keys}, step, chunk)
    for k in keys:
        d = d.where(F.col(f"_p_{k}") == F.col(k))
    d = d.where(F.col("_prev").isNotNull() & F.col(value).isNotNull())
    return d.groupBy(*keys).agg(F.count("*").alias("pairs"), corr(F.col(value), F.col("_prev")).alias("rho"))


def half_life(rho: Column) -> Column:
    """Steps to halve, null unless 0 < rho < 1."""
    return F.when((rho > 0) & (rho < 1), F.log(F.lit(0.5)) / F.log(F.when((rho > 0) & (rho < 1), rho)))
