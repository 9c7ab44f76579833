"""Global sequence functions without a global window.

A window without PARTITION BY sends every row to one task. Here rows are cut into chunks of time
(``_k``); windows run inside the chunks, and what earlier chunks hand over (a last value, a sum) comes
from a table of one row a chunk, joined back. Rows are ordered by ``s``, seconds since 1970, which must
be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds(t: str) -> Column:
    """Whole seconds since 1970 of a timestamp_ntz."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {t})").cast("long")


def stamp(s: str) -> Column:
    """The timestamp_ntz of seconds since 1970."""
    return F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, {s})")


def chunked(df: DataFrame, chunk: int) -> DataFrame:
    return df.withColumn("_k", F.floor(F.col("s") / chunk))


def _inside(rows: tuple | None = None):
    w = W.partitionBy("_k").orderBy("s")
    return w.rowsBetween(*rows) if rows else w


def _earlier():
    """Over the table of chunks, which has one row a chunk."""
    return W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)


def with_previous(df: DataFrame, new: dict[str, str], chunk: int) -> DataFrame:
    """``df`` with the values that columns had in the row before, gaps or not; null in the first row."""
    d = chunked(df, chunk)
    ends = d.groupBy("_k").agg(F.max_by(F.struct(*(F.col(c).alias(n) for n, c in new.items())), "s").alias("_end"))
    carry = ends.select("_k", F.lag("_end").over(W.orderBy("_k")).alias("_in"))
    first = F.row_number().over(_inside()) == 1
    d = d.withColumns({"_first": first} | {f"_p_{n}": F.lag(c).over(_inside()) for n, c in new.items()})
    d = d.join(carry, "_k")
    return d.withColumns({n: F.when(F.col("_first"), F.col("_in")[n]).otherwise(F.col(f"_p_{n}")) for n in new}).drop("_k", "_first", "_in", *(f"_p_{n}" for n in new))


def with_running(df: DataFrame, new: dict[str, Column], chunk: int) -> DataFrame:
    """``df`` with running sums of expressions, this row included."""
    d = chunked(df, chunk).withColumns({f"_x_{n}": c for n, c in new.items()})
    sums = d.groupBy("_k").agg(*(F.sum(f"_x_{n}").alias(n) for n in new))
    carry = sums.select("_k", *(F.coalesce(F.sum(n).over(_earlier()), F.lit(0)).alias(f"_c_{n}") for n in new))
    here = {f"_w_{n}": F.coalesce(F.sum(f"_x_{n}").over(_inside((W.unboundedPreceding, 0))), F.lit(0)) for n in new}
    d = d.withColumns(here).join(carry, "_k")
    return d.withColumns({n: F.col(f"_w_{n}") + F.col(f"_c_{n}") for n in new}).drop("_k", *(f"{p}{n}" for n in new for p in ("_x_", "_w_", "_c_")))


def with_last_known(df: DataFrame, columns: list[str], chunk: int) -> DataFrame:
    """``df`` with nulls of ``columns`` replaced by the last value before (a null where there is none)."""
    d = chunked(df, chunk)
    lasts = d.groupBy("_k").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("s"))).alias(c) for c in columns))
    carry = lasts.select("_k", *(F.last(c, ignorenulls=True).over(_earlier()).alias(f"_c_{c}") for c in columns))
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(_inside((W.unboundedPreceding, 0))) for c in columns}).join(carry, "_k")
    return d.withColumns({c: F.coalesce(c, f"_c_{c}") for c in columns}).drop("_k", *(f"_c_{c}" for c in columns))


def with_run(df: DataFrame, starts: Column, chunk: int, name: str = "run") -> DataFrame:
    """``df`` with a run number that grows by one at each row where ``starts`` holds."""
    return with_running(df, {name: F.when(starts, 1).otherwise(0).cast("long")}, chunk)


def adjacent(step: int, previous: str = "prev_s") -> Column:
    """The row before is exactly one step earlier; false in the first row."""
    return F.coalesce(F.col("s") - F.col(previous) == step, F.lit(False))


def with_lagged(df: DataFrame, new: dict[str, tuple[str, int]], step: int, chunk: int) -> DataFrame:
    """``df`` with values of rows exactly so many steps earlier (negative: later), null where there is no such row.

    Rows near a chunk's end are also dealt to the next one, so that no join is needed."""
    reach = max(abs(k) for _, k in new.values()) * step
    d = df.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor((F.col("s") - reach) / chunk), F.floor(F.col("s") / chunk), F.floor((F.col("s") + reach) / chunk)))))
    if reach > chunk:
        raise ValueError("chunks must be longer than the reach")
    w = W.partitionBy("_k").orderBy("s")
    for n, (c, k) in new.items():
        at = w.rangeBetween(-k * step, -k * step)
        d = d.withColumn(n, F.first(c).over(at))
    return d.where(F.col("_k") == F.floor(F.col("s") / chunk)).drop("_k")


def with_ahead(df: DataFrame, column: str, delays: list[int], step: int, chunk: int) -> DataFrame:
    """``df`` with ahead_k: ``column`` of the row k steps later, null unless it and all rows between are there.

    One window over chunks for all delays; rows near a chunk's begin are also dealt to the one before."""
    reach = max(delays) * step
    if reach > chunk:
        raise ValueError("chunks must be longer than the reach")
    own = F.floor(F.col("s") / chunk)
    d = df.withColumn("_k", F.explode(F.array_distinct(F.array(own, F.floor((F.col("s") - reach) / chunk)))))
    w = W.partitionBy("_k").orderBy("s")
    d = d.withColumns({f"_v{k}": F.first(column).over(w.rangeBetween(k * step, k * step)) for k in delays} | {f"_n{k}": F.count("*").over(w.rangeBetween(0, k * step)) for k in delays})
    d = d.withColumns({f"ahead_{k}": F.when(F.col(f"_n{k}") == k + 1, F.col(f"_v{k}")) for k in delays})
    return d.where(F.col("_k") == own).drop("_k", *(f"_{x}{k}" for k in delays for x in "vn"))
