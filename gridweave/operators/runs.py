"""Runs, closures, ages and admission of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import ordered as O

LEGS = ("a", "b", "c")


def unchanged(panel: DataFrame, chunk: int, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """``panel`` with leg_same (price as in the row before, gaps or not; false in the first row) and prev_s."""
    d = O.with_previous(panel, {"prev_s": "s"} | {f"prev_{g}": f"{g}_mid" for g in legs}, chunk)
    return d.withColumns({f"{g}_same": F.coalesce(F.col(f"{g}_mid") == F.col(f"prev_{g}"), F.lit(False)) for g in legs})


def true_runs(df: DataFrame, flag: Column, chunk: int) -> DataFrame:
    """Rows where ``flag`` holds, with ``run``, a number for each unbroken run of such rows."""
    d = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    d = O.with_previous(d, {"_was": "_flag"}, chunk)
    d = O.with_run(d, F.col("_flag") & ~F.coalesce("_was", F.lit(False)), chunk)
    return d.where("_flag").drop("_flag", "_was")


def closures(panel: DataFrame, least: int, chunk: int, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """run, lo, hi, rows of runs of at least ``least`` rows in which no leg changed price."""
    still = reduce(lambda x, y: x & y, (F.col(f"{g}_same") for g in legs))
    runs = true_runs(unchanged(panel, chunk, legs), still, chunk)
    return runs.groupBy("run").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("rows")).where(F.col("rows") >= least)


def open_rows(panel: DataFrame, least: int, chunk: int) -> DataFrame:
    """``panel`` without the rows of closures."""
    shut = closures(panel, least, chunk).select("lo", "hi")
    return panel.join(shut, (F.col("s") >= F.col("lo")) & (F.col("s") <= F.col("hi")), "left_anti")


def rows_since(df: DataFrame, events: dict[str, Column], chunk: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each event a column with the rows since it last held (0 where it holds, null before the first)."""
    d = O.with_running(df, {"_rn": F.lit(1).cast("long")}, chunk)
    d = d.withColumns({f"_at_{n}": F.when(e, F.col("_rn")) for n, e in events.items()})
    d = O.with_last_known(d, [f"_at_{n}" for n in events], chunk)
    return d.withColumns({n: F.col("_rn") - F.col(f"_at_{n}") for n in events}).drop("_rn", *(f"_at_{n}" for n in events))


def price_ages(panel: DataFrame, chunk: int, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """leg_age: rows since the leg's price changed; the first row counts as a change."""
    return rows_since(unchanged(panel, chunk, legs), {f"{g}_age": ~F.col(f"{g}_same") for g in legs}, chunk)


def quote_ages(panel: DataFrame, step: int, chunk: int, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """leg_quote_age: rows since the leg's last fresh quote, counted anew after a gap; max_age over the legs."""
    d = O.with_previous(panel, {"prev_s": "s"}, chunk)
    d = d.withColumn("_new", ~O.adjacent(step))
    d = rows_since(d, {f"{g}_quote_age": F.col(f"{g}_fresh") | F.col("_new") for g in legs}, chunk)
    return d.withColumn("max_age", F.greatest(*(f"{g}_quote_age" for g in legs))).drop("_new")


def isolated(panel: DataFrame, chunk: int, stale: int, lively: int, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """leg_isolated: the leg's price is stale while the others move."""
    d = price_ages(panel, chunk, legs)
    return d.withColumns({f"{g}_isolated": (F.col(f"{g}_age") > stale) & (F.greatest(*(f"{o}_age" for o in legs if o != g)) < lively) for g in legs})


def usable_rows(panel: DataFrame, ok: Column, group: Column, p: int, step: int, chunk: int) -> DataFrame:
    """Rows whose window of p + 2 rows is adjacent, all ``ok`` and of one group, with ``run`` and ``pos`` in it."""
    d = panel.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_g": group})
    d = O.with_previous(d, {"prev_s": "s", "_pok": "_ok", "_pg": "_g"}, chunk)
    chain = O.adjacent(step) & F.col("_ok") & F.coalesce("_pok", F.lit(False)) & F.coalesce(F.col("_g") == F.col("_pg"), F.lit(False))
    d = O.with_run(d, ~chain, chunk)
    first = d.groupBy("run").agg(F.min("s").alias("_lo"))
    d = d.join(first, "run").withColumn("pos", (F.col("s") - F.col("_lo")) / step)
    return d.where(F.col("_ok") & (F.col("pos") >= p + 1)).withColumn("pos", F.col("pos").cast("long")).drop("_ok", "_g", "_pok", "_pg", "_lo")


def drop_small_cells(rows: DataFrame, cell: list[str], least: int) -> DataFrame:
    large = rows.groupBy(*cell).count().where(F.col("count") >= least).select(*cell)
    return rows.join(large, cell, "left_semi")


def with_forward(panel: DataFrame, columns: list[str], delta: int, step: int, chunk: int) -> DataFrame:
    """``panel`` with fwd_column of the row ``delta`` steps later, null unless all rows between are there."""
    d = O.with_previous(panel, {"prev_s": "s"}, chunk)
    d = O.with_run(d, ~O.adjacent(step), chunk, "stretch")
    d = O.with_lagged(d, {f"fwd_{c}": (c, -delta) for c in [*columns, "stretch"]}, step, chunk)
    same = F.col("fwd_stretch") == F.col("stretch")
    return d.withColumns({f"fwd_{c}": F.when(same, F.col(f"fwd_{c}")) for c in columns}).drop("prev_s", "fwd_stretch")


def time_of_day(s: str = "s") -> Column:
    return F.pmod(F.col(s), F.lit(86_400))


def in_window(lo: int, hi: int, s: str = "s") -> Column:
    """Seconds of the day in [lo, hi)."""
    return (time_of_day(s) >= lo) & (time_of_day(s) < hi)


def session_age(buckets: DataFrame, step: int, chunk: int) -> DataFrame:
    """age: buckets since the last gap."""
    d = O.with_previous(buckets, {"prev_s": "s"}, chunk)
    d = rows_since(d, {"age": ~O.adjacent(step)}, chunk)
    return d.drop("prev_s")


def decimated(df: DataFrame, step: int) -> DataFrame:
    """Rows at multiples of ``step``; neighbours are then adjacent at that step."""
    return df.where(F.pmod(F.col("s"), F.lit(step)) == 0)
