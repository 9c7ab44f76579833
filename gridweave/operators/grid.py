"""From ticks to a regular grid: validity, last tick of a bucket, splice of sources, last known values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import ordered as O

LEGS = ("a", "b", "c")


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Both sides there and positive, bid strictly below ask."""
    return ticks.where("bid > 0 AND ask > 0 AND bid < ask")


def tick_audit(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of ticks, and of those with null, zero, negative, crossed or locked sides."""
    bid, ask = F.col("bid"), F.col("ask")
    tests = {"nulls": bid.isNull() | ask.isNull(), "zeros": (bid == 0) | (ask == 0), "negatives": (bid < 0) | (ask < 0), "crossed": bid > ask, "locked": bid == ask}
    return ticks.groupBy(*keys).agg(F.count("*").alias("ticks"), *(F.count_if(c).alias(n) for n, c in tests.items()))


def last_of_bucket(ticks: DataFrame, step: int, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """The values of one row, the last by (s, tie), for each key and bucket of ``step`` seconds."""
    keys = ["leg"] if keys is None else keys
    bucket = (F.floor(F.col("s") / step) * step).alias("s")
    best = F.max_by(F.struct(*values), F.struct("s", "tie"))
    return ticks.groupBy(*keys, bucket).agg(best.alias("v")).select(*keys, "s", "v.*")


def wide(quotes: DataFrame, values: list[str], legs: tuple[str, ...] = LEGS) -> DataFrame:
    """A row a bucket with columns leg_value, null where the leg has none: one shuffle for all legs."""
    return quotes.groupBy("s").agg(*(F.max(F.when(F.col("leg") == g, F.col(v))).alias(f"{g}_{v}") for g in legs for v in values))


def grid(df: DataFrame, step: int) -> DataFrame:
    """All s from the first to the last of ``df`` by ``step``, made in parallel from two numbers."""
    ends = df.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    # stretches first, so that a long span is made by many tasks
    per = 10_000
    parts = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(per * step))).alias("p")) if step > 0 else ends
    return parts.where("p is not null").select(F.explode(F.sequence("p", F.least(F.col("hi"), F.col("p") + (per - 1) * step), F.lit(step))).alias("s"))


def spliced(primary: DataFrame, backup: DataFrame, values: list[str], names: tuple[str, str] = ("primary", "backup")) -> DataFrame:
    """Per key and bucket the primary's row where it has one, else the backup's, whole rows only, with ``source``."""
    one = lambda d, n, r: d.select("leg", "s", F.struct(F.lit(r).alias("rank"), *values, F.lit(n).alias("source")).alias("v"))
    both = one(primary, names[0], 0).unionByName(one(backup, names[1], 1))
    return both.groupBy("leg", "s").agg(F.min_by("v", "v.rank").alias("v")).select("leg", "s", *(f"v.{c}" for c in (*values, "source")))


def absent(backup: DataFrame, primary: DataFrame) -> DataFrame:
    """Buckets of the backup that the primary lacks."""
    return backup.join(primary, ["leg", "s"], "left_anti")


def synchronised(quotes: DataFrame, step: int, chunk: int, values: list[str], legs: tuple[str, ...] = LEGS) -> DataFrame:
    """The grid with every leg's last known values, leg_fresh, and only rows where each leg has a price.

    The values of a leg travel as one struct, so that they come from one tick."""
    structs = quotes.groupBy("s").agg(*(F.max_by(F.struct(*values), F.when(F.col("leg") == g, 1)).alias(g) for g in legs))
    joined = grid(quotes, step).join(structs, "s", "left")
    flagged = joined.withColumns({f"{g}_fresh": F.col(g).isNotNull() for g in legs})
    known = O.with_last_known(flagged, list(legs), chunk)
    known = known.where(reduce(lambda x, y: x & y, (F.col(g).isNotNull() for g in legs)))
    return known.select("s", *(F.col(g)[v].alias(f"{g}_{v}") for g in legs for v in values), *(f"{g}_fresh" for g in legs))


def with_basis(panel: DataFrame) -> DataFrame:
    """synthetic = a*b and basis = c - a*b."""
    return panel.withColumn("synthetic", F.col("a_mid") * F.col("b_mid")).withColumn("basis", F.col("c_mid") - F.col("synthetic"))


def step_counts(df: DataFrame, chunk: int) -> DataFrame:
    """step, n: how often neighbours are so many seconds apart."""
    d = O.with_previous(df.select("s"), {"prev_s": "s"}, chunk)
    return d.where("prev_s is not null").groupBy((F.col("s") - F.col("prev_s")).alias("step")).agg(F.count("*").alias("n"))


def checked_grid(df: DataFrame, step: int, chunk: int) -> DataFrame:
    """``df``, or an error if its times repeat or under half of its neighbours are a step apart."""
    counts = step_counts(df, chunk)
    total, right = counts.agg(F.sum("n"), F.sum(F.when(F.col("step") == step, F.col("n")))).first()
    repeated = df.agg(F.count("*") - F.count_distinct("s")).first()[0]
    if repeated or (right or 0) < 0.5 * (total or 0):
        top = [tuple(r) for r in counts.orderBy(F.desc("n"), "step").limit(3).collect()]
        raise ValueError(f"no grid of {step} s: {repeated} repeated times, most common steps {top}")
    return df


def checked_quotes(panel: DataFrame, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """``panel``, or an error if a bid is not below its ask."""
    wrong = reduce(lambda x, y: x | y, (F.col(f"{g}_bid") >= F.col(f"{g}_ask") for g in legs))
    if n := panel.where(wrong).count():
        raise ValueError(f"{n} rows have a crossed or locked quote")
    return panel


def lineitem_panel(spark, sf_dir: str) -> DataFrame:
    """The day grid of three quoted legs: s, leg_mid, leg_bid, leg_ask, leg_fresh, synthetic, basis."""
    from gridweave.sources import panels as P

    ticks = valid_ticks(P.lineitem_quotes(spark, sf_dir)).withColumn("mid", P.mid_of(F.col("bid"), F.col("ask")))
    last = last_of_bucket(ticks, P.DAY, ["bid", "ask", "mid"])
    return with_basis(synchronised(last, P.DAY, 90 * P.DAY, ["mid", "bid", "ask"]))


def events_panel(spark, sf_dir: str, step: int = 600) -> DataFrame:
    """The grid of three event types' last values: s, leg_mid, leg_fresh, synthetic, basis."""
    from gridweave.sources import panels as P

    last = last_of_bucket(P.event_ticks(spark, sf_dir), step, ["mid"])
    return with_basis(synchronised(last, step, P.DAY, ["mid"]))
