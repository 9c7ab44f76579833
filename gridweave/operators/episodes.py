"""Dislocation episodes: intervals in which a series is beyond a threshold, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q


def pieces(df: DataFrame, value: str, threshold: Column, step: int, chunk: int) -> DataFrame:
    """run, lo, hi, jumped: true-runs of |value| > threshold, cut where rows are missing. ``jumped``: rows were missing right before."""
    d = df.withColumn("_over", F.coalesce(F.abs(value) > threshold, F.lit(False)))
    d = O.with_previous(d, {"prev_s": "s", "_was": "_over"}, chunk)
    d = d.withColumn("_jump", F.col("prev_s").isNotNull() & ~O.adjacent(step))
    d = O.with_run(d, F.col("_over") & (~F.coalesce("_was", F.lit(False)) | F.col("_jump")), chunk)
    at = d.where("_over").groupBy("run").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min_by("_jump", "s").alias("jumped"))
    return at


def episodes(df: DataFrame, value: str, threshold: Column, step: int, gap: int, least: int, chunk: int) -> DataFrame:
    """lo, hi, seconds, peak, sign: pieces no more than ``gap`` seconds apart are one episode, unless rows
    are missing right before the later piece; episodes under ``least`` seconds are dropped. The peak is the
    value of largest size, the earliest of equals, over the whole span."""
    p = pieces(df, value, threshold, step, chunk).select(F.col("lo").alias("s"), "hi", "jumped")
    p = O.with_previous(p, {"_hi": "hi"}, chunk * 64)
    p = O.with_run(p, F.col("_hi").isNull() | (F.col("s") - F.col("_hi") > gap) | F.col("jumped"), chunk * 64, "episode")
    spans = p.groupBy("episode").agg(F.min("s").alias("lo"), F.max("hi").alias("hi")).withColumn("seconds", F.col("hi") - F.col("lo") + step).where(F.col("seconds") >= least)
    rows = in_intervals(df.select("s", F.col(value).alias("z")), spans, chunk)
    peak = F.max_by(F.struct("z", "s"), F.struct(F.abs("z"), -F.col("s"))).alias("p")
    return rows.where("z is not null").groupBy("lo", "hi", "seconds").agg(peak).select("lo", "hi", "seconds", F.col("p.z").alias("peak"), F.col("p.s").alias("peak_s"), F.signum("p.z").alias("sign"))


def in_intervals(df: DataFrame, spans: DataFrame, chunk: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows of ``df`` with lo <= s <= hi of each span: an equality join on chunks of time, then the exact test."""
    cut = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col(lo) / chunk), F.floor(F.col(hi) / chunk))))
    d = O.chunked(df, chunk)
    return d.join(cut, "_k").where((F.col("s") >= F.col(lo)) & (F.col("s") <= F.col(hi))).drop("_k")


def with_stretch(df: DataFrame, step: int, chunk: int) -> DataFrame:
    """``stretch``: a number for each run of rows without a missing one."""
    d = O.with_previous(df, {"prev_s": "s"}, chunk)
    return O.with_run(d, ~O.adjacent(step), chunk, "stretch").drop("prev_s")


def around_peak(df: DataFrame, eps: DataFrame, value: str, back: int, ahead: int, step: int, chunk: int) -> DataFrame:
    """Rows of each episode's peak's own stretch from ``back`` seconds before it to ``ahead`` after it."""
    d = with_stretch(df, step, chunk).withColumn("z", F.col(value))
    at = eps.join(d.select(F.col("s").alias("peak_s"), F.col("stretch").alias("_own")), "peak_s")
    wide = at.withColumns({"_from": F.col("peak_s") - back, "_to": F.col("peak_s") + ahead})
    return in_intervals(d, wide, chunk, "_from", "_to").where(F.col("stretch") == F.col("_own")).drop("_own", "_from", "_to")


def ruler(df: DataFrame, eps: DataFrame, value: str, window: int, step: int, chunk: int) -> DataFrame:
    """Per episode half_life: seconds from the peak to the first |z| at most half of it; null (censored) where none is seen."""
    rows = around_peak(df, eps, value, 0, window, step, chunk)
    reached = F.when(F.abs("z") <= F.abs("peak") / 2, F.col("s") - F.col("peak_s"))
    return rows.groupBy("lo", "peak_s", "peak").agg(F.min(reached).alias("half_life"), (F.max("s") - F.first("peak_s")).alias("seen")).withColumn("censored", F.col("half_life").isNull())


def attribution(df: DataFrame, eps: DataFrame, value: str, legs: dict[str, tuple[str, float]], window: int, step: int, chunk: int, floor: float = 0.25) -> DataFrame:
    """Two rows an episode (phase opening and closing): how much each leg's weighted change contributed.

    Opening runs from the last |z| of at most half the peak before it to the peak, closing from the peak to
    the first such after it. ``legs``: name to (column, weight), value being the sum of weight times column.
    Moves of less than ``floor`` of the peak are dropped."""
    rows = around_peak(df, eps, value, window, window, step, chunk)
    half = F.abs("z") <= F.abs("peak") / 2
    cols = F.struct("s", "z", *(F.col(c).alias(n) for n, (c, _) in legs.items()))
    before = F.max_by(cols, F.when(half & (F.col("s") < F.col("peak_s")), F.col("s"))).alias("before")
    after = F.min_by(cols, F.when(half & (F.col("s") > F.col("peak_s")), F.col("s"))).alias("after")
    at = F.max_by(cols, F.when(F.col("s") == F.col("peak_s"), F.col("s"))).alias("at")
    e = rows.groupBy("lo", "peak_s", "peak", "sign").agg(before, at, after)
    phase = lambda name, x, y: F.struct(F.lit(name).alias("phase"), F.col(x).alias("x"), F.col(y).alias("y"))
    two = e.select("lo", "peak", "sign", F.explode(F.array(phase("opening", "before", "at"), phase("closing", "at", "after"))).alias("p")).where("p.x.s is not null and p.y.s is not null")
    dz = F.col("p.y.z") - F.col("p.x.z")
    orient = F.col("sign") * F.when(F.col("p.phase") == "opening", 1).otherwise(-1)
    parts = {n: orient * w * (F.col(f"p.y.{n}") - F.col(f"p.x.{n}")) for n, (_, w) in legs.items()}
    out = two.select("lo", "peak", F.col("p.phase").alias("phase"), F.abs(dz).alias("move"), *(v.alias(f"c_{n}") for n, v in parts.items()))
    total = sum((F.abs(f"c_{n}") for n in legs), F.lit(0.0))
    return out.where(F.col("move") >= floor * F.abs("peak")).withColumn("travel", total / F.col("move"))


def attribution_table(parts: DataFrame, legs: list[str]) -> DataFrame:
    """Per phase the pooled share of each leg (their sum is 1), and medians and quartiles of the episodes' own. A row an
    episode and phase comes in."""
    aggs = [F.count("*").alias("episodes"), F.median("travel").alias("travel")]
    for n in legs:
        part = F.col(f"c_{n}") / F.col("move")
        aggs += [(F.sum(f"c_{n}") / F.sum("move")).alias(f"share_{n}"), F.median(part).alias(f"median_{n}"), F.percentile(part, F.lit(0.25)).alias(f"q25_{n}"), F.percentile(part, F.lit(0.75)).alias(f"q75_{n}")]
    return parts.groupBy("phase").agg(*aggs)


def top(eps: DataFrame, k: int) -> DataFrame:
    return eps.orderBy(F.desc(F.abs("peak")), "lo").limit(k)


def threshold(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the quantile of |value|."""
    return Q.quantiles(df, [], F.abs(value), {"level": share}).select("level")


def after_reopening(eps: DataFrame, closures: DataFrame) -> DataFrame:
    """Episodes that begin on a day on which a closure ended."""
    day = F.floor(F.col("hi") / 86_400).alias("_day")
    return eps.withColumn("_day", F.floor(F.col("lo") / 86_400)).join(closures.select(day).distinct(), "_day", "left_semi").drop("_day")


def exceedance(df: DataFrame, value: str, level: Column, span: int) -> DataFrame:
    """s (begin of a span), n, share of rows beyond the level."""
    return df.groupBy((F.floor(F.col("s") / span) * span).alias("s")).agg(F.count("*").alias("n"), F.avg((F.abs(value) > level).cast("int")).alias("share"))
