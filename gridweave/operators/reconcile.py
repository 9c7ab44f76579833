"""Tables on tables: gates, sweeps, extremes and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions.tables import stored
from gridweave.operators import stats as S


def gate(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """check, value, passed: one row for each (name, frame of one row with ``value``, test of it)."""
    out = None
    for name, frame, test in checks:
        one = frame.select(F.lit(name).alias("check"), F.col("value").cast("double").alias("value"), F.coalesce(test, F.lit(False)).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def exit_code(checked: DataFrame) -> int:
    """0 if all checks passed, 1 if one failed, 2 if there was nothing to check."""
    n, bad = checked.agg(F.count("*"), F.count_if(~F.col("passed"))).first()
    return 2 if not n else int(bad > 0)


def sweep(cells: DataFrame, bounds: DataFrame, least: int, chunk: int = 10_000) -> DataFrame:
    """onset, back, inside, days, n, within, between, share: variance split inside and outside of each window of cells, for
    windows with ``least`` rows on both sides.

    ``cells``: cell, n, z, zz (power sums, made once); ``bounds``: onset, back. A window's sums are the difference of two
    running sums over cells, so that a pair of bounds costs two lookups whatever lies between; chunks of cells hand
    their sums over."""
    n, z, zz = F.col("n"), F.col("z"), F.col("zz")
    parts = {"days": F.lit(1), "n": n, "z": z, "w": F.greatest(F.lit(0.0), zz - z * z / n), "q": z * z / n}
    kinds = {k: "long" if k in ("days", "n") else "double" for k in parts}
    here = cells.select(F.col("cell").cast("long").alias("s"), *(c.cast(kinds[k]).alias(k) for k, c in parts.items()))
    edges = bounds.select(F.explode(F.array(F.col("onset").cast("long"), F.col("back").cast("long"))).alias("s")).select("s", *(F.lit(0).cast(kinds[k]).alias(k) for k in parts))
    points = here.unionByName(edges).groupBy("s").agg(*(F.sum(k).alias(k) for k in parts))
    before = stored(O.with_running(points, {f"_{k}": F.col(k) for k in parts}, chunk).select("s", *((F.col(f"_{k}") - F.col(k)).alias(k) for k in parts)), "running")
    at = lambda side: before.select(F.col("s").alias(side), F.struct(*parts).alias(f"_{side}"))
    whole = here.agg(F.struct(*(F.coalesce(F.sum(k), F.lit(0).cast(kinds[k])).alias(k) for k in parts)).alias("_t"))
    both = bounds.select(F.col("onset").cast("long").alias("onset"), F.col("back").cast("long").alias("back")).join(at("onset"), "onset").join(at("back"), "back").crossJoin(F.broadcast(whole))  # one row
    # a window that ends before it begins holds nothing
    inner = {k: F.when(F.col("back") > F.col("onset"), F.col(f"_back.{k}") - F.col(f"_onset.{k}")).otherwise(0) for k in parts}
    sides = F.array(F.struct(F.lit(True).alias("inside"), *(c.alias(k) for k, c in inner.items())), F.struct(F.lit(False).alias("inside"), *((F.col(f"_t.{k}") - c).alias(k) for k, c in inner.items())))
    rows = both.select("onset", "back", sides.alias("sides")).where(F.forall("sides", lambda x: x["n"] >= least)).select("onset", "back", F.explode("sides").alias("x")).select("onset", "back", "x.*")
    within, between = F.greatest(F.lit(0.0), F.col("w")) / n, F.greatest(F.lit(0.0), F.col("q") / n - F.pow(z / n, F.lit(2.0)))
    return rows.where("days >= 2").select("onset", "back", "inside", "days", "n", within.alias("within"), between.alias("between"), (between / (within + between)).alias("share"))


def extremes(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows, with ``rank`` (descending, equal values share the smallest)."""
    ranked = df.withColumn("rank", F.rank().over(W.orderBy(F.desc(value))))  # a row a day
    return ranked.orderBy(F.desc(value), *df.columns).limit(k).withColumn("end", F.lit("top")).unionByName(ranked.orderBy(value, *df.columns).limit(k).withColumn("end", F.lit("bottom")))


def widest(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mad, role: the key of the widest dispersion is ``stress``, those before and after it ``pre`` and ``post``
    (``calm`` where only one other is left). ``key`` must sort in time."""
    m = S.mad(df, [key], value)
    n, top = F.count("*").over(W.partitionBy()), F.max_by(key, F.struct("mad", key)).over(W.partitionBy())
    role = F.when(F.col(key) == top, "stress").when(n <= 2, "calm").when(F.col(key) < top, "pre").otherwise("post")
    return m.withColumn("role", role)  # a row a segment


def boundary_counts(days: DataFrame, starts: int, ends: int, episodes: int) -> DataFrame:
    """One row: sessions by class (the full ones have the most rows, the late ones the fewest, those that close early the
    number in between), sessions with an opening and a closing row, and expected beside observed episodes that touch
    them, if episodes began and ended evenly over all rows. ``days``: n, rows of each session."""
    sizes = days.agg(F.max("n").alias("full"), F.min("n").alias("late"))
    d = days.crossJoin(F.broadcast(sizes))  # one row
    kind = F.when(F.col("n") == F.col("full"), "full").when(F.col("n") == F.col("late"), "late").otherwise("other")
    g = d.withColumn("kind", kind).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("full", "other", "late")), F.count("*").alias("sessions"), F.sum("n").alias("rows"))
    opens, closes = F.col("sessions") - F.col("other"), F.col("sessions") - F.col("late")
    return g.select(
        "sessions", "full", "other", "late", "rows", opens.alias("with_open"), closes.alias("with_close"), F.lit(episodes).cast("long").alias("episodes"),
        (episodes * opens / F.col("rows")).alias("expected_starts"), F.lit(starts).cast("long").alias("observed_starts"), (episodes * closes / F.col("rows")).alias("expected_ends"), F.lit(ends).cast("long").alias("observed_ends"),
    )


def routes(rows: DataFrame) -> DataFrame:
    """route, a column for each role, calmest and the stressed role's multiple of it, from (route, role, value). Where two
    segments have one role, its value is that of the calmer one."""
    others = ("pre", "post", "calm")
    wide = rows.groupBy("route").pivot("role", ["stress", *others]).agg(F.min("value"))
    calmest = F.least(*others)
    return wide.withColumns({"calmest": calmest, "multiple": F.try_divide(F.col("stress"), calmest)})


def named_windows(panel: DataFrame, windows: list[tuple[str, int, int]], value: str, cell: Column, least: int) -> DataFrame:
    """name, days, n, share of variance between cells inside, the same outside, and how many times wider inside is:
    ratios of pooled deviation, of the deviation within cells, and of the pooled median distance (no power sum)."""
    out = None
    for name, lo, hi in windows:
        inside = (F.col("s") >= lo) & (F.col("s") < hi)
        d = panel.select("s", F.col(value).alias("v"), cell.alias("cell"), inside.alias("inside"))
        x = F.col("v")
        cells = d.groupBy("inside", "cell").agg(F.count("*").alias("n"), F.sum(x).alias("z"), F.sum(x * x).alias("zz")).where(F.col("n") >= least)
        parts = S.split_variance(cells, ["inside"]).join(S.mad(d, ["inside"], "v").drop("n"), "inside")
        side = lambda c, f: F.max(F.when(F.col("inside") == f, F.col(c)))
        pooled = parts.withColumn("total", F.col("within") + F.col("between"))
        ratio = lambda c, root=True: (F.sqrt(side(c, True) / side(c, False)) if root else side(c, True) / side(c, False))
        one = pooled.agg(F.lit(name).alias("name"), side("days", True).alias("days"), side("n", True).alias("n"), side("share", True).alias("share"), side("share", False).alias("calm_share"), ratio("total").alias("sd_ratio"), ratio("within").alias("within_ratio"), ratio("mad", False).alias("mad_ratio"))
        out = one if out is None else out.unionByName(one)
    return out
