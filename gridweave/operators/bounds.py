"""Cost bands and executability of a three-legged round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q
from gridweave.operators import stats as S


def with_edges(panel: DataFrame, unit: float = 1.0) -> DataFrame:
    """``panel`` with z (basis), e_rich, e_cheap, edge, rich, c_rich, c_cheap, band and the band by leg, in ``unit``."""
    c = F.col
    e_rich = (c("c_bid") - c("a_ask") * c("b_ask")) / unit
    e_cheap = (c("a_bid") * c("b_bid") - c("c_ask")) / unit
    d = panel.withColumns({"z": c("basis") / unit, "e_rich": e_rich, "e_cheap": e_cheap})
    d = d.withColumns({"edge": F.greatest("e_rich", "e_cheap"), "rich": c("e_rich") >= c("e_cheap"), "c_rich": c("z") - c("e_rich"), "c_cheap": -c("z") - c("e_cheap")})
    spread = {g: c(f"{g}_ask") - c(f"{g}_bid") for g in "abc"}
    return d.withColumns({"band": c("c_rich") + c("c_cheap"), "band_c": spread["c"] / unit, "band_b": c("a_mid") * spread["b"] / unit, "band_a": c("b_mid") * spread["a"] / unit})


def headline(d: DataFrame, key: str, admit: Column, step: int) -> DataFrame:
    """Per key: n, hours, the admitted rows' dispersion (and that of all rows beside it), quantiles of the band, medians
    of the sides' costs, band over dispersion, the widest gap, the best edge and how often it is positive."""
    ok = d.where(admit)
    g = ok.groupBy(key).agg(F.count("*").alias("n"), (F.count("*") * F.lit(step / 3600)).alias("hours"), F.max(F.abs("z")).alias("widest"), F.max("edge").alias("best_edge"), F.count_if(F.col("edge") > 0).alias("positive"))
    out = g.join(S.mad(ok, [key], "z", "gap").drop("n"), key).join(S.mad(d, [key], "z", "gap_all").drop("n"), key)
    out = out.join(Q.quantiles(ok, [key], "band", {"band10": 0.1, "band50": 0.5, "band90": 0.9}).drop("n"), key)
    for c in ("c_rich", "c_cheap"):
        out = out.join(Q.median(ok, [key], c, c).drop("n"), key)
    return out.withColumn("ratio", F.try_divide("band50", "gap"))


def realised(d: DataFrame, delays: list[int], step: int, chunk: int, key: str, cuts: tuple[float, ...] = (1.0,)) -> DataFrame:
    """``d`` with tries: array of (delay, cut, edge): what the side chosen now, at a share ``cut`` of its quoted cost,
    pays ``delay`` steps later; null where a row between is missing or the last is of another ``key``."""
    z = F.col("z")
    sides = lambda k: F.struct((z - k * F.col("c_rich")).alias("rich"), (-z - k * F.col("c_cheap")).alias("cheap"))
    now = d.withColumn("_now", F.struct(F.col(key).alias("key"), F.array(*(sides(k) for k in cuts)).alias("sides")))
    later = O.with_ahead(now, "_now", [k for k in delays if k], step, chunk) if any(delays) else now
    tries = []
    for delay in delays:
        then = F.col(f"ahead_{delay}") if delay else F.col("_now")
        for i, cut in enumerate(cuts):
            here, there = F.col("_now.sides")[i], then["sides"][i]
            got = F.when(then["key"] == F.col(key), F.when(here["rich"] >= here["cheap"], there["rich"]).otherwise(there["cheap"]))
            tries.append(F.struct(F.lit(delay).alias("delay"), F.lit(float(cut)).alias("cut"), got.alias("edge")))
    return later.select(*d.columns, F.array(*tries).alias("tries"))


def counted(rows: DataFrame, keys: list[str], edge: str = "edge") -> DataFrame:
    """Per key: eligible rows, those whose edge is positive and their share, the best edge and the median shortfall."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("eligible"), F.count_if(F.col(edge) > 0).alias("positive"), F.max(edge).alias("best"))
    short = Q.median(rows, keys, -F.col(edge), "shortfall").drop("n")
    return g.join(short, keys).withColumn("share", F.col("positive") / F.col("eligible"))


def ladder(d: DataFrame, gates: list[int | None], delays: list[int], step: int, chunk: int, key: str, admit: Column, age: str = "max_age") -> DataFrame:
    """Per key, gate (oldest quote admitted, -1 for any) and delay: ``counted`` over every admitted row that could be
    traded then, whether or not its side pays now."""
    every = F.array(*(F.lit(-1 if g is None else g) for g in gates))
    rows = realised(d, delays, step, chunk, key).where(admit).select(key, F.col(age).alias("_age"), F.explode("tries").alias("t")).where("t.edge is not null")
    each = rows.select(key, "_age", F.col("t.delay").alias("delay"), F.col("t.edge").alias("edge"), F.explode(every).alias("gate"))
    return counted(each.where((F.col("gate") == -1) | (F.col("_age") <= F.col("gate"))).select(key, "gate", "delay", "edge"), [key, "gate", "delay"])


def haircuts(d: DataFrame, cuts: list[float], delay: int, step: int, chunk: int, key: str, admit: Column) -> DataFrame:
    """Per key and share of the quoted cost: ``counted`` over admitted rows at one delay."""
    rows = realised(d, [delay], step, chunk, key, tuple(cuts)).where(admit).select(key, F.explode("tries").alias("t")).where("t.edge is not null")
    return counted(rows.select(key, F.col("t.cut").alias("k"), F.col("t.edge").alias("edge")), [key, "k"])


def variants(d: DataFrame, each: list[tuple[str, Column, int]], step: int, chunk: int, key: str) -> DataFrame:
    """variant, key, band (median of rows that ``mask`` admits), and ``counted`` of those that are also in time: for each
    (name, mask, gate column, delay)."""
    delays = sorted({delay for *_, delay in each})
    rows = realised(d, delays, step, chunk, key)
    tests = F.array(*(F.struct(F.lit(name).alias("variant"), F.coalesce(mask, F.lit(False)).alias("in"), F.coalesce(mask & gate, F.lit(False)).alias("live"), F.col("tries")[delays.index(delay)]["edge"].alias("edge")) for name, mask, gate, delay in each))
    v = rows.select(key, "band", F.explode(tests).alias("v")).where("v.in").select(key, "band", "v.*")
    bands = Q.median(v, ["variant", key], "band", "band").drop("n")
    live = counted(v.where("live and edge is not null"), ["variant", key])
    return bands.join(live, ["variant", key], "left").fillna(0, ["eligible", "positive"])


def velocity(d: DataFrame, step: int, chunk: int, cuts: int = 5) -> DataFrame:
    """Per ``cuts``-th of how far the legs moved since the row before: rows and how often the edge is positive."""
    f = O.with_lagged(d, {f"p_{g}": (f"{g}_mid", 1) for g in "abc"}, step, chunk)
    moved = F.greatest(F.abs(F.col("a_mid") - F.col("p_a")) * F.col("b_mid"), F.abs(F.col("b_mid") - F.col("p_b")) * F.col("a_mid"), F.abs(F.col("c_mid") - F.col("p_c")))
    f = f.select("edge", moved.alias("travel")).where("travel is not null")
    edges = Q.quantiles(f, [], "travel", {f"q{i}": i / cuts for i in range(1, cuts)})
    edges = edges.select(F.array(*(f"q{i}" for i in range(1, cuts))).alias("cut"))
    # broadcast: one row
    part = f.crossJoin(F.broadcast(edges)).withColumn("part", F.size(F.filter("cut", lambda c: c <= F.col("travel"))))
    return part.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("edge") > 0).alias("positive")).join(Q.median(part, ["part"], "travel", "travel").drop("n"), "part")


def breakeven(rows: DataFrame) -> DataFrame:
    """Per episode (lo), at its widest row: the gap and the cost of the side that would take it."""
    best = F.max_by(F.struct("s", "z", "c_rich", "c_cheap"), F.struct(F.abs("z"), -F.col("s"))).alias("b")
    at = rows.groupBy("lo", "hi").agg(best)
    need, cost = F.abs("b.z"), F.when(F.col("b.z") > 0, F.col("b.c_rich")).otherwise(F.col("b.c_cheap"))
    return at.select("lo", F.col("b.s").alias("at"), need.alias("required"), cost.alias("cost"), (need > cost).alias("pays"))
