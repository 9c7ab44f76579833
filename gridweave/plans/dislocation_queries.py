"""Queries on episodes, cost bands and changepoints, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions.tables import small, stored
from gridweave.operators import bounds as B
from gridweave.operators import changepoint as C
from gridweave.operators import episodes as E
from gridweave.operators import grid as G
from gridweave.operators import runs as R
from gridweave.operators import stats as S
from gridweave.plans.panel_queries import AGES, DAY, MONTHS, STEP, r6
from gridweave.plans.panel_sql import EVENTS, LINEITEM
from gridweave.sources import panels as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- episodes ---------------------------------------------------------------------------------------
#: Rows left out (17:00 to 17:30), the threshold's quantile, the largest gap merged, the shortest kept.
SHUT, LEVEL, GAP, LEAST = (61_200, 63_000), 0.97, 1_800, 1_200


def open_panel(spark: SparkSession, sf: str) -> DataFrame:
    return stored(G.events_panel(spark, sf).where(~R.in_window(*SHUT)).withColumn("z", F.col("c_mid") - F.col("b_mid")), "open")


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = open_panel(spark, sf)
    level = E.threshold(p, "z", LEVEL)
    p = p.crossJoin(F.broadcast(small(level)))  # one row
    return p, E.episodes(p, "z", F.col("level"), STEP, GAP, LEAST, DAY)


EPISODES = f"""{EVENTS}, o AS (SELECT *, c_mid - b_mid AS z FROM p WHERE s % 86400 NOT BETWEEN {SHUT[0]} AND {SHUT[1] - 1}), lv AS (SELECT quantile_cont(abs(z), {LEVEL}) AS level FROM o),
o1 AS (SELECT o.*, abs(z) > level AS over_, coalesce(s - lag(s) OVER (ORDER BY s) <> 600, false) AS jump, lag(abs(z) > level) OVER (ORDER BY s) AS was FROM o, lv),
o2 AS (SELECT *, sum((over_ AND (NOT coalesce(was, false) OR jump))::INT) OVER (ORDER BY s) AS run FROM o1),
pc AS (SELECT run, min(s) AS lo, max(s) AS hi, arg_min(jump, s) AS jumped FROM o2 WHERE over_ GROUP BY run),
pm AS (SELECT *, sum((lag_hi IS NULL OR lo - lag_hi > {GAP} OR jumped)::INT) OVER (ORDER BY lo) AS ep FROM (SELECT *, lag(hi) OVER (ORDER BY lo) AS lag_hi FROM pc)),
es AS (SELECT min(lo) AS lo, max(hi) AS hi FROM pm GROUP BY ep HAVING max(hi) - min(lo) + 600 >= {LEAST}),
ex AS (SELECT es.lo, es.hi, o1.z, o1.s, row_number() OVER (PARTITION BY es.lo ORDER BY abs(o1.z) DESC, o1.s) AS r FROM es JOIN o1 ON o1.s BETWEEN es.lo AND es.hi),
ep AS (SELECT lo, hi, hi - lo + 600 AS seconds, z AS peak, s AS peak_s, sign(z)::DOUBLE AS sign FROM ex WHERE r = 1)"""


@query(f"WITH {EPISODES} SELECT make_timestamp(lo * 1000000) AS opens, make_timestamp(hi * 1000000) AS ends, seconds, peak, sign, strftime(make_timestamp(lo * 1000000), '%B') AS month FROM ep")
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    _, e = found(spark, sf)
    return e.select(O.stamp("lo").alias("opens"), O.stamp("hi").alias("ends"), "seconds", "peak", "sign", F.date_format(O.stamp("lo"), "MMMM").alias("month"))


@query(f"WITH {EPISODES} SELECT make_timestamp(lo * 1000000) AS opens, seconds, peak FROM ep ORDER BY abs(peak) DESC, lo LIMIT 20")
def episodes_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, e = found(spark, sf)
    return E.top(e, 20).select(O.stamp("lo").alias("opens"), "seconds", "peak")


STRETCH = f"""{EPISODES}, st AS (SELECT *, sum((NOT coalesce(s - prev = 600, false))::INT) OVER (ORDER BY s) AS stretch FROM (SELECT *, lag(s) OVER (ORDER BY s) AS prev FROM o)),
own AS (SELECT ep.*, st.stretch FROM ep JOIN st ON st.s = ep.peak_s)"""


@query(f"""WITH {STRETCH} SELECT make_timestamp(own.lo * 1000000) AS opens, min(CASE WHEN abs(st.z) <= abs(peak) / 2 THEN st.s - peak_s END) AS half_life, max(st.s) - any_value(peak_s) AS seen,
       min(CASE WHEN abs(st.z) <= abs(peak) / 2 THEN st.s - peak_s END) IS NULL AS censored
       FROM own JOIN st ON st.stretch = own.stretch AND st.s BETWEEN peak_s AND peak_s + 7200 GROUP BY own.lo""")
def half_life_ruler(spark: SparkSession, sf: str) -> DataFrame:
    p, e = found(spark, sf)
    return E.ruler(p, e, "z", 7_200, STEP, DAY).select(O.stamp("lo").alias("opens"), "half_life", "seen", "censored")


LEGS = {"c": ("c_mid", 1.0), "b": ("b_mid", -1.0)}


@query(f"""WITH {STRETCH}, ar AS (SELECT own.lo, own.peak, own.peak_s, own.sign, st.s, st.z, st.c_mid, st.b_mid, abs(st.z) <= abs(peak) / 2 AS half FROM own JOIN st ON st.stretch = own.stretch AND st.s BETWEEN peak_s - 7200 AND peak_s + 7200),
       ph AS (SELECT lo, 'opening' AS phase, (SELECT max(y.s) FROM ar y WHERE y.lo = x.lo AND y.half AND y.s < y.peak_s) AS x_s, peak_s AS y_s, 1 AS way, peak, sign FROM (SELECT DISTINCT lo, peak, peak_s, sign FROM ar) x
              UNION ALL SELECT lo, 'closing', peak_s, (SELECT min(y.s) FROM ar y WHERE y.lo = x.lo AND y.half AND y.s > y.peak_s), -1, peak, sign FROM (SELECT DISTINCT lo, peak, peak_s, sign FROM ar) x),
       mv AS (SELECT ph.phase, ph.peak, abs(b.z - a.z) AS move, ph.sign * way * (b.c_mid - a.c_mid) AS c, -ph.sign * way * (b.b_mid - a.b_mid) AS b
              FROM ph JOIN ar a ON a.lo = ph.lo AND a.s = x_s JOIN ar b ON b.lo = ph.lo AND b.s = y_s)
       SELECT phase, count(*) AS episodes, round(median((abs(c) + abs(b)) / move), 6) AS travel, {', '.join(f'round(sum({g}) / sum(move), 6) AS share_{g}, round(median({g} / move), 6) AS median_{g}, round(quantile_cont({g} / move, 0.25), 6) AS q25_{g}, round(quantile_cont({g} / move, 0.75), 6) AS q75_{g}' for g in 'cb')}
       FROM mv WHERE move >= 0.25 * abs(peak) GROUP BY phase""")
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    p, e = found(spark, sf)
    t = E.attribution_table(E.attribution(p, e, "z", LEGS, 7_200, STEP, DAY), list(LEGS))
    return t.select("phase", "episodes", *(r6(c, c) for c in t.columns[2:]))


@query(f"""WITH {EPISODES} SELECT h::INT AS hour, count(ep.lo) AS episodes, round(count(ep.lo) / nullif((SELECT count(*) FROM ep) * (SELECT count(*) FROM o WHERE s % 86400 // 3600 = h) / (SELECT count(*) FROM o), 0), 6) AS ratio
       FROM generate_series(0, 23) t(h) LEFT JOIN ep ON ep.lo % 86400 // 3600 = h GROUP BY h""")
def hour_concentration(spark: SparkSession, sf: str) -> DataFrame:
    p, e = found(spark, sf)
    hour = F.floor(R.time_of_day() / 3600).cast("int").alias("hour")
    rows = p.groupBy(hour).agg(F.count("*").alias("rows"))
    starts = e.withColumn("s", F.col("lo")).groupBy(hour).agg(F.count("*").alias("episodes"))
    all_hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    both = all_hours.join(rows, "hour", "left").join(starts, "hour", "left").fillna(0)
    total = both.agg(F.sum("rows").alias("_r"), F.sum("episodes").alias("_e"))
    expected = F.col("_e") * F.col("rows") / F.col("_r")
    return both.crossJoin(F.broadcast(total)).select("hour", "episodes", r6(F.try_divide(F.col("episodes").cast("double"), expected), "ratio"))  # one row


@query(f"""WITH {EPISODES}, ed AS (SELECT s, lag(s) OVER (ORDER BY s) AS prev, lead(s) OVER (ORDER BY s) AS next FROM o)
       SELECT make_timestamp(lo * 1000000) AS opens, CASE WHEN a.prev IS NULL OR lo - a.prev > 600 THEN 'starts at opening' WHEN b.next IS NULL OR b.next - hi > 600 THEN 'ends at close' ELSE 'inside' END AS verdict
       FROM ep JOIN ed a ON a.s = lo JOIN ed b ON b.s = hi""")
def boundary_audit(spark: SparkSession, sf: str) -> DataFrame:
    p, e = found(spark, sf)
    d = E.with_stretch(p, STEP, DAY).groupBy("stretch").agg(F.min("s").alias("begin"), F.max("s").alias("end"))
    lo, hi = d.select(F.col("begin").alias("lo"), F.lit(True).alias("at_open")), d.select(F.col("end").alias("hi"), F.lit(True).alias("at_end"))
    both = e.join(lo, "lo", "left").join(hi, "hi", "left")
    verdict = F.when(F.col("at_open"), "starts at opening").when(F.col("at_end"), "ends at close").otherwise("inside")
    return both.select(O.stamp("lo").alias("opens"), verdict.alias("verdict"))


# -- cost bands -------------------------------------------------------------------------------------
def banded(spark: SparkSession, sf: str) -> DataFrame:
    d = B.with_edges(R.quote_ages(G.lineitem_panel(spark, sf), DAY, MONTHS))
    return stored(d.withColumn("era", F.floor(F.col("s") / DAY / 365)), "banded")


BANDED = f"""{LINEITEM}, ag AS (SELECT *, row_number() OVER (ORDER BY s) AS rn FROM p),
ah AS (SELECT *, {', '.join(f'rn - max(CASE WHEN {g}_fresh OR rn = 1 THEN rn END) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {g}_q' for g in 'abc')} FROM ag),
bd AS (SELECT *, basis AS z, c_bid - a_ask * b_ask AS e_rich, a_bid * b_bid - c_ask AS e_cheap, greatest(a_q, b_q, c_q) AS max_age, s // 86400 // 365 AS era FROM ah),
be AS (SELECT *, greatest(e_rich, e_cheap) AS edge, e_rich >= e_cheap AS rich, z - e_rich AS c_rich, -z - e_cheap AS c_cheap FROM bd),
bf AS (SELECT *, c_rich + c_cheap AS band FROM be)"""


@query(f"WITH {BANDED} SELECT make_timestamp(s * 1000000) AS t, z, e_rich, e_cheap, edge, rich FROM bf")
def round_trip_edge(spark: SparkSession, sf: str) -> DataFrame:
    return banded(spark, sf).select(O.stamp("s").alias("t"), "z", "e_rich", "e_cheap", "edge", "rich")


FRESH = 1  #: oldest quote that is admitted, in days


@query(f"""WITH {BANDED}, ok AS (SELECT * FROM bf WHERE max_age <= {FRESH}), m AS (SELECT era, median(z) AS m FROM ok GROUP BY 1), ma AS (SELECT era, median(z) AS m FROM bf GROUP BY 1),
       al AS (SELECT era, 1.4826 * median(abs(z - m)) AS gap_all FROM bf JOIN ma USING (era) GROUP BY 1), ex AS (SELECT era, bool_and(abs(band - ((c_ask - c_bid) + a_mid * (b_ask - b_bid) + b_mid * (a_ask - a_bid))) < 1e-9 * greatest(1, abs(band))) AS exact FROM bf GROUP BY 1)
       SELECT era, count(*) AS n, count(*) * 24.0::DOUBLE AS hours, any_value(exact) AS exact, count(*) FILTER (edge > 0) AS positive, round(quantile_cont(band, 0.1), 6) AS band10, round(median(band), 6) AS band50, round(quantile_cont(band, 0.9), 6) AS band90,
       round(1.4826 * median(abs(z - m)), 6) AS gap, round(any_value(gap_all), 6) AS gap_all, round(max(abs(z)), 6) AS widest, round(max(edge), 6) AS best_edge, round(median(c_rich), 6) AS c_rich, round(median(c_cheap), 6) AS c_cheap,
       round(median(band) / (1.4826 * median(abs(z - m))), 6) AS ratio FROM ok JOIN m USING (era) JOIN al USING (era) JOIN ex USING (era) GROUP BY era""")
def band_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    d = banded(spark, sf)
    parts = F.col("band_a") + F.col("band_b") + F.col("band_c")
    exact = d.groupBy("era").agg(F.bool_and(F.abs(F.col("band") - parts) < 1e-9 * F.greatest(F.lit(1.0), F.abs("band"))).alias("exact"))
    h = B.headline(d, "era", F.col("max_age") <= FRESH, DAY).join(exact, "era")
    return h.select("era", "n", "hours", "exact", "positive", *(r6(c, c) for c in ("band10", "band50", "band90", "gap", "gap_all", "widest", "best_edge", "c_rich", "c_cheap", "ratio")))


GATES, DELAYS = [0, 1, 2, 5, 60, None], [0, 1, 2, 5]
COUNTED = "count(*) AS eligible, count(*) FILTER (got > 0) AS positive, round(count(*) FILTER (got > 0) / count(*), 6) AS share, round(max(got), 6) AS best, round(median(-got), 6) AS shortfall"


def counted(d: DataFrame, *keys: str) -> DataFrame:
    return d.select(*keys, "eligible", "positive", *(r6(c, c) for c in ("share", "best", "shortfall")))


@query(f"""WITH {BANDED}, gs AS (SELECT unnest([0, 1, 2, 5, 60, -1]) AS gate), ds AS (SELECT unnest([0, 1, 2, 5]) AS delay),
       fw AS (SELECT x.era, gate, delay, CASE WHEN x.rich THEN y.e_rich ELSE y.e_cheap END AS got FROM bf x, gs, ds, bf y WHERE y.s = x.s + delay * 86400 AND y.era = x.era AND (gate = -1 OR x.max_age <= gate))
       SELECT era, gate, delay, {COUNTED} FROM fw GROUP BY 1, 2, 3""")
def latency_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return counted(B.ladder(banded(spark, sf), GATES, DELAYS, DAY, MONTHS, "era", F.lit(True)), "era", "gate", "delay")


CUTS = [1.0, 0.75, 0.5, 0.33, 0.25, 0.1, 0.05]


@query(f"""WITH {BANDED}, ks AS (SELECT unnest({CUTS})::DOUBLE AS k),
       h AS (SELECT x.era, k, CASE WHEN x.z - k * x.c_rich >= -x.z - k * x.c_cheap THEN y.z - k * y.c_rich ELSE -y.z - k * y.c_cheap END AS got FROM bf x JOIN bf y ON y.s = x.s + 86400 AND y.era = x.era, ks WHERE x.max_age <= {FRESH})
       SELECT era, k, {COUNTED} FROM h GROUP BY 1, 2""")
def haircut_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return counted(B.haircuts(banded(spark, sf), CUTS, 1, DAY, MONTHS, "era", F.col("max_age") <= FRESH), "era", "k")


@query(f"""WITH {BANDED}, tr AS (SELECT x.edge, greatest(abs(x.a_mid - y.a_mid) * x.b_mid, abs(x.b_mid - y.b_mid) * x.a_mid, abs(x.c_mid - y.c_mid)) AS travel FROM bf x JOIN bf y ON y.s = x.s - 86400),
       ct AS (SELECT quantile_cont(travel, [0.2, 0.4, 0.6, 0.8]) AS c FROM tr)
       SELECT len(list_filter(c, lambda v: v <= travel))::INT AS part, count(*) AS n, count(*) FILTER (edge > 0) AS positive, round(median(travel), 6) AS travel FROM tr, ct GROUP BY 1""")
def edge_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return B.velocity(banded(spark, sf), DAY, MONTHS).select("part", "n", "positive", r6("travel", "travel"))


@query(f"""WITH {BANDED}, lv AS (SELECT quantile_cont(abs(z), 0.95) AS level FROM bf), o1 AS (SELECT bf.*, abs(z) > level AS over_ FROM bf, lv),
       o2 AS (SELECT *, sum((over_ AND NOT coalesce(was, false))::INT) OVER (ORDER BY s) AS run FROM (SELECT *, lag(over_) OVER (ORDER BY s) AS was FROM o1)),
       pc AS (SELECT min(s) AS lo, max(s) AS hi FROM o2 WHERE over_ GROUP BY run), pm AS (SELECT *, sum((lag_hi IS NULL OR lo - lag_hi > 172800)::INT) OVER (ORDER BY lo) AS ep FROM (SELECT *, lag(hi) OVER (ORDER BY lo) AS lag_hi FROM pc)),
       es AS (SELECT min(lo) AS lo, max(hi) AS hi FROM pm GROUP BY ep HAVING max(hi) - min(lo) + 86400 >= 172800),
       w AS (SELECT es.lo, bf.*, row_number() OVER (PARTITION BY es.lo ORDER BY abs(z) DESC, bf.s) AS r FROM es JOIN bf ON bf.s BETWEEN es.lo AND es.hi)
       SELECT make_timestamp(lo * 1000000) AS opens, make_timestamp(s * 1000000) AS widest, abs(z) AS required, CASE WHEN z > 0 THEN c_rich ELSE c_cheap END AS cost, abs(z) > CASE WHEN z > 0 THEN c_rich ELSE c_cheap END AS pays FROM w WHERE r = 1""")
def breakeven(spark: SparkSession, sf: str) -> DataFrame:
    d = banded(spark, sf)
    level = E.threshold(d, "z", 0.95)
    d = d.crossJoin(F.broadcast(small(level)))  # one row
    e = E.episodes(d, "z", F.col("level"), DAY, 2 * DAY, 2 * DAY, MONTHS).select("lo", "hi")
    b = B.breakeven(E.in_intervals(d.select("s", "z", "c_rich", "c_cheap"), e, MONTHS))
    return b.select(O.stamp("lo").alias("opens"), O.stamp("at").alias("widest"), "required", "cost", "pays")


# -- changepoints -----------------------------------------------------------------------------------
@query(f"""WITH {EVENTS}, d AS (SELECT s, basis AS v, CASE WHEN s - lag(s) OVER w = 600 THEN basis - lag(basis) OVER w END AS dv FROM p WINDOW w AS (ORDER BY s)),
       o AS (SELECT *, s // 7200 * 7200 AS b FROM d WHERE s % 86400 NOT BETWEEN 61200 AND 62999), m AS (SELECT b, median(v) AS m FROM o GROUP BY b),
       sp AS (SELECT b, dv, lag(dv) OVER (PARTITION BY b ORDER BY s) AS pd FROM o WHERE dv IS NOT NULL),
       sr AS (SELECT b, count(*) AS k, corr(dv, pd) AS r, covar_samp(dv, pd) AS c FROM sp GROUP BY b)
       SELECT make_timestamp(b * 1000000) AS t, count(*) AS n, round(1.4826 * median(abs(v - m)), 6) AS mad, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(count(*) FILTER (dv <> 0) / nullif(count(dv), 0), 6) AS move_share,
       round(count(*) / ((7200 - greatest(0, least(b % 86400 + 7200, 63000) - greatest(b % 86400, 61200))) / 600), 6) AS coverage, count(*) FILTER (dv <> 0) AS moves,
       round(any_value(CASE WHEN k > 2 AND NOT isnan(r) THEN r END), 6) AS rho1, round(any_value(CASE WHEN k >= 3 AND c < 0 THEN sqrt(-c) END), 6) AS roll_c FROM o JOIN m USING (b) LEFT JOIN sr USING (b) GROUP BY b""")
def bucket_features(spark: SparkSession, sf: str) -> DataFrame:
    d = C.bucket_features(G.events_panel(spark, sf), "basis", 7_200, STEP, SHUT, DAY)
    return d.select(O.stamp("s").alias("t"), "n", *(r6(c, c) for c in ("mad", "iqr", "move_share", "coverage", "rho1", "roll_c")), "moves")


@query(f"""WITH {EVENTS}, k2 AS (SELECT s // 7200 * 7200 AS s, median(abs(basis)) AS v FROM p WHERE s % 86400 NOT BETWEEN 0 AND 7199 GROUP BY 1), l AS (SELECT s, ln(v) AS y FROM k2 WHERE v > 0),
       a AS (SELECT *, row_number() OVER (ORDER BY s) AS rn, NOT coalesce(s - lag(s) OVER (ORDER BY s) = 7200, false) AS fresh FROM l),
       b AS (SELECT *, rn - max(CASE WHEN fresh THEN rn END) OVER (ORDER BY s) AS age FROM a), c AS (SELECT *, s % 86400 // 7200 AS slot, least(age, 4) AS band FROM b),
       pr AS (SELECT slot, median(y) AS pm FROM c GROUP BY slot), r AS (SELECT c.*, y - pm AS r FROM c JOIN pr USING (slot)), bm AS (SELECT band, median(r) AS m FROM r GROUP BY band)
       SELECT make_timestamp(s * 1000000) AS t, age, round(r - (m - coalesce((SELECT m FROM bm WHERE band = 4), 0)), 6) AS y FROM r JOIN bm USING (band)""")
def deseason(spark: SparkSession, sf: str) -> DataFrame:
    p = G.events_panel(spark, sf).where(~R.in_window(0, 7_200))
    b = p.groupBy((F.floor(F.col("s") / 7_200) * 7_200).alias("s")).agg(F.median(F.abs("basis")).alias("v")).where("v > 0").withColumn("ln", F.log("v"))
    d = C.deseasoned(b, "ln", F.floor(R.time_of_day() / 7_200), 7_200, 4, DAY)
    return d.select(O.stamp("s").alias("t"), "age", r6("y", "y"))


MIN_SEGMENT, SPAN = 12, 30


def turnover(spark: SparkSession, sf: str) -> DataFrame:
    """The turnover series in buckets of 30 days."""
    d = P.orders_series(spark, sf)
    return d.groupBy((F.floor(F.col("s") / DAY / SPAN) * SPAN * DAY).alias("s")).agg(F.stddev_samp("y").alias("v")).where("v > 0").select("s", F.log("v").alias("y"))


_EV = "list_extract((SELECT lg FROM lgs), ({n})::INT + 1) + a0 * ln(b0) - lgamma(a0) - (a0 + ({n}) / 2.0) * ln(greatest(1e-300, b0 + ({zz} + k0 * m0 * m0 - (k0 + {ww}) * pow(({wz} + k0 * m0) / (k0 + {ww}), 2)) / 2)) + (ln(k0) - ln(k0 + {ww})) / 2 - ({n}) / 2.0 * ln(2 * pi())"


def _ev(n: str, ww: str, wz: str, zz: str) -> str:
    return _EV.format(n=n, ww=f"({ww})", wz=f"({wz})", zz=f"({zz})")


def _ev3(n: str, expr: str) -> str:
    return _ev(n, *(expr.replace("#", k) for k in ("ww", "wz", "zz")))


def placed_sql(series: str, step: int, least: int) -> str:
    """pl: all placements of the series ``sr`` (s, y) that ``series`` ends with."""
    return f"""{series},
pa AS (SELECT count(*) AS n, 0.01 AS k0, 2.0 AS a0, avg(y) AS m0, var_samp(y) AS b0 FROM sr), lgs AS (SELECT list(lgamma(2.0 + i / 2.0) ORDER BY i) AS lg FROM pa, unnest(generate_series(0, (SELECT n FROM pa))) t(i)),
ad AS (SELECT *, row_number() OVER (ORDER BY s) AS i, lag(y) OVER (ORDER BY s) AS py, coalesce(s - lag(s) OVER (ORDER BY s) = {step}, false) AS adj FROM sr),
rh AS (SELECT unnest([{', '.join(repr(r) for r in C.RHOS)}])::DOUBLE AS rho),
wh AS (SELECT rho, i, CASE WHEN adj THEN 1 - rho ELSE sqrt(1 - rho * rho) END AS w, CASE WHEN adj THEN y - rho * py ELSE y * sqrt(1 - rho * rho) END AS z, sqrt(1 - rho * rho) AS w1, y * sqrt(1 - rho * rho) AS z1 FROM ad, rh),
px AS (SELECT rho, i, coalesce(sum(w * w) OVER v, 0) AS p_ww, coalesce(sum(w * z) OVER v, 0) AS p_wz, coalesce(sum(z * z) OVER v, 0) AS p_zz, w1 * w1 - w * w AS d_ww, w1 * z1 - w * z AS d_wz, z1 * z1 - z * z AS d_zz FROM wh WINDOW v AS (PARTITION BY rho ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tt AS (SELECT rho, sum(w * w) AS t_ww, sum(w * z) AS t_wz, sum(z * z) AS t_zz FROM wh GROUP BY rho),
pl AS (SELECT rho, 'M0' AS model, NULL::BIGINT AS t1, NULL::BIGINT AS t2, {_ev3('n', 't_#')} AS ll FROM tt, pa
  UNION ALL SELECT rho, 'M1', x.i, NULL, {_ev3('x.i - 1', 'x.p_#')} + {_ev3('n - x.i + 1', 't_# - x.p_# + x.d_#')} FROM px x JOIN tt USING (rho), pa WHERE x.i > {least} AND x.i <= n - {least} + 1
  UNION ALL SELECT x.rho, 'M2', x.i, y.i, {_ev3('y.i - x.i', 'y.p_# - x.p_# + x.d_#')} + {_ev3('x.i - 1 + n - y.i + 1', 'x.p_# + t_# - y.p_# + y.d_#')} FROM px x JOIN px y ON x.rho = y.rho AND y.i - x.i >= {least} JOIN tt ON tt.rho = x.rho, pa WHERE x.i > {least} AND y.i <= n - {least} + 1
  UNION ALL SELECT x.rho, 'M3', x.i, y.i, {_ev3('y.i - x.i', 'y.p_# - x.p_# + x.d_#')} + {_ev3('x.i - 1', 'x.p_#')} + {_ev3('n - y.i + 1', 't_# - y.p_# + y.d_#')} FROM px x JOIN px y ON x.rho = y.rho AND y.i - x.i >= {least} JOIN tt ON tt.rho = x.rho, pa WHERE x.i > {least} AND y.i <= n - {least} + 1)
"""


TURNOVER = f"""
od AS (SELECT epoch_us(o_orderdate) // 86400000000 AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), oy AS (SELECT d, ln(v / 1e6) AS y FROM od),
ob AS (SELECT d // {SPAN} * {SPAN} * 86400 AS s, stddev_samp(y) AS v FROM oy GROUP BY 1), sr AS (SELECT s, ln(v) AS y FROM ob WHERE v > 0)"""
PLACED = placed_sql(TURNOVER, SPAN * 86_400, MIN_SEGMENT)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return C.fold(turnover(spark, sf), SPAN * DAY, MIN_SEGMENT)


@query(f"""WITH {PLACED}, mx AS (SELECT rho, model, max(ll) AS m, count(*) AS c FROM pl GROUP BY 1, 2), lz AS (SELECT rho, model, any_value(m) + ln(sum(exp(ll - m))) - ln(any_value(c)) AS lz, any_value(c) AS c FROM pl JOIN mx USING (rho, model) GROUP BY 1, 2),
       mm AS (SELECT model, max(lz) AS m FROM lz GROUP BY 1), z AS (SELECT model, any_value(m) + ln(sum(exp(lz - m))) - ln(8) AS log_z, max(c) AS configs FROM lz JOIN mm USING (model) GROUP BY 1)
       SELECT model, configs, round(log_z, 6) AS log_z, round(exp(log_z - (SELECT max(log_z) FROM z)) / sum(exp(log_z - (SELECT max(log_z) FROM z))) OVER (), 6) AS posterior FROM z""")
def changepoint_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.models(placed(spark, sf)).select("model", "configs", r6("log_z", "log_z"), r6("posterior", "posterior"))


@query(f"""WITH {PLACED}, w AS (SELECT t1 AS bucket, sum(exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M1'))) AS w FROM pl WHERE model = 'M1' GROUP BY t1), q AS (SELECT bucket, w / sum(w) OVER () AS prob FROM w),
       c AS (SELECT *, sum(prob) OVER (ORDER BY bucket) AS cum FROM q), wi AS (SELECT a.bucket AS lo, b.bucket AS hi FROM c a JOIN c b ON b.bucket >= a.bucket WHERE b.cum - a.cum + a.prob >= 0.95 - 1e-12 ORDER BY hi - lo, lo LIMIT 1)
       SELECT (SELECT bucket FROM c ORDER BY round(prob, 12) DESC, bucket LIMIT 1) AS mode, (SELECT min(bucket) FROM c WHERE cum >= 0.5) AS median, lo, hi FROM wi""")
def changepoint_onset(spark: SparkSession, sf: str) -> DataFrame:
    return C.credible(C.change_marginal(placed(spark, sf), "M1", "t1"))


@query(f"""WITH {PLACED}, w AS (SELECT t1, t2, exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M2')) AS w FROM pl WHERE model = 'M2')
       SELECT ad.i, round((SELECT coalesce(sum(w), 0) FROM w WHERE t1 <= ad.i AND t2 > ad.i) / (SELECT sum(w) FROM w), 6) AS p, ((SELECT coalesce(sum(w), 0) FROM w WHERE t1 <= ad.i AND t2 > ad.i) / (SELECT sum(w) FROM w) > 0.5)::INT AS regime FROM ad""")
def regime_labels(spark: SparkSession, sf: str) -> DataFrame:
    series = turnover(spark, sf)
    p = C.middle_probability(placed(spark, sf), series.count(), "M2")
    return p.select("i", r6("p", "p"), (F.col("p") > 0.5).cast("int").alias("regime"))


@query(f"""WITH {LINEITEM}, l AS (SELECT *, CASE WHEN s < 884736000 THEN 'pre' WHEN s < 947808000 THEN 'stress' ELSE 'post' END AS regime FROM p), m AS (SELECT regime, median(basis) AS m FROM l GROUP BY 1),
       ar AS (SELECT x.regime, count(*) AS pairs, corr(x.basis, y.basis) AS rho FROM l x JOIN l y ON y.s = x.s - 86400 AND y.regime = x.regime GROUP BY 1)
       SELECT regime, count(*) AS n, round(1.4826 * median(abs(basis - m)), 6) AS mad, round(stddev_samp(basis), 6) AS sd, round(max(abs(basis)), 6) AS most, any_value(pairs) AS pairs, round(any_value(rho), 6) AS rho,
       round(any_value(CASE WHEN rho > 0 AND rho < 1 THEN ln(0.5) / ln(rho) END), 6) AS half_life FROM l JOIN m USING (regime) JOIN ar USING (regime) GROUP BY regime""")
def regime_summary(spark: SparkSession, sf: str) -> DataFrame:
    regime = F.when(F.col("s") < 884_736_000, "pre").when(F.col("s") < 947_808_000, "stress").otherwise("post")
    p = G.lineitem_panel(spark, sf).withColumn("regime", regime)
    m = S.mad(p, ["regime"], "basis")
    a = S.ar1(p, ["regime"], "basis", DAY, MONTHS)
    g = p.groupBy("regime").agg(F.stddev_samp("basis").alias("sd"), F.max(F.abs("basis")).alias("most"))
    d = m.join(g, "regime").join(a, "regime").withColumn("half_life", S.half_life(F.col("rho")))
    return d.select("regime", "n", "pairs", *(r6(c, c) for c in ("mad", "sd", "most", "rho", "half_life")))


__all__ = ["AGES", "ORACLES", "QUERIES"]
