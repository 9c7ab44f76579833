"""Queries on grids, quality, runs and statistics, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q
from gridweave.operators import grid as G
from gridweave.operators import runs as R
from gridweave.operators import stats as S
from gridweave.plans.panel_sql import EVENTS, LINEITEM
from gridweave.sources import panels as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY, MONTHS = P.DAY, 90 * P.DAY
STEP = P.TEN_MINUTES


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def month(s: str = "s") -> Column:
    return F.date_format(O.stamp(s), "yyyy-MM")


MONTH = "strftime(make_timestamp(s * 1000000), '%Y-%m')"
T = "make_timestamp(s * 1000000)"


@query(f"""WITH {LINEITEM} SELECT {T} AS t, a_mid, b_mid, c_mid, a_bid, a_ask, a_fresh, b_fresh, c_fresh, synthetic, basis FROM p""")
def grid_locf(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    return p.select(O.stamp("s").alias("t"), "a_mid", "b_mid", "c_mid", "a_bid", "a_ask", "a_fresh", "b_fresh", "c_fresh", "synthetic", "basis")


@query(f"""WITH {LINEITEM}, m AS (SELECT {MONTH} AS month, basis FROM p), c AS (SELECT month, median(basis) AS mid FROM m GROUP BY 1)
       SELECT month, count(*) AS n, round(1.4826 * median(abs(basis - mid)), 6) AS mad FROM m JOIN c USING (month) GROUP BY 1""")
def grid_locf_basis_mad(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf).select(month().alias("month"), "basis")
    return S.mad(p, ["month"], "basis", many=True).select("month", "n", r6("mad", "mad"))


@query("""WITH e AS (SELECT event_type AS leg, epoch_us(ts) // 1000000 // 3600 * 3600 AS s, value AS mid, ts, event_id, event_id % 3 = 0 AS spare FROM events WHERE event_type IN ('click', 'view', 'purchase')),
       k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY leg, s, spare ORDER BY ts DESC, event_id DESC) = 1),
       w AS (SELECT *, row_number() OVER (PARTITION BY leg, s ORDER BY spare) AS r FROM k)
       SELECT CASE leg WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS leg, make_timestamp(s * 1000000) AS t, mid, CASE WHEN spare THEN 'backup' ELSE 'primary' END AS source FROM w WHERE r = 1""")
def splice_priority(spark: SparkSession, sf: str) -> DataFrame:
    ticks = P.event_ticks(spark, sf)
    last = lambda d: G.last_of_bucket(d, P.HOUR, ["mid"])
    both = G.spliced(last(ticks.where("event_id % 3 <> 0")), last(ticks.where("event_id % 3 = 0")), ["mid"])
    return both.select("leg", O.stamp("s").alias("t"), "mid", "source")


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS leg, epoch_us(ts) // 1000000 // 600 * 600 AS s, event_id % 3 = 0 AS spare FROM events WHERE event_type IN ('click', 'view', 'purchase'))
       SELECT leg, count(DISTINCT s) AS repaired FROM e x WHERE spare AND NOT EXISTS (SELECT 1 FROM e y WHERE NOT y.spare AND y.leg = x.leg AND y.s = x.s) GROUP BY leg""")
def repaired_buckets(spark: SparkSession, sf: str) -> DataFrame:
    ticks = P.event_ticks(spark, sf).withColumn("s", F.floor(F.col("s") / STEP) * STEP)
    key = lambda c: ticks.where(c).select("leg", "s")
    return G.absent(key("event_id % 3 = 0").distinct(), key("event_id % 3 <> 0")).groupBy("leg").agg(F.count("*").alias("repaired"))


@query(f"""WITH {LINEITEM} SELECT leg, count(*) AS ticks, count(*) FILTER (bid IS NULL OR ask IS NULL) AS nulls, count(*) FILTER (bid = 0 OR ask = 0) AS zeros,
       count(*) FILTER (bid < 0 OR ask < 0) AS negatives, count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (bid = ask) AS locked FROM q0 GROUP BY leg""")
def tick_audit(spark: SparkSession, sf: str) -> DataFrame:
    return G.tick_audit(P.lineitem_quotes(spark, sf), ["leg"])


@query(f"""WITH {LINEITEM}""" + " UNION ALL ".join(f"SELECT '{g}' AS leg, count(*) AS n, round(median({g}_ask - {g}_bid), 6) AS median, round(quantile_cont({g}_ask - {g}_bid, 0.99), 6) AS p99 FROM p WHERE {g}_fresh" for g in "abc"))
def quote_spread_union(spark: SparkSession, sf: str) -> DataFrame:
    p, out = G.lineitem_panel(spark, sf), None
    for g in "abc":
        one = p.where(f"{g}_fresh").select(F.lit(g).alias("leg"), (F.col(f"{g}_ask") - F.col(f"{g}_bid")).alias("spread"))
        out = one if out is None else out.unionByName(one)
    return Q.quantiles(out, ["leg"], "spread", {"median": 0.5, "p99": 0.99}).select("leg", "n", r6("median", "median"), r6("p99", "p99"))


@query(f"""WITH {EVENTS} SELECT {T.replace('s *', 's // 86400 * 86400 *')} AS day, count(*) FILTER (NOT a_fresh AND NOT b_fresh AND NOT c_fresh) AS silent, count(*) FILTER (a_fresh AND b_fresh AND c_fresh) AS full_rows
       FROM p GROUP BY 1 HAVING count(*) FILTER (NOT a_fresh AND NOT b_fresh AND NOT c_fresh) > 3""")
def thin_days_having(spark: SparkSession, sf: str) -> DataFrame:
    p = G.events_panel(spark, sf)
    legs = sum((F.col(f"{g}_fresh").cast("int") for g in "abc"), F.lit(0))
    return p.groupBy(O.stamp(f"floor(s / {DAY}) * {DAY}").alias("day")).agg(F.count_if(legs == 0).alias("silent"), F.count_if(legs == 3).alias("full_rows")).where("silent > 3")


@query(f"""WITH {EVENTS}, d AS (SELECT s // 86400 AS d, avg(a_fresh::INT) AS a, avg(b_fresh::INT) AS b, avg(c_fresh::INT) AS c FROM p GROUP BY 1)
       SELECT make_timestamp(d * 86400000000) AS day, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, (dayofweek(make_timestamp(d * 86400000000)) BETWEEN 1 AND 5) AS weekday FROM d""")
def coverage_by_day(spark: SparkSession, sf: str) -> DataFrame:
    d = G.events_panel(spark, sf).groupBy(F.floor(F.col("s") / DAY).alias("d")).agg(*(F.avg(F.col(f"{g}_fresh").cast("int")).alias(g) for g in "abc"))
    day = O.stamp(f"d * {DAY}")
    return d.select(day.alias("day"), *(r6(g, g) for g in "abc"), F.dayofweek(day).between(2, 6).alias("weekday"))


IMPLIED = {"a": "c_mid / b_mid - a_mid", "b": "c_mid / a_mid - b_mid", "c": "a_mid * b_mid - c_mid"}


@query(f"WITH {LINEITEM}" + " UNION ALL ".join(f"SELECT '{g}' AS leg, round(median(abs({x})), 6) AS median, round(quantile_cont(abs({x}), 0.99), 6) AS p99, round(quantile_cont(abs({x}), 0.999), 6) AS p999 FROM p" for g, x in IMPLIED.items()))
def implied_gap_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    each = p.select(F.explode(F.array(*(F.struct(F.lit(g).alias("leg"), F.abs(F.expr(x)).alias("gap")) for g, x in IMPLIED.items()))).alias("x")).select("x.*")
    return Q.quantiles(each, ["leg"], "gap", {"median": 0.5, "p99": 0.99, "p999": 0.999}).select("leg", *(r6(c, c) for c in ("median", "p99", "p999")))


@query(f"WITH {LINEITEM}, x AS ({' UNION ALL '.join(f'''SELECT '{g}' AS leg, {MONTH} AS month, {x} AS gap FROM p''' for g, x in IMPLIED.items())}) SELECT leg, month, count(*) AS n, round(median(gap), 6) AS bias, abs(median(gap)) > 0.1 AS breach FROM x GROUP BY 1, 2 HAVING count(*) >= 20")
def daily_bias(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    each = p.select(month().alias("month"), F.explode(F.array(*(F.struct(F.lit(g).alias("leg"), F.expr(x).alias("gap")) for g, x in IMPLIED.items()))).alias("x")).select("month", "x.*")
    out = each.groupBy("leg", "month").agg(F.count("*").alias("n"), F.median("gap").alias("m")).where("n >= 20")
    return out.select("leg", "month", "n", r6("m", "bias"), (F.abs("m") > 0.1).alias("breach"))


AGES = f"""{EVENTS}, u AS (SELECT *, row_number() OVER (ORDER BY s) AS rn, {', '.join(f'coalesce({g}_mid = lag({g}_mid) OVER (ORDER BY s), false) AS {g}_same' for g in 'abc')} FROM p),
v AS (SELECT *, {', '.join(f'rn - max(CASE WHEN NOT {g}_same THEN rn END) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {g}_age' for g in 'abc')} FROM u)"""


@query(f"""WITH {AGES} SELECT {T} AS t, a_age, b_age, c_age, a_age > 3 AND greatest(b_age, c_age) < 2 AS a_isolated, b_age > 3 AND greatest(a_age, c_age) < 2 AS b_isolated, c_age > 3 AND greatest(a_age, b_age) < 2 AS c_isolated FROM v""")
def isolated_outage(spark: SparkSession, sf: str) -> DataFrame:
    d = R.isolated(G.events_panel(spark, sf), DAY, 3, 2)
    return d.select(O.stamp("s").alias("t"), *(f"{g}_age" for g in "abc"), *(f"{g}_isolated" for g in "abc"))


CLOSED = f"""{AGES}, w AS (SELECT *, a_same AND b_same AND c_same AS still FROM u), x AS (SELECT *, sum((NOT still)::INT) OVER (ORDER BY s) AS run FROM w),
shut AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS rows FROM x WHERE still GROUP BY run HAVING count(*) >= 3)"""


@query(f"WITH {CLOSED} SELECT make_timestamp(lo * 1000000) AS opens, make_timestamp(hi * 1000000) AS ends, rows, round((hi - lo + 600) / 3600, 6) AS hours FROM shut")
def closure_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = R.closures(G.events_panel(spark, sf), 3, DAY)
    return d.select(O.stamp("lo").alias("opens"), O.stamp("hi").alias("ends"), "rows", r6((F.col("hi") - F.col("lo") + STEP) / 3600, "hours"))


@query(f"""WITH {LINEITEM}, x AS ({' UNION ALL '.join(f'''SELECT '{g}' AS leg, {g}_mid AS v FROM p''' for g in 'abc')})
       SELECT leg, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(abs(v), 0.999), 6) AS top, round(max(abs(v)), 6) AS most, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt FROM x GROUP BY leg""")
def moments(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    each = p.select(F.explode(F.array(*(F.struct(F.lit(g).alias("leg"), F.col(f"{g}_mid").alias("v")) for g in "abc"))).alias("x")).select("x.*")
    return S.moments(each, ["leg"], "v").select("leg", "n", *(r6(c, c) for c in ("mean", "sd", "top", "most", "skew", "kurt")))


@query(f"""WITH {LINEITEM}, x AS (SELECT s // 31536000 AS era, s, basis FROM p), y AS (SELECT *, lag(basis) OVER (PARTITION BY era ORDER BY s) AS prev FROM x),
       z AS (SELECT era, count(*) AS n, corr(basis, prev) AS rho, covar_samp(basis, prev) AS cov FROM y GROUP BY era)
       SELECT era, n, round(CASE WHEN n > 2 THEN rho END, 6) AS rho1, round(CASE WHEN n >= 3 AND cov < 0 THEN sqrt(-cov) END, 6) AS roll_c, round(CASE WHEN n > 2 THEN greatest(0, least(1, -2 * rho)) END, 6) AS noise_share FROM z""")
def acf1_roll(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf).select(F.floor(F.col("s") / 31_536_000).alias("era"), "s", "basis")
    return S.serial(p, ["era"], "basis", MONTHS).select("era", "n", *(r6(c, c) for c in ("rho1", "roll_c", "noise_share")))


@query(f"""WITH {LINEITEM}, x AS (SELECT abs(basis) AS x FROM p WHERE basis <> 0), e AS (SELECT median(x) AS lo, max(x) AS hi, count(*) AS n FROM x),
       u AS (SELECT i, lo * pow(hi / lo, i / 249) AS u, n FROM e, (SELECT unnest(generate_series(0, 249)) AS i))
       SELECT i::INT AS i, round(u, 6) AS u, round(count(*) / n, 6) AS share FROM u JOIN x ON x.x > u.u WHERE i < 249 GROUP BY i, u, n""")
def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    # the last step is the largest value itself, which no value exceeds but by rounding
    return S.survival(G.lineitem_panel(spark, sf), "basis").where("i < 249").select("i", r6("u", "u"), r6("share", "share"))


@query(f"WITH {EVENTS} SELECT make_timestamp(s // 43200 * 43200000000) AS t, round(min(basis), 6) AS lo, round(max(basis), 6) AS hi, round(median(basis), 6) AS mid FROM p GROUP BY 1")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return S.envelope(G.events_panel(spark, sf), "basis", 43_200).select(O.stamp("s").alias("t"), r6("lo", "lo"), r6("hi", "hi"), r6("mid", "mid"))


@query(f"""WITH {LINEITEM}, y AS (SELECT s // 86400 // 30 AS cell, count(*) AS n, sum(basis) AS z, sum(basis * basis) AS zz FROM p GROUP BY 1 HAVING count(*) >= 10),
       t AS (SELECT count(*) AS days, sum(n)::BIGINT AS n, sum(z) AS z, sum(greatest(0, zz - z * z / n)) AS w, sum(z * z / n) AS q FROM y)
       SELECT days, n, round(w / n, 6) AS within, round(q / n - pow(z / n, 2), 6) AS between, round((q / n - pow(z / n, 2)) / (w / n + q / n - pow(z / n, 2)), 6) AS share FROM t""")
def variance_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf).withColumn("cell", F.floor(F.col("s") / DAY / 30))
    return S.variance_decomposition(p, "cell", "basis", 10).select("days", "n", r6("within", "within"), r6("between", "between"), r6("share", "share"))


@query(f"""WITH {EVENTS}, a AS (SELECT *, lag(s) OVER (ORDER BY s) AS prev FROM p), b AS (SELECT *, row_number() OVER (ORDER BY s) AS rn, coalesce(s - prev = 600, false) AS adj FROM a),
       c AS (SELECT *, {', '.join(f'rn - max(CASE WHEN {g}_fresh OR NOT adj THEN rn END) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {g}_quote_age' for g in 'abc')} FROM b)
       SELECT {T} AS t, a_quote_age, b_quote_age, c_quote_age, greatest(a_quote_age, b_quote_age, c_quote_age) AS max_age FROM c""")
def quote_age(spark: SparkSession, sf: str) -> DataFrame:
    d = R.quote_ages(G.events_panel(spark, sf), STEP, DAY)
    return d.select(O.stamp("s").alias("t"), *(f"{g}_quote_age" for g in "abc"), "max_age")


@query(f"""WITH {EVENTS}, d AS (SELECT *, s % 86400 NOT BETWEEN 61200 AND 62999 AS ok, s // 86400 AS day FROM p),
       ch AS (SELECT *, coalesce(s - lag(s) OVER w = 600 AND ok AND lag(ok) OVER w AND day = lag(day) OVER w, false) AS chain FROM d WINDOW w AS (ORDER BY s)),
       r AS (SELECT *, sum((NOT chain)::INT) OVER (ORDER BY s) AS run FROM ch), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s) - 1 AS pos FROM r),
       u AS (SELECT * FROM n WHERE ok AND pos >= 3), v AS (SELECT *, count(*) OVER (PARTITION BY day) AS c FROM u)
       SELECT {T} AS t, day, pos FROM v WHERE c >= 50""")
def usable_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = G.events_panel(spark, sf).withColumn("day", F.floor(F.col("s") / DAY))
    u = R.usable_rows(p, ~R.in_window(61_200, 63_000), F.col("day"), 2, STEP, DAY)
    return R.drop_small_cells(u, ["day"], 50).select(O.stamp("s").alias("t"), "day", "pos")


@query(f"""WITH {EVENTS}, x AS (SELECT unnest([1704200000, 1705000000, 1706012345])::BIGINT AS asked)
       SELECT asked, s AS nearest, basis FROM x, p QUALIFY row_number() OVER (PARTITION BY asked ORDER BY abs(s - asked), s) = 1""")
def nearest_asof(spark: SparkSession, sf: str) -> DataFrame:
    p = G.events_panel(spark, sf).select("s", "basis")
    at = [1_704_200_000, 1_705_000_000, 1_706_012_345]
    # a fixed list of times: one aggregate over the panel
    best = [F.min_by(F.struct("s", "basis"), F.struct(F.abs(F.col("s") - x), "s")).alias(f"x{i}") for i, x in enumerate(at)]
    one = p.agg(*best).select(F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("asked"), F.col(f"x{i}").alias("v")) for i, x in enumerate(at)))).alias("r"))
    return one.select("r.asked", F.col("r.v.s").alias("nearest"), F.col("r.v.basis").alias("basis"))
