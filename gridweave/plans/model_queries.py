"""Queries on error-correction models, lead and lag, sweeps, gates and streams, with their oracles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q
from gridweave.functions.special import divided
from gridweave.functions.tables import shared_folder, stored
from gridweave.operators import causality as K
from gridweave.operators import changepoint as C
from gridweave.operators import episodes as E
from gridweave.operators import grid as G
from gridweave.operators import reconcile as X
from gridweave.operators import runs as R
from gridweave.operators import stats as S
from gridweave.operators import vecm as V
from gridweave.plans import dislocation_queries as D
from gridweave.plans.dislocation_queries import BANDED, STRETCH
from gridweave.plans.panel_queries import AGES, DAY, IMPLIED, MONTH, MONTHS, STEP, month, r6
from gridweave.plans.panel_sql import EVENTS, LINEITEM
from gridweave.sources import panels as P
from gridweave.streaming import ticks as ST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- models -----------------------------------------------------------------------------------------
YEAR = 365


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf).withColumn("cell", F.floor(F.col("s") / DAY / YEAR))
    return stored(V.with_logs(p, DAY, MONTHS), "rows")


BLOCK = 31  #: rows of a block sum
LAGS = 3  #: lags of the whole-sample models


def designed(rows: DataFrame, p: int, basis_lags: int = 0, least: int = 50, with_runs: bool = False) -> DataFrame:
    return V.design(rows, p, DAY, MONTHS, F.col("z").isNotNull(), F.col("cell"), least, basis_lags, with_runs=with_runs).transform(stored)


LOGS = f"""{LINEITEM}, lg AS (SELECT s, s // 86400 // 365 AS cell, ln(a_mid) AS xa, ln(b_mid) AS xb, ln(c_mid) AS xc FROM p),
dx AS (SELECT x.s, x.cell, 1e4 * (0.0 + -1 * x.xa + -1 * x.xb + x.xc) AS z, 1e4 * (x.xa - y.xa) AS da, 1e4 * (x.xb - y.xb) AS db, 1e4 * (x.xc - y.xc) AS dc FROM lg x LEFT JOIN lg y ON y.s = x.s - 86400)"""

DESIGN = f"""{LOGS}, rw AS (SELECT x.s, x.cell, y.z AS z1, x.da, x.db, x.dc, y.da AS da1, y.db AS db1, y.dc AS dc1 FROM dx x JOIN dx y ON y.s = x.s - 86400 JOIN dx w ON w.s = x.s - 172800 WHERE y.cell = x.cell AND w.cell = x.cell),
ad AS (SELECT *, count(*) OVER (PARTITION BY cell) AS size FROM rw), ce AS (SELECT s, cell, z1 - avg(z1) OVER c AS z1, da - avg(da) OVER c AS dx_a, db - avg(db) OVER c AS dx_b, dc - avg(dc) OVER c AS dx_c, da1 AS dx_a_1, db1 AS dx_b_1, dc1 AS dx_c_1, 1.0 AS const FROM ad WHERE size >= 50 WINDOW c AS (PARTITION BY cell))"""

NAMES = ["const", "z1", "dx_a_1", "dx_b_1", "dx_c_1", "dx_a", "dx_b", "dx_c"]


@query(f"WITH {DESIGN}, gm AS (SELECT " + ", ".join(f"sum({a} * {b}) AS {a}__{b}" for k, a in enumerate(NAMES) for b in NAMES[k:]) + " FROM ce) " + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round({a}__{b} / greatest(1, (SELECT count(*) FROM ce)), 4) + 0.0 AS v FROM gm" for k, a in enumerate(NAMES) for b in NAMES[k:] if "const" not in (a, b) or a == b))
def vecm_gram_p1(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of the design of one lag; the centred columns' sums with the constant are 0 but for rounding, and left out."""
    d = designed(model_rows(spark, sf), 1)
    g = V.gram_sql(d, NAMES).where("i <> 'const' AND j <> 'const' OR i = j")
    return g.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("i", "j", (F.round(F.col("v") / F.greatest(F.lit(1), F.col("n")), 4) + F.lit(0.0)).alias("v"))  # one row


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query()
def vecm_full(spark: SparkSession, sf: str) -> DataFrame:
    d = designed(model_rows(spark, sf), 3)
    f = V.fit(d, 3)
    extra = [("all", g, "closure share", float(s)) for g, s in V.closure_shares(f).items()]
    extra += [("all", "z", "radius", f.radius), ("all", "z", "half life", f.half_life), ("all", "z", "one-step half life", f.one_step)]
    return frame(spark, V.coefficients(f, "all") + extra, "regime string, equation string, term string, coef double")


@query()
def hac_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Adjustment coefficients with robust intervals, whether their signs close a gap, and the speed of closing."""
    d = designed(model_rows(spark, sf), LAGS, with_runs=True)
    return frame(spark, V.exogeneity(d, V.fit(d, LAGS), "all", BLOCK, DAY, MONTHS), V.EXOGENEITY)


@query()
def residual_acf(spark: SparkSession, sf: str) -> DataFrame:
    d = designed(model_rows(spark, sf), LAGS, with_runs=True)
    return V.residual_acf(d, V.fit(d, LAGS), 20, DAY, MONTHS)


#: The model without lags has one slope an equation, which SQL can write down.
SLOPES = f"""{LOGS}, rw AS (SELECT x.s, x.cell, y.z AS z1, x.da, x.db, x.dc FROM dx x JOIN dx y ON y.s = x.s - 86400 WHERE y.cell = x.cell), ad AS (SELECT *, count(*) OVER (PARTITION BY cell) AS size FROM rw),
ce AS (SELECT s, cell, z1 - avg(z1) OVER c AS z1, da - avg(da) OVER c AS a, db - avg(db) OVER c AS b, dc - avg(dc) OVER c AS c FROM ad WHERE size >= 50 WINDOW c AS (PARTITION BY cell)),
sl AS (SELECT count(*) AS n, sum(z1 * z1) AS zz, sum(z1 * a) / sum(z1 * z1) AS aa, sum(z1 * b) / sum(z1 * z1) AS ab, sum(z1 * c) / sum(z1 * z1) AS ac FROM ce),
us AS (SELECT s, cell, z1, a - aa * z1 AS a, b - ab * z1 AS b, c - ac * z1 AS c FROM ce, sl)"""


def slopes(spark: SparkSession, sf: str) -> tuple[DataFrame, V.Fit]:
    d = designed(model_rows(spark, sf), 0, with_runs=True)
    return d, V.fit(d, 0)


@query(f"""WITH {SLOPES}, lg1 AS (SELECT unnest(generate_series(1, 10)) AS lag), pr AS (SELECT lag, x.a, x.b, x.c, y.a AS pa, y.b AS pb, y.c AS pc FROM us x, lg1, us y WHERE y.s = x.s - lag * 86400 AND y.cell = x.cell)
       {' UNION ALL '.join(f"SELECT '{g}' AS leg, lag::INT AS lag, round(corr({g}, p{g}), 6) AS acf, count(*) AS pairs FROM pr GROUP BY lag" for g in 'abc')}""")
def residual_acf_slopes(spark: SparkSession, sf: str) -> DataFrame:
    d, f = slopes(spark, sf)
    return V.residual_acf(d, f, 10, DAY, MONTHS).select("leg", "lag", r6("acf", "acf"), "pairs")


@query(f"""WITH {SLOPES}, bl AS (SELECT count(*) OVER w AS k, sum(z1 / zz * a) OVER w AS a, sum(z1 / zz * b) OVER w AS b, sum(z1 / zz * c) OVER w AS c FROM us, sl WINDOW w AS (PARTITION BY cell ORDER BY s RANGE BETWEEN {(BLOCK - 1) * 86400} PRECEDING AND CURRENT ROW)),
       va AS (SELECT sum(a * a) / {BLOCK} * n / (n - 2) AS a, sum(b * b) / {BLOCK} * n / (n - 2) AS b, sum(c * c) / {BLOCK} * n / (n - 2) AS c, sum((c - a - b) * (c - a - b)) / {BLOCK} * n / (n - 2) AS l FROM bl, sl WHERE k = {BLOCK} GROUP BY n)
       SELECT 'a' AS term, round(aa, 6) AS coef, round(sqrt(a), 6) AS se FROM va, sl UNION ALL SELECT 'b', round(ab, 6), round(sqrt(b), 6) FROM va, sl UNION ALL SELECT 'c', round(ac, 6), round(sqrt(c), 6) FROM va, sl
       UNION ALL SELECT 'lambda', round(ac - aa - ab, 6), round(sqrt(l), 6) FROM va, sl""")
def hac_slopes(spark: SparkSession, sf: str) -> DataFrame:
    d, f = slopes(spark, sf)
    s, w = V.hac(d, f, BLOCK, DAY, MONTHS), np.array(V.WEIGHTS)
    rows = [(g, float(a), float(np.sqrt(s[k, k]))) for k, (g, a) in enumerate(zip(V.LEGS, f.alpha, strict=True))]
    return frame(spark, [*rows, ("lambda", f.lam, float(np.sqrt(w @ s @ w)))], "term string, coef double, se double").select("term", r6("coef", "coef"), r6("se", "se"))


@query(f"""WITH {LOGS}, bl AS (SELECT s, count(*) OVER w AS k, sum(z) OVER w AS z, sum(z * z) OVER w AS zz FROM dx WINDOW w AS (PARTITION BY cell ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW))
       SELECT s // 86400 AS day, round(z, 2) AS z, round(zz / 1e6, 4) AS zz FROM bl WHERE k = 31""")
def block_sums(spark: SparkSession, sf: str) -> DataFrame:
    d = model_rows(spark, sf).select("s", F.col("cell").alias("run"), "z", (F.col("z") * F.col("z")).alias("zz"))
    return V.block_sums(d, ["z", "zz"], BLOCK, DAY, MONTHS).select(F.floor(F.col("s") / DAY).alias("day"), F.round("z", 2).alias("z"), F.round(F.col("zz") / 1e6, 4).alias("zz"))


@query()
def daily_vecm(spark: SparkSession, sf: str) -> DataFrame:
    """A fit for each cell; on this panel of days a cell is a year."""
    return V.daily(designed(model_rows(spark, sf), 1), 1, 100)


@query()
def block_granger(spark: SparkSession, sf: str) -> DataFrame:
    tests = K.leg_tests(designed(model_rows(spark, sf), 2, basis_lags=2, with_runs=True), 2, DAY, MONTHS, BLOCK)
    return K.holm(spark.createDataFrame(pd.DataFrame(tests)), "p")


@query(f"""WITH {LOGS}, rn AS (SELECT *, 0.0 + -1 * da + -1 * db + dc AS dz FROM dx), lgs AS (SELECT unnest(generate_series(-10, 10)) AS lag)
       SELECT lag::INT AS lag, count(*) AS n, round(corr(x.dz, y.da), 6) AS corr FROM lgs, rn x JOIN rn y ON y.s = x.s - lag * 86400 WHERE x.dz IS NOT NULL AND y.da IS NOT NULL GROUP BY lag""")
def lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    d = K.increments_in_runs(p, DAY, MONTHS).withColumn("dz", -F.col("dx_a") - F.col("dx_b") + F.col("dx_c"))
    return K.cross_correlation(d, "dz", "dx_a", 10, DAY, MONTHS).select("lag", "n", r6("corr", "corr"))


@query(f"""WITH {LOGS}, rn AS (SELECT *, 0.0 + -1 * da + -1 * db + dc AS dz FROM dx), lgs AS (SELECT unnest(generate_series(-10, 10)) AS lag),
       cc AS (SELECT lag, count(*) AS n, corr(x.dz, y.da) AS c FROM lgs, rn x JOIN rn y ON y.s = x.s - lag * 86400 WHERE x.dz IS NOT NULL AND y.da IS NOT NULL GROUP BY lag)
       SELECT u.lag::INT AS lag, u.n, round(u.c - d.c, 6) AS diff, round(2 / sqrt(u.n), 6) AS band, round((sqrt(2 * ln(10)) + 0.7) / sqrt(u.n), 6) AS wide_band FROM cc u JOIN cc d ON d.lag = -u.lag WHERE u.lag > 0""")
def lead_lag_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    d = K.increments_in_runs(p, DAY, MONTHS).withColumn("dz", -F.col("dx_a") - F.col("dx_b") + F.col("dx_c"))
    return K.asymmetry(K.cross_correlation(d, "dz", "dx_a", 10, DAY, MONTHS), 10).select("lag", "n", *(r6(c, c) for c in ("diff", "band", "wide_band")))


@query("""WITH t AS (SELECT event_type, dayofweek(ts)::INT + 1 AS d, avg(value) / 500 AS p FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type, d) AS r, count(*) OVER () AS m FROM t)
       SELECT event_type, d, round(p, 6) AS p, round(max(least(1, (m - r + 1) * p)) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM r""")
def holm(spark: SparkSession, sf: str) -> DataFrame:
    e = P.table(spark, sf, "events").groupBy("event_type", F.dayofweek("ts").alias("d")).agg((F.avg("value") / 500).alias("p"))
    return K.holm(e, "p").select("event_type", "d", r6("p", "p"), r6("p_holm", "p_holm"))


@query(f"WITH {LOGS} SELECT x.s // 86400 AS day, round(x.da, 4) AS own, round(y.da, 4) AS placebo FROM dx x JOIN dx y ON y.s = x.s + 604800 WHERE y.da IS NOT NULL AND x.da IS NOT NULL")
def placebo_shift(spark: SparkSession, sf: str) -> DataFrame:
    d = model_rows(spark, sf).withColumn("own", F.col("dx_a"))
    return K.with_placebo(d, "a", 7).where("own is not null").select(F.floor(F.col("s") / DAY).alias("day"), F.round("own", 4).alias("own"), F.round("dx_a", 4).alias("placebo"))


@query(f"""WITH {LOGS}, v AS (SELECT stddev_samp(da) AS sa, stddev_samp(db) AS sb, stddev_samp(dc) AS sc, corr(da, db) AS ab, corr(da, dc) AS ac, corr(db, dc) AS bc FROM dx WHERE da IS NOT NULL),
       r AS (SELECT corr(x.z, y.z) AS rho FROM dx x JOIN dx y ON y.s = x.s - 86400), m AS (SELECT stddev_samp(z) AS sd FROM dx),
       pq AS (SELECT sqrt(sa * sa + sb * sb + sc * sc + 2 * ab * sa * sb - 2 * ac * sa * sc - 2 * bc * sb * sc) AS e, rho, sd FROM v, r, m)
       SELECT round(e, 4) AS innovation, round(rho, 6) AS rho, round(e / sqrt(1 - rho * rho), 4) AS predicted, round(sd, 4) AS measured, e / sqrt(1 - rho * rho) / sd BETWEEN 0.7 AND 1.4 AS agrees FROM pq""")
def normalisation(spark: SparkSession, sf: str) -> DataFrame:
    d = model_rows(spark, sf)
    x = d.where("dx_a is not null").agg(*(F.stddev_samp(f"dx_{g}").alias(f"s{g}") for g in "abc"), F.corr("dx_a", "dx_b").alias("ab"), F.corr("dx_a", "dx_c").alias("ac"), F.corr("dx_b", "dx_c").alias("bc"))
    rho = S.ar1(d, [], "z", DAY, MONTHS).select("rho")
    one = x.crossJoin(rho).crossJoin(d.agg(F.stddev_samp("z").alias("sd")))  # one row each
    e = F.expr("sqrt(sa * sa + sb * sb + sc * sc + 2 * ab * sa * sb - 2 * ac * sa * sc - 2 * bc * sb * sc)")
    predicted = e / F.sqrt(1 - F.col("rho") * F.col("rho"))
    return one.select(F.round(e, 4).alias("innovation"), r6("rho", "rho"), F.round(predicted, 4).alias("predicted"), F.round("sd", 4).alias("measured"), (predicted / F.col("sd")).between(0.7, 1.4).alias("agrees"))


# -- segments and sweeps ------------------------------------------------------------------------------
REPLICATES = 100


@query()
def null_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The series and simulated ones without a change: the model picked, M2 against M0, and the size of M2's shift."""
    return C.null_calibration(D.turnover(spark, sf), D.SPAN * DAY, D.MIN_SEGMENT, REPLICATES)


CELLS = f"{LINEITEM}, ce AS (SELECT s // 86400 // 30 AS cell, count(*) AS n, sum(basis) AS z, sum(basis * basis) AS zz FROM p GROUP BY 1)"


@query(f"""WITH {CELLS}, c0 AS (SELECT min(cell) AS c FROM ce), bo AS (SELECT c + 10 + 2 * i AS onset, c + 10 + 2 * i + 20 + 5 * j AS back FROM c0, generate_series(0, 7) a(i), generate_series(0, 3) b(j)),
       r AS (SELECT onset, back, cell >= onset AND cell < back AS inside, ce.* FROM bo, ce), t AS (SELECT onset, back, inside, count(*) AS days, sum(n)::BIGINT AS n, sum(z) AS z, sum(greatest(0, zz - z * z / n)) AS w, sum(z * z / n) AS q FROM r GROUP BY 1, 2, 3)
       SELECT onset, back, inside, days, n, round(w / n, 6) AS within, round(greatest(0, q / n - pow(z / n, 2)), 6) AS between, round(greatest(0, q / n - pow(z / n, 2)) / (w / n + greatest(0, q / n - pow(z / n, 2))), 6) AS share FROM t WHERE days >= 2""")
def boundary_sweep(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("basis")
    cells = G.lineitem_panel(spark, sf).groupBy(F.floor(F.col("s") / DAY / 30).alias("cell")).agg(F.count("*").alias("n"), F.sum(x).alias("z"), F.sum(x * x).alias("zz")).transform(stored)
    i, j = spark.range(8).select(F.col("id").alias("i")), spark.range(4).select(F.col("id").alias("j"))
    onset = F.col("c") + 10 + 2 * F.col("i")
    bounds = cells.agg(F.min("cell").alias("c")).crossJoin(i).crossJoin(j).select(onset.alias("onset"), (onset + 20 + 5 * F.col("j")).alias("back"))  # 32 rows
    s = X.sweep(cells, bounds, 100)
    return s.select("onset", "back", "inside", "days", "n", r6("within", "within"), r6("between", "between"), r6("share", "share"))


DAYS = f"{LINEITEM}, ce AS (SELECT s // 86400 // 4 AS cell, count(*) AS n, sum(basis) AS z, sum(basis * basis) AS zz FROM p GROUP BY 1)"
EVERY = 2  #: cells of four days between boundaries


@query(f"""WITH {DAYS}, bo AS (SELECT a.cell AS onset, b.cell AS back FROM ce a JOIN ce b ON a.cell < b.cell WHERE a.cell % {EVERY} = 0 AND b.cell % {EVERY} = 0),
       ru AS (SELECT cell, count(*) OVER w AS days, sum(n) OVER w AS n, sum(z) OVER w AS z, sum(greatest(0, zz - z * z / n)) OVER w AS w, sum(z * z / n) OVER w AS q FROM ce WINDOW w AS (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       ex AS (SELECT cell, days - 1 AS days, ru.n - ce.n AS n, ru.z - ce.z AS z, ru.w - greatest(0, ce.zz - ce.z * ce.z / ce.n) AS w, ru.q - ce.z * ce.z / ce.n AS q FROM ru JOIN ce USING (cell)), tt AS (SELECT count(*) AS days, sum(n) AS n, sum(z) AS z, sum(greatest(0, zz - z * z / n)) AS w, sum(z * z / n) AS q FROM ce),
       sd AS (SELECT onset, back, true AS inside, y.days - x.days AS days, y.n - x.n AS n, y.z - x.z AS z, y.w - x.w AS w, y.q - x.q AS q FROM bo JOIN ex x ON x.cell = onset JOIN ex y ON y.cell = back
              UNION ALL SELECT onset, back, false, tt.days - y.days + x.days, tt.n - y.n + x.n, tt.z - y.z + x.z, tt.w - y.w + x.w, tt.q - y.q + x.q FROM bo JOIN ex x ON x.cell = onset JOIN ex y ON y.cell = back, tt),
       ok AS (SELECT onset, back FROM sd GROUP BY 1, 2 HAVING min(n) >= 40)
       SELECT onset, back, inside, days, n::BIGINT AS n, round(greatest(0, w) / n, 4) AS within, round(greatest(0, q / n - pow(z / n, 2)), 4) AS between FROM sd JOIN ok USING (onset, back) WHERE days >= 2""")
def boundary_sweep_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep over all pairs of boundaries eight days apart, some fifty thousand."""
    x = F.col("basis")
    cells = G.lineitem_panel(spark, sf).groupBy(F.floor(F.col("s") / DAY / 4).alias("cell")).agg(F.count("*").alias("n"), F.sum(x).alias("z"), F.sum(x * x).alias("zz")).transform(stored)
    at = cells.where(F.col("cell") % EVERY == 0)
    bounds = at.select(F.col("cell").alias("onset")).join(at.select(F.col("cell").alias("back")), F.col("onset") < F.col("back"))  # the pairs are what is asked for
    s = X.sweep(cells, bounds, 40)
    return s.select("onset", "back", "inside", "days", "n", F.round("within", 4).alias("within"), F.round("between", 4).alias("between"))


@query(f"""WITH {LINEITEM}, m AS (SELECT {MONTH} AS month, count(*) AS n, stddev_samp(basis) AS sd FROM p GROUP BY 1 HAVING count(*) >= 20), r AS (SELECT *, rank() OVER (ORDER BY sd DESC) AS rank FROM m)
       SELECT month, n, round(sd, 6) AS sd, rank::INT AS rank, 'top' AS "end" FROM (SELECT * FROM r ORDER BY sd DESC LIMIT 5) UNION ALL SELECT month, n, round(sd, 6), rank::INT, 'bottom' FROM (SELECT * FROM r ORDER BY sd LIMIT 5)""")
def daily_extremes(spark: SparkSession, sf: str) -> DataFrame:
    m = G.lineitem_panel(spark, sf).groupBy(month().alias("month")).agg(F.count("*").alias("n"), F.stddev_samp("basis").alias("sd")).where("n >= 20")
    return X.extremes(m, "sd", 5).select("month", "n", r6("sd", "sd"), "rank", "end")


@query(f"""WITH {LINEITEM}, l AS (SELECT s // 86400 // 600 AS segment, basis FROM p), m AS (SELECT segment, median(basis) AS m FROM l GROUP BY 1), d AS (SELECT segment, count(*) AS n, 1.4826 * median(abs(basis - m)) AS mad FROM l JOIN m USING (segment) GROUP BY 1),
       t AS (SELECT arg_max(segment, mad) AS top FROM d) SELECT segment, n, round(mad, 6) AS mad, CASE WHEN segment = top THEN 'stress' WHEN (SELECT count(*) FROM d) <= 2 THEN 'calm' WHEN segment < top THEN 'pre' ELSE 'post' END AS role FROM d, t""")
def regime_roles(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf).select(F.floor(F.col("s") / DAY / 600).alias("segment"), "basis")
    return X.widest(p, "segment", "basis").select("segment", "n", r6("mad", "mad"), "role")


@query(f"""WITH {STRETCH} SELECT ((st.s - peak_s) // 600)::BIGINT AS horizon, count(*) AS episodes, round(median(abs(st.z) / abs(peak)), 6) AS decay FROM own JOIN st ON st.stretch = own.stretch AND st.s BETWEEN peak_s AND peak_s + 7200 GROUP BY 1""")
def decay_traces(spark: SparkSession, sf: str) -> DataFrame:
    p, e = D.found(spark, sf)
    rows = E.around_peak(p, e, "z", 0, 7_200, STEP, DAY)
    return rows.groupBy(F.floor((F.col("s") - F.col("peak_s")) / STEP).alias("horizon")).agg(F.count("*").alias("episodes"), r6(F.median(F.abs("z") / F.abs("peak")), "decay"))


# -- cross-checks ---------------------------------------------------------------------------------------
@query(f"""WITH {BANDED}, u AS (SELECT era, max(abs(z)) AS ungated FROM bf GROUP BY 1), gd AS (SELECT era, max(abs(z)) AS gated FROM bf WHERE max_age <= 1 GROUP BY 1)
       SELECT era, ungated, gated, round(gated / ungated, 6) AS ratio FROM u LEFT JOIN gd USING (era)""")
def freshness_extremes(spark: SparkSession, sf: str) -> DataFrame:
    d = D.banded(spark, sf)
    return d.groupBy("era").agg(F.max(F.abs("z")).alias("ungated"), F.max(F.when(F.col("max_age") <= 1, F.abs("z"))).alias("gated")).withColumn("ratio", F.round(F.col("gated") / F.col("ungated"), 6))


@query(f"""WITH {BANDED}, m AS (SELECT era, median(z) AS m FROM bf GROUP BY 1), e AS (SELECT era, 1.4826 * median(abs(z - m)) AS mad, median(band) AS band FROM bf JOIN m USING (era) GROUP BY 1), t AS (SELECT * FROM e ORDER BY mad DESC LIMIT 1)
       SELECT t.era AS wide_era, e.era AS other_era, round(t.mad / e.mad, 6) AS mad_ratio, round(t.band / e.band, 6) AS band_ratio, round(t.mad / e.mad / (t.band / e.band), 6) AS ratio_of_ratios,
       CASE WHEN t.mad / e.mad > t.band / e.band THEN 'gap grew more than cost' ELSE 'cost grew at least as much' END AS reading FROM e, t WHERE e.era <> t.era""")
def band_gap_ratios(spark: SparkSession, sf: str) -> DataFrame:
    d = D.banded(spark, sf)
    e = S.mad(d, ["era"], "z").join(Q.median(d, ["era"], "band", "band").drop("n"), "era").select("era", "mad", "band").transform(stored)
    t = e.orderBy(F.desc("mad"), "era").limit(1).select(F.col("era").alias("wide_era"), F.col("mad").alias("_m"), F.col("band").alias("_b"))
    both = e.crossJoin(F.broadcast(t)).where("era <> wide_era")  # one row
    mr, br = F.col("_m") / F.col("mad"), F.col("_b") / F.col("band")
    return both.select("wide_era", F.col("era").alias("other_era"), r6(mr, "mad_ratio"), r6(br, "band_ratio"), r6(mr / br, "ratio_of_ratios"), F.when(mr > br, "gap grew more than cost").otherwise("cost grew at least as much").alias("reading"))


GAP_MOST, BIAS_MOST = 100.0, 1.0


def implied() -> dict[str, Column]:
    """The gaps of ``IMPLIED``; prices of events may be 0, which makes gaps infinite or NaN."""
    a, b, c = (F.col(f"{g}_mid") for g in "abc")
    return {"a": divided(c, b) - a, "b": divided(c, a) - b, "c": a * b - c}


STALE, LIVELY = 600, 60  #: rows without a change that are an outage, if the others changed within so many


@query(f"""WITH {AGES}, st AS (SELECT s - lag(s) OVER (ORDER BY s) AS d FROM p), cv AS (SELECT s // 86400 AS d, avg(a_fresh::INT) AS a, avg(b_fresh::INT) AS b, avg(c_fresh::INT) AS c FROM p WHERE dayofweek(make_timestamp(s * 1000000)) BETWEEN 1 AND 5 GROUP BY 1),
       bi AS ({' UNION ALL '.join(f"SELECT s // 86400 AS d, abs(median({x})) AS bias FROM p GROUP BY 1 HAVING count(*) >= 100" for x in IMPLIED.values())}),
       iso AS (SELECT {' + '.join(f"count(*) FILTER ({g}_age > {STALE} AND greatest({', '.join(f'{o}_age' for o in 'abc' if o != g)}) < {LIVELY})" for g in 'abc')} AS n FROM v)
       SELECT 'grid holes' AS "check", count(*)::DOUBLE AS value, count(*) = 0 AS passed FROM st WHERE d <> 600 UNION ALL SELECT 'worst weekday coverage', round(min(least(a, b, c)), 6), min(least(a, b, c)) >= 0.05 FROM cv
       UNION ALL SELECT 'isolated outage', n::DOUBLE, n = 0 FROM iso UNION ALL SELECT 'worst daily bias', round(max(bias), 6), max(bias) <= {BIAS_MOST} FROM bi
       UNION ALL SELECT 'implied gap', round(quantile_cont(abs(c_mid / a_mid - b_mid), 0.999), 6), quantile_cont(abs(c_mid / a_mid - b_mid), 0.999) <= {GAP_MOST} FROM p
       UNION ALL SELECT 'repeated times', (count(*) - count(DISTINCT s))::DOUBLE, count(*) = count(DISTINCT s) FROM p""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(G.events_panel(spark, sf), "panel")
    holes = O.with_previous(p.select("s"), {"prev_s": "s"}, DAY).where(F.col("s") - F.col("prev_s") != STEP).agg(F.count("*").alias("value"))
    weekday = F.dayofweek(O.stamp("s")).between(2, 6)
    cover = p.where(weekday).groupBy(F.floor(F.col("s") / DAY)).agg(F.least(*(F.avg(F.col(f"{g}_fresh").cast("int")) for g in "abc")).alias("w")).agg(F.round(F.min("w"), 6).alias("value"))
    alone = R.isolated(p, DAY, STALE, LIVELY).agg(sum((F.count_if(f"{g}_isolated") for g in "abc"), F.lit(0)).alias("value"))
    each = p.select((F.floor(F.col("s") / DAY)).alias("d"), F.explode(F.array(*(F.struct(F.lit(g).alias("leg"), x.alias("gap")) for g, x in implied().items()))).alias("x")).select("d", "x.*")
    bias = each.groupBy("leg", "d").agg(F.count("*").alias("n"), F.abs(F.median("gap")).alias("m")).where("n >= 100").agg(F.round(F.max("m"), 6).alias("value"))
    gap = Q.quantiles(p, [], F.abs(implied()["b"]), {"q": 0.999}, nan=True).select(F.round("q", 6).alias("value"))
    repeats = p.agg((F.count("*") - F.count_distinct("s")).alias("value"))
    v = F.col("value")
    return X.gate([("grid holes", holes, v == 0), ("worst weekday coverage", cover, v >= 0.05), ("isolated outage", alone, v == 0), ("worst daily bias", bias, v <= BIAS_MOST), ("implied gap", gap, v <= GAP_MOST), ("repeated times", repeats, v == 0)])


@query(f"""WITH {LINEITEM}, x AS ({' UNION ALL '.join(f'''SELECT '{g}' AS leg, s // 86400 // 365 AS era, {g}_mid AS v FROM p''' for g in 'abc')}) PIVOT (SELECT leg, era, round(median(v), 6) AS v FROM x GROUP BY 1, 2) ON leg IN ('a', 'b', 'c') USING max(v) GROUP BY era""")
def median_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = G.lineitem_panel(spark, sf)
    each = p.select(F.floor(F.col("s") / DAY / YEAR).alias("era"), F.explode(F.array(*(F.struct(F.lit(g).alias("leg"), F.col(f"{g}_mid").alias("v")) for g in "abc"))).alias("x")).select("era", "x.*")
    return Q.median(each, ["leg", "era"], "v", "m").groupBy("era").pivot("leg", ["a", "b", "c"]).agg(F.round(F.first("m"), 6))


# -- streams ----------------------------------------------------------------------------------------------
def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all its input is read. Batches are written as Parquet (in complete mode each replaces
    the one before), and its state is kept in the shared folder."""
    at = shared_folder(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out").select(df.columns)


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, value, ts, event_id FROM events)
       SELECT event_type, make_timestamp(h * 3600000000) AS start, value FROM e QUALIFY row_number() OVER (PARTITION BY event_type, h ORDER BY ts DESC, event_id DESC) = 1""")
def stream_downsample(spark: SparkSession, sf: str) -> DataFrame:
    batch = P.table(spark, sf, "events")
    events = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))
    out = drained(ST.last_of_window(events, "at", ["event_type"], ["value"], "1 hour", "10 minutes"), "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "value")
