"""Queries by regime: labels of days from the posterior of 30-day buckets, what is fitted and counted by label, the
sensitivity of segments and bounds, and tables on tables, with their oracles where SQL can say them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q
from gridweave.functions.tables import shared_folder, small, stored
from gridweave.operators import bounds as B
from gridweave.operators import causality as K
from gridweave.operators import changepoint as C
from gridweave.operators import episodes as E
from gridweave.operators import grid as G
from gridweave.operators import labels as L
from gridweave.operators import reconcile as X
from gridweave.operators import runs as R
from gridweave.operators import stats as S
from gridweave.operators import vecm as V
from gridweave.plans import dislocation_queries as D
from gridweave.plans import model_queries as M
from gridweave.plans.dislocation_queries import BANDED, EPISODES, SHUT
from gridweave.plans.panel_queries import CLOSED, DAY, MONTHS, STEP, T, month, r6
from gridweave.plans.panel_sql import EVENTS, LINEITEM
from gridweave.sources import panels as P
from gridweave.sources import reports

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- labels -----------------------------------------------------------------------------------------
BUCKET, SEGMENT = 30 * DAY, 12  #: seconds of a bucket, buckets of the shortest segment
SURE = 0.9


def dispersion(panel: DataFrame) -> DataFrame:
    """s, y: ln of the median distance of the basis in each bucket."""
    cells = S.mad(panel.select((F.floor(F.col("s") / BUCKET) * BUCKET).alias("b"), "basis"), ["b"], "basis", many=True)
    return cells.where("mad > 0").select(F.col("b").alias("s"), F.log("mad").alias("y"))


def posterior(series: DataFrame, model: str = "M3") -> DataFrame:
    """s, p of each bucket under a model."""
    own = small(series.withColumn("key", F.lit("")))  # a row a bucket
    placed = C.folds(own, {"": C.settings(BUCKET, SEGMENT)}, (model,))
    p = C.segment_probabilities(placed, own.groupBy("key").agg(F.count("*").alias("n")), (model,))
    return own.withColumn("i", F.row_number().over(C.W.partitionBy("key").orderBy("s")).cast("long")).join(p, ["key", "i"]).select("s", "p").transform(small)


def chosen_posterior(series: DataFrame, step: int, least: int, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    """s, model, p of each bucket under the one of ``models`` with the largest evidence."""
    own = small(series.withColumn("key", F.lit("")))  # a row a bucket
    p = C.chosen_probabilities(C.folds(own, {"": C.settings(step, least)}, models), own.groupBy("key").agg(F.count("*").alias("n")))
    return own.withColumn("i", F.row_number().over(C.W.partitionBy("key").orderBy("s")).cast("long")).join(p, ["key", "i"]).select("s", "model", "p").transform(small)


def labels(panel: DataFrame) -> DataFrame:
    return L.labelled(panel, posterior(dispersion(panel)), BUCKET)


def labelled_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(G.lineitem_panel(spark, sf), "panel")
    return L.with_labels(p, labels(p))


SERIES = f"""{LINEITEM}, bm AS (SELECT s // {BUCKET} * {BUCKET} AS b, median(basis) AS m FROM p GROUP BY 1), bs AS (SELECT b, 1.4826 * median(abs(basis - m)) AS mad FROM p JOIN bm ON b = s // {BUCKET} * {BUCKET} GROUP BY b),
sr AS (SELECT b AS s, ln(mad) AS y FROM bs WHERE mad > 0)"""
LABELLED = f"""{D.placed_sql(SERIES, BUCKET, SEGMENT)}, w3 AS (SELECT t1, t2, exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M3')) AS w FROM pl WHERE model = 'M3'), wt AS (SELECT sum(w) AS t FROM w3),
c3 AS (SELECT ad.s, coalesce((SELECT sum(w) FROM w3 WHERE t1 <= ad.i), 0) / (SELECT t FROM wt) AS b, coalesce((SELECT sum(w) FROM w3 WHERE t2 <= ad.i), 0) / (SELECT t FROM wt) AS e FROM ad),
gb AS (SELECT unnest(generate_series((SELECT min(s) // {BUCKET} * {BUCKET} FROM p), (SELECT max(s) // {BUCKET} * {BUCKET} FROM p), {BUCKET})) AS s), gf AS (SELECT gb.s, b, e FROM gb LEFT JOIN c3 USING (s)),
gl AS (SELECT s AS bucket, coalesce(last_value(b IGNORE NULLS) OVER (ORDER BY s), first_value(b IGNORE NULLS) OVER (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS b,
       coalesce(last_value(e IGNORE NULLS) OVER (ORDER BY s), first_value(e IGNORE NULLS) OVER (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS e FROM gf),
la AS (SELECT p.*, 1 - b AS p0, b - e AS p1, e AS p2, greatest(1 - b, b - e, e)::FLOAT AS top, (CASE WHEN 1 - b >= b - e AND 1 - b >= e THEN 0 WHEN b - e >= e THEN 1 ELSE 2 END)::TINYINT AS regime FROM p JOIN gl ON bucket = s // {BUCKET} * {BUCKET})"""
SUNDAY = "dayofweek(make_timestamp(s * 1000000)) = 0"


def sunday() -> F.Column:
    return F.dayofweek(O.stamp("s")) == 1


@query(f"WITH {LABELLED} SELECT {T} AS t, regime, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2 FROM la")
def second_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label and its probabilities for every row of the grid, from buckets thirty times as long."""
    p = stored(G.lineitem_panel(spark, sf), "panel")
    return labels(p).select(O.stamp("s").alias("t"), "regime", *(F.round(F.col("p")[i].cast("double"), 4).alias(f"p{i}") for i in range(3)))


@query(f"""WITH {LABELLED} SELECT regime, count(*) AS days, count(*) FILTER (top >= 0.9::FLOAT AND NOT {SUNDAY}) AS sure, count(*) FILTER (top >= 0.5::FLOAT AND NOT {SUNDAY}) AS likely, count(*) FILTER (top >= 0.99::FLOAT) AS certain FROM la GROUP BY 1""")
def label_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled_panel(spark, sf)
    at = lambda x: F.array_max("p") >= F.lit(x).cast("float")
    return d.groupBy("regime").agg(F.count("*").alias("days"), F.count_if(at(SURE) & ~sunday()).alias("sure"), F.count_if(at(0.5) & ~sunday()).alias("likely"), F.count_if(at(0.99)).alias("certain"))


@query(f"""WITH {LABELLED}, ch AS (SELECT *, regime IS DISTINCT FROM lag(regime) OVER (ORDER BY s) AS head FROM la) SELECT regime, make_timestamp(min(s) * 1000000) AS first, make_timestamp(max(s) * 1000000) AS last, count(*) AS rows, count(*) FILTER (head) AS blocks FROM ch GROUP BY 1""")
def label_stretches(spark: SparkSession, sf: str) -> DataFrame:
    d = L.stretches(labelled_panel(spark, sf), MONTHS)
    return d.select("regime", O.stamp("first").alias("first"), O.stamp("last").alias("last"), "rows", "blocks")


@query(f"""WITH {LABELLED}, c AS (SELECT s // 31536000 AS year, regime, count(*) AS n FROM la GROUP BY 1, 2) SELECT year, arg_min(regime, (-n) * 10 + regime) AS mode FROM c GROUP BY 1""")
def label_modes(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled_panel(spark, sf).withColumn("year", F.floor(F.col("s") / 31_536_000))
    return L.modes(d, "year", "regime")


def chosen_sql(series: str, step: int, least: int) -> str:
    """cp: s, model and p (array) of each bucket of ``sr`` under the model of the largest evidence."""
    return f"""{D.placed_sql(series, step, least)}, mx AS (SELECT rho, model, max(ll) AS m, count(*) AS c FROM pl GROUP BY 1, 2), lz AS (SELECT rho, model, any_value(m) + ln(sum(exp(ll - m))) - ln(any_value(c)) AS lz FROM pl JOIN mx USING (rho, model) GROUP BY 1, 2),
mm AS (SELECT model, max(lz) AS m FROM lz GROUP BY 1), zz AS (SELECT model, any_value(m) + ln(sum(exp(lz - m))) AS log_z FROM lz JOIN mm USING (model) GROUP BY 1), bw AS (SELECT arg_max(model, (round(log_z, 9), -substr(model, 2, 1)::INT)) AS model FROM zz),
wb AS (SELECT t1, t2, exp(ll - (SELECT max(ll) FROM pl JOIN bw USING (model))) AS w FROM pl JOIN bw USING (model)),
be AS (SELECT s, i, coalesce((SELECT sum(w) FROM wb WHERE t1 <= ad.i), 0) / (SELECT sum(w) FROM wb) AS b, coalesce((SELECT sum(w) FROM wb WHERE t2 <= ad.i), 0) / (SELECT sum(w) FROM wb) AS e FROM ad),
cp AS (SELECT s, model, CASE model WHEN 'M0' THEN [1.0] WHEN 'M1' THEN [1 - b, b] WHEN 'M2' THEN [1 - b + e, b - e] ELSE [1 - b, b - e, e] END AS p FROM be, bw)"""


def _chosen(d: DataFrame) -> DataFrame:
    return d.select(O.stamp("s").alias("t"), "model", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), F.size("p").alias("labels"), *(F.round(F.get("p", i), 5).alias(f"p{i}") for i in range(3)))


_CHOSEN = "make_timestamp(s * 1000000) AS t, model, (list_position(p, list_max(p)) - 1)::INT AS label, len(p)::INT AS labels, round(p[1], 5) AS p0, round(p[2], 5) AS p1, round(p[3], 5) AS p2 FROM cp"
EARLY = 5  #: of so many parts of the series, the first


@query(f"WITH {chosen_sql(SERIES, BUCKET, SEGMENT)} SELECT {_CHOSEN}")
def chosen_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of buckets whose number follows from the evidence."""
    return _chosen(chosen_posterior(dispersion(G.lineitem_panel(spark, sf)), BUCKET, SEGMENT))


STEPPED = "st AS (SELECT s, y + CASE WHEN i * 5 <= n THEN 6 ELSE 0 END AS y FROM (SELECT *, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM sr))"


@query(f"WITH {chosen_sql(SERIES + ', ' + STEPPED, BUCKET, SEGMENT).replace('FROM sr),', 'FROM st),').replace('FROM sr)', 'FROM sr)').replace('AS adj FROM sr', 'AS adj FROM st')} SELECT {_CHOSEN}")
def chosen_labels_of_a_step(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the first fifth is six units higher: one change."""
    return _chosen(chosen_posterior(stepped(dispersion(G.lineitem_panel(spark, sf))), BUCKET, SEGMENT))


def stepped(series: DataFrame) -> DataFrame:
    d = small(series)  # a row a bucket
    i = F.row_number().over(C.W.orderBy("s"))
    return d.withColumn("i", i).crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("s", (F.col("y") + F.when(F.col("i") * EARLY <= F.col("n"), 6).otherwise(0)).alias("y"))  # one row


CHOSEN_ROWS = f"""{chosen_sql(SERIES, BUCKET, SEGMENT)}, gb AS (SELECT unnest(generate_series((SELECT min(s) // {BUCKET} * {BUCKET} FROM p), (SELECT max(s) // {BUCKET} * {BUCKET} FROM p), {BUCKET})) AS s), gf AS (SELECT gb.s, cp.p AS q FROM gb LEFT JOIN cp USING (s)),
gl AS (SELECT s AS bucket, coalesce(last_value(q IGNORE NULLS) OVER (ORDER BY s), first_value(q IGNORE NULLS) OVER (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM gf),
la AS (SELECT p.*, (list_position(q, list_max(q)) - 1)::INT AS label FROM p JOIN gl ON bucket = s // {BUCKET} * {BUCKET}), lm AS (SELECT label, median(basis) AS m FROM la GROUP BY 1),
ld AS (SELECT label, count(*) AS rows, 1.4826 * median(abs(basis - m)) AS mad FROM la JOIN lm USING (label) GROUP BY 1), lt AS (SELECT arg_max(label, (mad, label)) AS top, count(*) AS k FROM ld)"""


@query(f"WITH {CHOSEN_ROWS} SELECT label, rows, round(mad, 6) AS mad, CASE WHEN label = top THEN 'stress' WHEN k <= 2 THEN 'calm' WHEN label < top THEN 'pre' ELSE 'post' END AS role FROM ld, lt")
def chosen_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The labels that the evidence gives, and what each is: the widest one is under stress."""
    p = stored(G.lineitem_panel(spark, sf), "panel")
    d = L.with_labels(p, chosen(p)).withColumn("label", F.col("regime").cast("int"))
    return X.widest(d, "label", "basis").select("label", F.col("n").alias("rows"), r6("mad", "mad"), "role")


def chosen(panel: DataFrame, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    return L.labelled(panel, chosen_posterior(dispersion(panel), BUCKET, SEGMENT, models).select("s", "p"), BUCKET)


LO, HI = 800_000_000, 900_000_000


@query(f"""WITH {LABELLED} SELECT 'dropped' AS variant, regime, count(*) AS rows FROM la WHERE s < {LO} OR s >= {HI} GROUP BY regime
       UNION ALL SELECT 'moved', CASE WHEN s >= {LO} AND s < {HI} THEN 0 ELSE regime END::TINYINT AS regime, count(*) FROM la GROUP BY 2""")
def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by label with a stretch left out, and with it given another label."""
    d = labelled_panel(spark, sf)
    count = lambda x, name: x.groupBy("regime").agg(F.count("*").alias("rows")).select(F.lit(name).alias("variant"), "regime", "rows")
    return count(L.relabelled(d, LO, HI), "dropped").unionByName(count(L.relabelled(d, LO, HI, 0), "moved"))


@query(f"""WITH {SERIES}, e AS (SELECT median(s)::BIGINT AS event FROM sr) SELECT {T} AS t, round(y, 6) AS y FROM sr, e WHERE s + {BUCKET} <= event""")
def truncated_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets that end before an event (here the middle of the series)."""
    d = small(dispersion(G.lineitem_panel(spark, sf)))
    event = int(d.agg(F.median("s")).first()[0])
    return C.ended_before(d, BUCKET, event).select(O.stamp("s").alias("t"), r6("y", "y"))


# -- what is measured by label ----------------------------------------------------------------------
@query(f"""WITH {LABELLED}, op AS (SELECT *, NOT {SUNDAY} AS ok FROM la), pr AS (SELECT x.*, y.basis AS was, x.basis - y.basis AS dx FROM op x JOIN op y ON y.s = x.s - 86400 AND y.regime = x.regime WHERE x.ok AND y.ok),
       ar AS (SELECT regime, corr(basis, was) AS rho FROM pr GROUP BY 1), sp AS (SELECT regime, dx, lag(dx) OVER (PARTITION BY regime ORDER BY s) AS pdx FROM pr),
       sn AS (SELECT regime, count(*) AS k, corr(dx, pdx) AS r1, covar_samp(dx, pdx) AS c1 FROM sp GROUP BY 1), m AS (SELECT regime, median(basis) AS m FROM op WHERE ok GROUP BY 1),
       tg AS (SELECT regime, count(*) AS rows, count(*) * 24.0::DOUBLE AS hours, 1.4826 * median(abs(basis - m)) AS mad, stddev_samp(basis) AS sd, quantile_cont(abs(basis), 0.999) AS top, max(abs(basis)) AS most FROM op JOIN m USING (regime) WHERE ok GROUP BY 1),
       lv AS (SELECT quantile_cont(abs(basis), 0.95) AS level FROM op WHERE ok), o1 AS (SELECT op.*, abs(basis) > level AS over_, coalesce(s - lag(s) OVER (ORDER BY s) <> 86400, false) AS jump, lag(abs(basis) > level) OVER (ORDER BY s) AS was FROM op, lv WHERE ok),
       o2 AS (SELECT *, sum((over_ AND (NOT coalesce(was, false) OR jump))::INT) OVER (ORDER BY s) AS run FROM o1), pc AS (SELECT min(s) AS lo, max(s) AS hi, arg_min(jump, s) AS jumped FROM o2 WHERE over_ GROUP BY run),
       pm AS (SELECT *, sum((lag_hi IS NULL OR lo - lag_hi > 172800 OR jumped)::INT) OVER (ORDER BY lo) AS ep FROM (SELECT *, lag(hi) OVER (ORDER BY lo) AS lag_hi FROM pc)), es AS (SELECT min(lo) AS lo, max(hi) AS hi FROM pm GROUP BY ep HAVING max(hi) - min(lo) + 86400 >= 86400),
       pk AS (SELECT es.lo, max(abs(o1.basis)) AS peak FROM es JOIN o1 ON o1.s BETWEEN es.lo AND es.hi GROUP BY es.lo), ep AS (SELECT la.regime, count(*) AS episodes, median(peak) AS peak50, max(peak) AS peak_most FROM pk JOIN la ON la.s = pk.lo GROUP BY 1)
       SELECT regime, rows, hours, round(mad, 6) AS mad, round(sd, 6) AS sd, round(top, 6) AS top, round(most, 6) AS most, round(CASE WHEN k > 2 THEN r1 END, 6) AS rho1, round(CASE WHEN k >= 3 AND c1 < 0 THEN sqrt(-c1) END, 6) AS roll_c,
       round(CASE WHEN k > 2 THEN greatest(0, least(1, -2 * r1)) END, 6) AS noise_share, round(rho, 6) AS rho, round(CASE WHEN rho > 0 AND rho < 1 THEN ln(0.5) / ln(rho) END, 6) AS half_life,
       coalesce(episodes, 0) AS episodes, round(100 * coalesce(episodes, 0) / hours, 6) AS per_100_h, round(peak50, 6) AS peak50, round(peak_most, 6) AS peak_most FROM tg LEFT JOIN ar USING (regime) LEFT JOIN sn USING (regime) LEFT JOIN ep USING (regime)""")
def regime_table(spark: SparkSession, sf: str) -> DataFrame:
    """Dispersion, persistence, noise and episodes of each label, by features that did not place the changes."""
    d = stored(labelled_panel(spark, sf).withColumn("ok", ~sunday()), "labelled")
    ok = d.where("ok")
    x = F.abs("basis")
    g = ok.groupBy("regime").agg(F.count("*").alias("rows"), (F.count("*") * 24.0).alias("hours"), F.stddev_samp("basis").alias("sd"), F.max(x).alias("most"))
    g = g.join(S.mad(ok, ["regime"], "basis").drop("n"), "regime").join(Q.quantiles(ok, ["regime"], x, {"top": 0.999}).drop("n"), "regime")
    pairs = O.with_lagged(ok, {"was": ("basis", 1), "wr": ("regime", 1)}, DAY, MONTHS).where("wr = regime").transform(stored)
    level = pairs.groupBy("regime").agg(F.corr("basis", "was").alias("rho"))
    steps = S.serial(pairs.withColumn("dx", F.col("basis") - F.col("was")), ["regime"], "dx", MONTHS, closed_up=True).drop("n")
    cut = E.threshold(ok, "basis", 0.95)
    e = E.episodes(ok.crossJoin(F.broadcast(cut)), "basis", F.col("level"), DAY, 2 * DAY, DAY, MONTHS)  # one row
    eps = e.join(d.select(F.col("s").alias("lo"), "regime"), "lo").groupBy("regime").agg(F.count("*").alias("episodes"), F.median(F.abs("peak")).alias("peak50"), F.max(F.abs("peak")).alias("peak_most"))
    out = g.join(level, "regime", "left").join(steps, "regime", "left").join(eps, "regime", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("long")))
    out = out.withColumns({"half_life": S.half_life(F.col("rho")), "per_100_h": 100 * F.col("episodes") / F.col("hours")})
    return out.select("regime", "rows", "hours", "episodes", *(r6(c, c) for c in ("mad", "sd", "top", "most", "rho1", "roll_c", "noise_share", "rho", "half_life", "per_100_h", "peak50", "peak_most")))


@query(f"""WITH {LABELLED}, tg AS (SELECT regime, count(*)::DOUBLE AS days, stddev_samp(basis) AS sd, max(abs(basis)) AS most FROM la GROUP BY 1), u AS (UNPIVOT tg ON days, sd, most INTO NAME item VALUE v)
       SELECT item, round(max(CASE WHEN regime = 0 THEN v END), 6) AS "0", round(max(CASE WHEN regime = 1 THEN v END), 6) AS "1", round(max(CASE WHEN regime = 2 THEN v END), 6) AS "2" FROM u GROUP BY item""")
def transposed_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = labelled_panel(spark, sf).groupBy("regime").agg(F.count("*").alias("days"), F.stddev_samp("basis").alias("sd"), F.max(F.abs("basis")).alias("most"))
    t = reports.transposed(g, "regime", ["days", "sd", "most"])
    return t.select("item", *(r6(c, c) if c in t.columns else F.lit(None).cast("double").alias(c) for c in ("0", "1", "2")))


GATE = 1
EACH = [("base", SURE, True, GATE, 1), ("with Sundays", SURE, False, GATE, 1), ("half sure", 0.5, True, GATE, 1), ("certain", 0.99, True, GATE, 1), ("any age", SURE, True, None, 1), ("delay 5", SURE, True, GATE, 5), ("no delay", SURE, True, GATE, 0)]


def _variant(name: str, least: float, weekdays: bool, gate: int | None, delay: int) -> str:
    mask = f"x.top >= {least}::FLOAT AND ({not weekdays} OR NOT {SUNDAY.replace('(s *', '(x.s *')})"
    live = "y.s IS NOT NULL" + (f" AND x.max_age <= {gate}" if gate is not None else "")
    return f"""SELECT '{name}' AS variant, x.regime, round(median(x.band), 6) AS band, count(*) FILTER ({live}) AS eligible, count(*) FILTER ({live} AND CASE WHEN x.rich THEN y.e_rich ELSE y.e_cheap END > 0) AS positive
       FROM bl x LEFT JOIN bl y ON y.s = x.s + {delay} * 86400 AND y.regime = x.regime WHERE {mask} GROUP BY x.regime"""


BOUND_LABELS = f"{LABELLED}, {BANDED.replace(LINEITEM + ', ', '', 1)}, bl AS (SELECT bf.*, la.regime, la.top FROM bf JOIN la USING (s))"


def banded_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled_panel(spark, sf)
    return stored(B.with_edges(R.quote_ages(d, DAY, MONTHS)), "banded")


@query(f"WITH {BOUND_LABELS} " + " UNION ALL ".join(_variant(*v) for v in EACH))
def bound_variants(spark: SparkSession, sf: str) -> DataFrame:
    top = F.array_max("p")
    each = [(name, (top >= F.lit(least).cast("float")) & (F.lit(not weekdays) | ~sunday()), F.lit(True) if gate is None else F.col("max_age") <= gate, delay) for name, least, weekdays, gate, delay in EACH]
    return B.variants(banded_labels(spark, sf), each, DAY, MONTHS, "regime").select("variant", "regime", r6("band", "band"), "eligible", "positive")


# -- segments ---------------------------------------------------------------------------------------
MODES = """w1 AS (SELECT t1 AS pos, sum(exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M2'))) AS w FROM pl WHERE model = 'M2' GROUP BY 1), w2 AS (SELECT t2 AS pos, sum(exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M2'))) AS w FROM pl WHERE model = 'M2' GROUP BY 1),
mo AS (SELECT (SELECT pos FROM w1 ORDER BY round(w / (SELECT sum(w) FROM w1), 12) DESC, pos LIMIT 1) AS a, (SELECT pos FROM w2 ORDER BY round(w / (SELECT sum(w) FROM w2), 12) DESC, pos LIMIT 1) AS b)"""


@query(f"""WITH {D.PLACED}, {MODES}, sg AS (SELECT CASE WHEN i >= a AND i < b THEN 1 ELSE 0 END AS g, avg(y) AS m, count(*) AS n FROM ad, mo GROUP BY 1)
       SELECT (SELECT a FROM mo) AS onset, (SELECT b FROM mo) AS back, round(exp(max(m) - min(m)), 6) AS ratio FROM sg""")
def shift_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the shift of two changes, cut at their modal places."""
    own = small(D.turnover(spark, sf).withColumn("key", F.lit("")))
    return C.fits(own, D.placed(spark, sf), "M2").select("onset", "back", r6("ratio", "ratio"))


@query(f"""WITH {D.PLACED}, w AS (SELECT t1 AS bucket, sum(exp(ll - (SELECT max(ll) FROM pl WHERE model = 'M1'))) AS w FROM pl WHERE model = 'M1' GROUP BY t1), q AS (SELECT bucket, w / sum(w) OVER () AS prob FROM w),
       c AS (SELECT *, sum(prob) OVER (ORDER BY bucket) AS cum FROM q), wi AS (SELECT a.bucket AS lo, b.bucket AS hi FROM c a JOIN c b ON b.bucket >= a.bucket WHERE b.cum - a.cum + a.prob >= 0.95 - 1e-12 ORDER BY hi - lo, lo LIMIT 1),
       pv AS (SELECT i, s, lag(s) OVER (ORDER BY s) AS ps, adj FROM ad)
       SELECT make_timestamp((SELECT coalesce(ps + {D.SPAN * DAY}, s) FROM pv, wi WHERE i = lo) * 1000000) AS after, make_timestamp((SELECT s FROM pv, wi WHERE i = hi) * 1000000) AS until, (SELECT bool_or(NOT adj) FROM pv, wi WHERE i BETWEEN lo AND hi) AS spans_gap""")
def change_bracket(spark: SparkSession, sf: str) -> DataFrame:
    window = C.credible(C.change_marginal(D.placed(spark, sf), "M1", "t1"))
    d = C.bracket(D.turnover(spark, sf), window, D.SPAN * DAY)
    return d.select(O.stamp("after").alias("after"), O.stamp("until").alias("until"), "spans_gap")


HOURS = 3_600


def variants(panel: DataFrame, event: int, bucket: int = 6 * HOURS) -> tuple[DataFrame, dict]:
    """key, s, y of the twenty series whose segments are compared, and the settings of each."""
    def features(size: int = bucket, shut: tuple[int, int] = SHUT) -> DataFrame:
        return small(C.bucket_features(panel, "basis", size, STEP, shut, DAY))  # a row a bucket

    def series(f: DataFrame, value, size: int = bucket, coverage: float = 0.9, moves: int = 6, settled: int = 4, raw: bool = False) -> DataFrame:
        d = C.admitted(f, coverage, moves).select("s", value.alias("v")).where("v is not null")
        return d.withColumns({"size": F.lit(size), "settled": F.lit(settled), "raw": F.lit(raw)})

    f, mad, least = features(), F.log("mad"), 4
    own = lambda size=bucket, n=least, **more: C.settings(size, n, **more)
    each = {
        "base": (series(f, mad), own()), "no diurnal adjustment": (series(f, mad, raw=True), own()), "log IQR": (series(f, F.log("iqr")), own()), "no reopening adjustment": (series(f, mad, settled=0), own()),
        "wide rollover": (series(features(shut=(SHUT[0], 64_800)), mad), own()), "half buckets": (series(features(bucket // 2), mad, bucket // 2, moves=3), own(bucket // 2, 2 * least)), "double buckets": (series(features(2 * bucket), mad, 2 * bucket), own(2 * bucket, max(2, least // 2))),
        "segment of 2": (None, own(n=2)), "segment of 8": (None, own(n=8)), "segment of 16": (None, own(n=16)), "k0 = 0.001": (None, own(k0=0.001)), "k0 = 0.1": (None, own(k0=0.1)),
        "coverage 70 %": (series(f, mad, coverage=0.7), own()), "coverage 98 %": (series(f, mad, coverage=0.98), own()), "2 moves": (series(f, mad, moves=2), own()), "12 moves": (series(f, mad, moves=12), own()),
        "persistence": (series(f, C.persistence(F.col("rho1"))), own()), "rate of moves": (series(f, F.log(F.when(F.col("move_share") > 0, F.col("move_share")))), own()), "no autocorrelation": (None, own(rhos=(0.0,))), "before the event": (None, own()),
    }
    made = reduce(DataFrame.unionByName, (d.withColumn("key", F.lit(name)) for name, (d, _) in each.items() if d is not None))
    done = small(C.deseasoned_each(made))  # a row a bucket and series
    base = done.where("key = 'base'")
    copies = base.select(F.explode(F.array(*(F.lit(name) for name, (d, _) in each.items() if d is None and name != "before the event"))).alias("key"), "s", "y")
    before = C.ended_before(base, bucket, event).withColumn("key", F.lit("before the event"))
    return done.unionByName(copies).unionByName(before), {k: v for k, (_, v) in each.items()}


@query()
def changepoint_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The model picked, its changes and their size under twenty choices of feature, bucket, prior and admission."""
    p = stored(G.events_panel(spark, sf), "panel")
    lo, hi = p.agg(F.min("s"), F.max("s")).first()
    d, each = variants(p, (lo + hi) // 2)
    d = small(d)  # a row a bucket and variant
    f = C.fits(d, C.folds(d, each))
    names = spark.createDataFrame([(k,) for k in each], "key string")
    return names.join(f, "key", "left").select(F.col("key").alias("variant"), "best", "posterior", "ratio", "rho", "onset", "back")


FINE, FINE_SEGMENT, REPLICATES = 3 * DAY, 120, 100


@query()
def null_calibration_fine(spark: SparkSession, sf: str) -> DataFrame:
    """What the evidence of about 850 buckets of three days says of a hundred series without a change, beside the one observed."""
    p = G.lineitem_panel(spark, sf).select((F.floor(F.col("s") / FINE) * FINE).alias("b"), "basis")
    series = S.mad(p, ["b"], "basis", many=True).where("mad > 0").select(F.col("b").alias("s"), F.log("mad").alias("y"))
    return C.null_calibration(series, FINE, FINE_SEGMENT, REPLICATES)


# -- models by label --------------------------------------------------------------------------------
def by_role(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with the labels that the evidence gives among models with a change, as segments are to be compared, and
    the role of each label."""
    p = stored(G.lineitem_panel(spark, sf), "panel")
    d = stored(L.with_labels(p, chosen(p, C.MODELS[1:])), "labelled")
    roles = small(X.widest(d, "regime", "basis").select("regime", "role"))  # three rows at most
    return d.join(F.broadcast(roles), "regime")


def regime_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Log gaps and increments with ``group`` (label), its ``role``, ``cell`` (label and year) and ``ok`` (more likely than not)."""
    d = by_role(spark, sf)
    d = d.withColumns({"group": F.col("regime").cast("long"), "cell": F.col("regime") * 100 + F.floor(F.col("s") / DAY / 365), "ok": L.sure(0.5)})
    roles = small(d.select(F.col("regime").cast("long").alias("group"), "role").distinct())  # three rows at most
    return stored(V.with_logs(d, DAY, MONTHS).join(F.broadcast(roles), "group"), "rows")


def role_names(rows: DataFrame) -> dict[int, str]:
    """The role of each label, with the label where two have one role."""
    found = dict(sorted(tuple(r) for r in rows.select("group", "role").distinct().collect()))  # three rows at most
    return {g: r if list(found.values()).count(r) == 1 else f"{r} {g}" for g, r in found.items()}


def designs(rows: DataFrame, p: int, basis_lags: int = 0, with_runs: bool = True, least: int = 20) -> dict[str, DataFrame]:
    d = V.design(rows, p, DAY, MONTHS, F.col("ok") & F.col("z").isNotNull(), F.col("group"), least, basis_lags, with_runs=with_runs).transform(stored)
    sizes = {r[0]: r[1] for r in d.groupBy((F.floor(F.col("cell") / 100)).alias("g")).agg(F.count("*")).collect()}  # three labels
    roles = role_names(rows)
    return {roles[g]: d.where(F.floor(F.col("cell") / 100) == g) for g in sorted(sizes) if sizes[g] > 4 * len(V.regressors(p, basis_lags))}


def regime_fits(rows: DataFrame, p: int = M.LAGS) -> dict[str, tuple[DataFrame, V.Fit]]:
    return {name: (d, V.fit(d, p)) for name, d in designs(rows, p).items()}


@query()
def vecm_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Every coefficient of a model for each label, shares of closing, largest root and half-lives; audited."""
    rows = []
    for name, (d, f) in regime_fits(regime_rows(spark, sf)).items():
        if wrong := V.audit(d, f):
            raise ValueError(f"{name}: {'; '.join(wrong)}")
        rows += V.coefficients(f, name) + [(name, g, "closure share", float(s)) for g, s in V.closure_shares(f).items()]
        rows += [(name, "z", "radius", f.radius), (name, "z", "half life", f.half_life), (name, "z", "one-step half life", f.one_step)]
    return spark.createDataFrame(rows, V.TERMS)


@query()
def lag_selection(spark: SparkSession, sf: str) -> DataFrame:
    """AIC and BIC of seven lags, summed over labels, on the rows admitted at the largest."""
    t = V.select_lag(designs(regime_rows(spark, sf), max(V.LAGS), with_runs=False))
    return spark.createDataFrame([tuple(r) for r in t.itertuples(index=False)], "p int, n long, aic double, bic double, best boolean")


@query()
def weak_exogeneity(spark: SparkSession, sf: str) -> DataFrame:
    rows = [r for name, (d, f) in regime_fits(regime_rows(spark, sf)).items() for r in V.exogeneity(d, f, name, M.BLOCK, DAY, MONTHS)]
    return spark.createDataFrame(rows, V.EXOGENEITY)


def tests_frame(spark: SparkSession, tests: list[dict]) -> DataFrame:
    schema = f"{K.TESTS}, regime string, offset int, family string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(t[c] for c in names) for t in tests], schema)


@query()
def granger_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """All tests of all labels, their p-values put right together."""
    tests = [t | {"regime": name, "offset": 0, "family": "measured"} for name, d in designs(regime_rows(spark, sf), 2, 2).items() for t in K.leg_tests(d, 2, DAY, MONTHS, M.BLOCK)]
    return K.holm(tests_frame(spark, tests), "p")


@query()
def granger_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What the tests of each role rest on, checked: see ``audit_tests``."""
    rows, out = regime_rows(spark, sf), []
    models = designs(rows, 2)
    for name, d in designs(rows, 2, 2).items():
        f = V.fit(d, 2)
        out += [(name, *c) for c in V.audit_tests(d, models[name], f, 2, M.BLOCK, DAY, MONTHS)]
    return spark.createDataFrame(out, "regime string, check string, value double, passed boolean")


OFFSETS = (-7, -3, 3, 7)


@query()
def placebo_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of each leg, measured and with the leg taken from another day, and the range of the latter: what a gain must
    clear is their maximum."""
    rows, tests = regime_rows(spark, sf), []
    for offset in (0, *OFFSETS):
        for leg in V.LEGS if offset else ("",):
            d = K.with_placebo(rows, leg, offset) if offset else rows
            for name, x in designs(d, 2, 2).items():
                tests += [t | {"regime": name, "offset": offset, "family": "placebo" if offset else "measured"} for t in K.leg_tests(x, 2, DAY, MONTHS, M.BLOCK, (leg,) if offset else V.LEGS, full=False)]
    t = tests_frame(spark, tests)
    keys = ["regime", "from", "to", "conditioning"]
    null = t.where("family = 'placebo'").groupBy(*keys).agg(F.count("*").alias("draws"), F.min("gain").alias("least"), F.median("gain").alias("middle"), F.max("gain").alias("threshold"))
    return t.where("family = 'measured'").select(*keys, "gain", "delta_r2", "p").join(null, keys, "left").withColumn("clears", F.col("gain") > F.col("threshold"))


@query()
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    """route, role, value, low, high, n: half-lives in days by routes that share no machinery."""
    rows = regime_rows(spark, sf)
    roles, out = F.broadcast(small(rows.select(F.col("group").cast("int").alias("label"), "role").distinct())), []  # three rows at most
    plain = {name: name.split(" ")[0] for name in role_names(rows).values()}
    for name, (d, f) in regime_fits(rows).items():
        name = plain[name]
        out += [("pooled fit", name, f.half_life, None, None, f.n), ("pooled fit, one step", name, f.one_step, None, None, f.n)]
    each = V.daily(designs_one(rows), 1, 60).withColumn("label", F.floor(F.col("cell") / 100).cast("int")).join(roles, "label")
    by = lambda d, route, v: d.where(F.col(v).isNotNull() & ~F.isnan(v)).groupBy("role").agg(F.median(v).alias("value"), F.percentile(v, F.lit(0.25)).alias("low"), F.percentile(v, F.lit(0.75)).alias("high"), F.count("*").alias("n")).select(F.lit(route).alias("route"), "role", "value", "low", "high", "n")
    p = by_role(spark, sf)
    cut = E.threshold(p, "basis", 0.95)
    eps = E.episodes(p.crossJoin(F.broadcast(cut)), "basis", F.col("level"), DAY, 2 * DAY, DAY, MONTHS)  # one row
    ruler = E.ruler(p, eps, "basis", 30 * DAY, DAY, MONTHS).join(p.select(F.col("s").alias("peak_s"), "regime"), "peak_s")
    ruler = ruler.join(roles, F.col("regime") == F.col("label")).select("role", (F.col("half_life") / DAY).alias("v"))
    level = S.ar1(p, ["regime"], "basis", DAY, MONTHS).join(roles, F.col("regime") == F.col("label")).select(F.lit("AR(1) of the level").alias("route"), "role", S.half_life(F.col("rho")).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("pairs").alias("n"))
    schema = "route string, role string, value double, low double, high double, n long"
    return spark.createDataFrame(out, schema).unionByName(by(each, "cell by cell", "half_life")).unionByName(by(ruler, "episode ruler", "v")).unionByName(level)


def designs_one(rows: DataFrame) -> DataFrame:
    return V.design(rows, 1, DAY, MONTHS, F.col("ok") & F.col("z").isNotNull(), F.col("group"), 20)


@query()
def closure_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """The routes to the speed of closing side by side: each role's, the calmest, and how many times slower stress is."""
    return X.routes(persistence(spark, sf).select("route", "role", "value"))


@query()
def coefficient_check(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients written by one stage, read again by the next, which takes its lag order from their terms and refits."""
    path, rows = f"{shared_folder(spark, 'coefficients')}/model", regime_rows(spark, sf)
    spark.createDataFrame([r for name, (_, f) in regime_fits(rows).items() for r in V.coefficients(f, name)], V.TERMS).write.parquet(path)
    stored = spark.read.parquet(P.require(spark, path, "the model stage"))
    order = {r.regime: r.p for r in V.lag_order(stored).collect()}  # three labels
    again = [r for p in set(order.values()) for name, (_, f) in regime_fits(rows, p).items() if order.get(name) == p for r in V.coefficients(f, name)]
    return V.compared(spark.createDataFrame(again, V.TERMS), stored).join(V.lag_order(stored), "regime")


# -- lead and lag, episodes, boundaries ---------------------------------------------------------------
CORR = [("dz", "dx_a"), ("dz", "dx_b"), ("dz", "dx_c"), ("dx_b", "dx_a"), ("dx_c", "dx_a"), ("dx_c", "dx_b")]
HORIZONS = [1, 2, 5, 10, 30, 60]
_SQL = {"dz": "dz", "dx_a": "da", "dx_b": "db", "dx_c": "dc"}


@query(f"""WITH {M.LOGS}, rn AS (SELECT *, 0.0 + -1 * da + -1 * db + dc AS dz FROM dx WHERE da IS NOT NULL), hs AS (SELECT unnest({HORIZONS}) AS h), pr AS (SELECT h, x.*, y.da AS pda, y.db AS pdb, y.dc AS pdc, y.dz AS pdz FROM rn x, hs, rn y WHERE y.s = x.s - h * 86400)
       {' UNION ALL '.join(f"SELECT '{y}' AS leads, '{x}' AS follows, h AS horizon, round(corr({_SQL[x]}, p{_SQL[y]}), 6) AS corr_leads, round(corr(p{_SQL[x]}, {_SQL[y]}), 6) AS corr_follows, round(corr({_SQL[x]}, p{_SQL[y]}) - corr(p{_SQL[x]}, {_SQL[y]}), 6) AS asymmetry FROM pr GROUP BY h" for x, y in CORR)}""")
def lead_lag_matrix(spark: SparkSession, sf: str) -> DataFrame:
    d = K.increments_in_runs(G.lineitem_panel(spark, sf), DAY, MONTHS).withColumn("dz", -F.col("dx_a") - F.col("dx_b") + F.col("dx_c"))
    t = K.lead_lag_table(K.cross_correlations(d, CORR, max(HORIZONS), DAY, MONTHS), HORIZONS)
    return t.select("leads", "follows", "horizon", *(r6(c, c) for c in ("corr_leads", "corr_follows", "asymmetry")))


@query(f"""WITH {EPISODES}, {CLOSED.replace(EVENTS + ', ', '', 1)} SELECT make_timestamp(lo * 1000000) AS opens, seconds, peak FROM ep WHERE lo // 86400 IN (SELECT hi // 86400 FROM shut)""")
def reopen_episodes(spark: SparkSession, sf: str) -> DataFrame:
    _, e = D.found(spark, sf)
    return E.after_reopening(e, R.closures(G.events_panel(spark, sf), 3, DAY)).select(O.stamp("lo").alias("opens"), "seconds", "peak")


@query(f"""WITH {EPISODES} SELECT make_timestamp(s // 21600 * 21600000000) AS t, count(*) AS n, round(avg((abs(z) > level)::INT), 6) AS share FROM o, lv GROUP BY 1""")
def exceedance_share(spark: SparkSession, sf: str) -> DataFrame:
    p, _ = D.found(spark, sf)
    return E.exceedance(p, "z", F.col("level"), 6 * HOURS).select(O.stamp("s").alias("t"), "n", r6("share", "share"))


@query(f"""WITH {EPISODES}, {CLOSED.replace(EVENTS + ', ', '', 1)}, live AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM shut WHERE o.s BETWEEN shut.lo AND shut.hi)) SELECT count(*) AS rows, (SELECT count(*) FROM o) AS all_rows, round(median(abs(z)), 6) AS gap FROM live""")
def open_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside closures, beside all."""
    p, _ = D.found(spark, sf)
    shut = R.closures(G.events_panel(spark, sf), 3, DAY).select("lo", "hi")
    inside = E.in_intervals(p.select("s"), shut, DAY).select("s")
    live = stored(p.join(inside, "s", "left_anti"))
    return Q.median(live, [], F.abs("z"), "gap").select(F.col("n").alias("rows"), r6("gap", "gap")).crossJoin(F.broadcast(p.agg(F.count("*").alias("all_rows"))))  # one row


@query(f"""WITH {EPISODES}, dy AS (SELECT s // 86400 AS d, count(*) AS n FROM o GROUP BY 1), sz AS (SELECT max(n) AS f, min(n) AS l FROM dy), ks AS (SELECT n, CASE WHEN n = f THEN 'full' WHEN n = l THEN 'late' ELSE 'other' END AS k FROM dy, sz),
       tt AS (SELECT count(*) AS sessions, count(*) FILTER (k = 'full') AS "full", count(*) FILTER (k = 'other') AS other, count(*) FILTER (k = 'late') AS late, sum(n)::BIGINT AS rows FROM ks),
       oc AS (SELECT count(*) AS k, count(*) FILTER (lo % 86400 = {SHUT[1]}) AS st, count(*) FILTER (hi % 86400 = {SHUT[0] - 600}) AS en FROM ep)
       SELECT sessions, "full", other, late, rows, sessions - other AS with_open, sessions - late AS with_close, k AS episodes, round(k * (sessions - other) / rows, 6) AS expected_starts, st AS observed_starts, round(k * (sessions - late) / rows, 6) AS expected_ends, en AS observed_ends FROM tt, oc""")
def boundary_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that touch the edges of the hours left out, beside how many would by chance."""
    p, e = D.found(spark, sf)
    k, starts, ends = e.agg(F.count("*"), F.count_if(R.time_of_day("lo") == SHUT[1]), F.count_if(R.time_of_day("hi") == SHUT[0] - STEP)).first()
    days = p.groupBy(F.floor(F.col("s") / DAY).alias("d")).agg(F.count("*").alias("n"))
    t = X.boundary_counts(days, starts, ends, k)
    return t.select(*(r6(c, c) if c.startswith("expected") else c for c in t.columns))


NAMED = [("wide", 820_000_000, 930_000_000), ("narrow", 850_000_000, 900_000_000)]


@query(f"WITH {LINEITEM} " + " UNION ALL ".join(f"""SELECT * FROM (WITH d AS (SELECT basis AS v, s // 86400 // 30 AS cell, s >= {lo} AND s < {hi} AS inside FROM p), ce AS (SELECT inside, cell, count(*) AS n, sum(v) AS z, sum(v * v) AS zz FROM d GROUP BY 1, 2 HAVING count(*) >= 10),
       sp AS (SELECT inside, count(*) AS days, sum(n)::BIGINT AS n, sum(greatest(0, zz - z * z / n)) / sum(n) AS w, greatest(0, sum(z * z / n) / sum(n) - pow(sum(z) / sum(n), 2)) AS b FROM ce GROUP BY 1), m AS (SELECT inside, median(v) AS m FROM d GROUP BY 1), ma AS (SELECT inside, 1.4826 * median(abs(v - m)) AS mad FROM d JOIN m USING (inside) GROUP BY 1),
       a AS (SELECT * FROM sp JOIN ma USING (inside) WHERE inside), c AS (SELECT * FROM sp JOIN ma USING (inside) WHERE NOT inside)
       SELECT '{name}' AS name, a.days, a.n, round(a.b / (a.w + a.b), 6) AS share, round(c.b / (c.w + c.b), 6) AS calm_share, round(sqrt((a.w + a.b) / (c.w + c.b)), 6) AS sd_ratio, round(sqrt(a.w / c.w), 6) AS within_ratio, round(a.mad / c.mad, 6) AS mad_ratio FROM a, c)""" for name, lo, hi in NAMED))
def named_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    t = X.named_windows(stored(G.lineitem_panel(spark, sf)), NAMED, "basis", F.floor(F.col("s") / DAY / 30), 10)
    return t.select("name", "days", "n", *(r6(c, c) for c in t.columns[3:]))


@query(f"""WITH {EPISODES} SELECT strftime(make_timestamp(lo * 1000000), '%d %b %H:%M') AS cell, make_timestamp(lo * 1000000) AS opens FROM ep""")
def report_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as cells of a report and read again, the year being that of the data."""
    p, e = D.found(spark, sf)
    cells = e.select(F.date_format(O.stamp("lo"), "dd MMM HH:mm").alias("cell"))
    first = p.agg(F.min("s").alias("s")).select(O.stamp("s").alias("first"))
    return cells.crossJoin(F.broadcast(first)).select("cell", reports.stamp_of(F.col("cell"), F.col("first")).alias("opens"))  # one row


@query(f"""WITH {LINEITEM}, m AS (SELECT strftime(make_timestamp(s * 1000000), '%Y-%m') AS month, sum(basis) AS total, count(*) AS n FROM p WHERE s % 604800 = 0 GROUP BY 1) SELECT month, n, round(total, 6) AS total FROM m""")
def decimated_months(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh row of the grid, stored by day, read back and checked as a grid of seven days."""
    path = f"{shared_folder(spark, 'grid')}/panel"
    P.write_grid(G.lineitem_panel(spark, sf), path, 365 * DAY)
    d = R.decimated(P.read_grid(spark, path, ["basis"], name=f"grid_{uuid.uuid4().hex}"), 7 * DAY)
    d = G.checked_grid(d, 7 * DAY, MONTHS)
    return d.groupBy(month().alias("month")).agg(F.count("*").alias("n"), r6(F.sum("basis"), "total"))


@query(f"""WITH {LINEITEM} SELECT count(*) AS rows, count(*) FILTER (a_bid >= a_ask OR b_bid >= b_ask OR c_bid >= c_ask) AS crossed FROM p""")
def quotes_uncrossed(spark: SparkSession, sf: str) -> DataFrame:
    """The panel after the check that no bid is at or above its ask."""
    p = G.checked_quotes(stored(G.lineitem_panel(spark, sf)))
    crossed = [F.col(f"{x}_bid") >= F.col(f"{x}_ask") for x in "abc"]
    return p.agg(F.count("*").alias("rows"), F.count_if(crossed[0] | crossed[1] | crossed[2]).alias("crossed"))



