"""Operators against plain numpy and pandas forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions import quantiles as Q
from gridweave.functions.special import chi2_tail
from gridweave.operators import causality as K
from gridweave.operators import changepoint as C
from gridweave.operators import episodes as E
from gridweave.operators import grid as G
from gridweave.operators import labels as L
from gridweave.operators import reconcile as X
from gridweave.operators import stats as S
from gridweave.operators import vecm as V
from gridweave.plans.model_queries import drained
from gridweave.sources import panels as P
from gridweave.sources import reports
from gridweave.streaming import ticks as ST


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def test_ordered_is_the_global_form(spark):
    rng = np.random.default_rng(0)
    s = np.sort(rng.choice(5_000, 300, replace=False)) * 10
    v = np.where(rng.random(300) < 0.6, np.nan, rng.normal(size=300))
    pdf = pd.DataFrame({"s": s, "v": v})
    d = frame(spark, pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = O.with_running(O.with_last_known(O.with_previous(d, {"p": "s"}, 700), ["v"], 700), {"n": F.lit(1).cast("long")}, 700).orderBy("s").toPandas()
    assert np.array_equal(got.p.to_numpy()[1:], s[:-1]) and math.isnan(got.p[0])
    assert np.array_equal(got.n, np.arange(1, 301))
    np.testing.assert_array_equal(got.v, pdf.v.ffill())
    lagged = O.with_lagged(frame(spark, pd.DataFrame({"s": s, "w": s * 2})), {"b": ("w", 3), "f": ("w", -2)}, 10, 100).orderBy("s").toPandas()
    have = set(s)
    assert [None if math.isnan(x) else x for x in lagged.b] == [2 * (x - 30) if x - 30 in have else None for x in s]
    assert [None if math.isnan(x) else x for x in lagged.f] == [2 * (x + 20) if x + 20 in have else None for x in s]


def test_episode_rules(spark):
    z = {0: 1, 10: 5, 20: 6, 30: 1, 40: -7, 50: 1, 60: 1, 70: 1, 80: 1, 90: 9, 110: 9, 120: 9}
    d = frame(spark, pd.DataFrame({"s": list(z), "z": [float(v) for v in z.values()]}))
    got = [tuple(r) for r in E.episodes(d, "z", F.lit(4.0), 10, 20, 15, 50).orderBy("lo").collect()]
    # 10..20 and 40 are one episode; 90 stands alone and is short; rows are missing before 110, so it begins anew
    assert got == [(10, 40, 40, -7.0, 40, -1.0), (110, 120, 20, 9.0, 110, 1.0)]


def test_gram_and_blocks_are_least_squares(spark):
    rng = np.random.default_rng(1)
    n, cols = 400, ["const", "z1", "q1", "q2", "dx_a", "dx_b", "dx_c"]
    x = rng.normal(size=(n, 6))
    x[:, 3] += 0.5 * x[:, 1]
    d = frame(spark, pd.DataFrame(x, columns=cols[1:]))
    g = V.gram(d, cols)
    full = np.column_stack([np.ones(n), x])
    np.testing.assert_allclose(g, full.T @ full, rtol=1e-9)
    sql = {(r.i, r.j): r.v for r in V.gram_sql(d, cols).collect()}
    assert all(abs(v - g[cols.index(i), cols.index(j)]) < 1e-8 for (i, j), v in sql.items())
    names, model, block, target = cols[:4], cols[:4], ["q1", "q2"], np.array([1.0, 0, 0])
    iid = lambda: np.linalg.inv(full[:, :4].T @ full[:, :4])[2:, 2:] * rss(full[:, :4]) / (n - 4)

    def rss(a):
        return float(((full[:, 4] - a @ np.linalg.lstsq(a, full[:, 4], rcond=None)[0]) ** 2).sum())

    t = K.block_test(g, names, model, block, target, iid())
    small, large = rss(full[:, :2]), rss(full[:, :4])
    assert t["delta_r2"] == pytest.approx((small - large) / (full[:, 4] @ full[:, 4]), rel=1e-9)
    assert t["wald"] == pytest.approx((small - large) / (large / (n - 4)), rel=1e-8)
    b = np.abs(np.linalg.lstsq(full[:, :4], full[:, 4], rcond=None)[0][2:])
    assert t["horizon"] == pytest.approx((b[0] + 2 * b[1]) / b.sum())


@pytest.mark.parametrize("most", [1, 5, 40, 10**6])
def test_quantiles_do_not_depend_on_rounds(spark, most):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.lognormal(0, 3, 700), np.repeat(2.5, 200), [np.nan]])
    pdf = pd.DataFrame({"k": np.arange(901) % 3, "v": v})
    got = Q.quantiles(frame(spark, pdf), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}, most).toPandas().set_index("k")
    want = pdf.dropna().groupby("k").v.quantile([0.1, 0.5, 0.999]).unstack()
    np.testing.assert_allclose(got.loc[want.index, ["a", "b", "c"]].to_numpy(), want.to_numpy(), rtol=1e-12)
    assert Q.median(frame(spark, pdf), [], "v", "m", most).first().m == pytest.approx(np.nanmedian(v))


INF, TINY = float("inf"), 5e-324


@pytest.mark.parametrize("most", [1, 7])
def test_radix_selection_of_hard_values(spark, most):
    """Ties at either end, infinities, both zeros, subnormals, null keys, small groups beside large ones: to the bit."""
    rng = np.random.default_rng(8)
    groups = {
        "top": [0.0] * 5 + [1.0] * 395, "bottom": [-1.0] * 395 + [7.0] * 5, "all": [3.25] * 50, "infinite": [-INF] * 20 + [INF] * 20 + [1.0], "zeros": [0.0, -0.0] * 20 + [TINY, -TINY, 3 * TINY],
        "wide": [float(x) for x in rng.normal(size=60) * 10.0 ** rng.integers(-320, 300, 60)], "close": [1.0 + i * 2.0**-52 for i in range(30)], "pair": [1.0, 2.0], "nan": [float("nan")] * 9 + [4.0, 1.5], None: [1e308, -1e308] * 9 + [2.0],
    }
    d = spark.createDataFrame([(k, "x", v) for k, vs in groups.items() for v in vs] + [("nan", "x", None)], "k string, j string, v double")
    wanted = {"low": 0.0, "a": 0.01, "b": 0.25, "m": 0.5, "c": 0.77, "top": 1.0}
    bits = lambda rows: {(r.k, r.j): (r.n, *(None if r[c] is None else (r[c] or 0.0).hex() for c in wanted)) for r in rows}
    small = Q.quantiles(d, ["k", "j"], "v", wanted, 10**6).collect()
    assert len(small) == len(groups) and bits(Q.quantiles(d, ["k", "j"], "v", wanted, most).collect()) == bits(small)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_quantiles_that_count_nan(spark, most):
    inf, nan = math.inf, math.nan
    data = {"few": [1.0, 2.0, 3.0, 4.0, nan], "half": [1.0, nan, inf, nan, -inf, nan], "ends": [inf, inf, -inf, nan], "all": [nan] * 4, "none": [-2.0, 0.0, 5.0]}
    d = spark.createDataFrame([(k, x) for k, v in data.items() for x in v] + [("few", None)], "g string, x double")
    got = {r.g: (r.n, r.low, r.mid, r.high) for r in Q.quantiles(d, ["g"], "x", {"low": 0.25, "mid": 0.5, "high": 0.9}, most, nan=True).collect()}
    want = {r.g: (r.n, r.low, r.mid, r.high) for r in d.where("x is not null").groupBy("g").agg(F.count("*").alias("n"), *(F.percentile("x", F.lit(q)).alias(k) for k, q in (("low", 0.25), ("mid", 0.5), ("high", 0.9)))).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    assert got["few"][:3] == (5, 2.0, 3.0) and math.isnan(got["few"][3]) and got["ends"][2] == inf and math.isnan(got["all"][1])


def test_image_is_that_of_the_bits(spark):
    import struct

    rng = np.random.default_rng(2)
    xs = np.frombuffer(rng.bytes(8 * 4000)).tolist() + [2.0**e for e in range(-1074, 1024)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1022, 1024)] + [0.0, -0.0, INF, -INF, TINY, 1.7976931348623157e308]
    xs = [x for x in xs if x == x]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.image(Q.F.col("x")).alias("i"))
    for x, i in d.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert i == (-bits if x < 0 else bits)


def test_survival_is_the_count(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.lognormal(0, 1, 500), np.zeros(20), [3.0, 3.0]])
    got = S.survival(frame(spark, pd.DataFrame({"x": x * rng.choice([-1, 1], len(x))})), "x", 60).orderBy("i").toPandas()
    pos = x[x > 0]
    np.testing.assert_allclose(got.u, np.median(pos) * (pos.max() / np.median(pos)) ** (np.arange(60) / 59), rtol=1e-12)
    np.testing.assert_allclose(got.share[:-1], [(pos > u).mean() for u in got.u[:-1]])


def hac_brute(x, y, run, block):
    """Newey and West by block sums, as a loop."""
    n, k = x.shape
    beta, inv = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.inv(x.T @ x)
    phi = (x @ inv[:, [1]]) * (y - x @ beta)
    sums = [phi[i : i + block].sum(axis=0) for i in range(n - block + 1) if run[i] == run[i + block - 1]]
    return np.array(sums).T @ np.array(sums) / block * n / (n - k)


def test_robust_covariances(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=["z1", "dx_a", "dx_b", "dx_c"])
    pdf["run"] = np.where(np.arange(n) < 140, 1, 2)
    pdf["s"] = np.arange(n) * 10 + np.where(pdf.run == 2, 500, 0)
    d, names = frame(spark, pdf), ["const", "z1"]
    f = V.fit(d, 0)
    x, y = np.column_stack([np.ones(n), pdf.z1]), pdf[["dx_a", "dx_b", "dx_c"]].to_numpy()
    want = hac_brute(x, y, pdf.run.to_numpy(), 7)
    np.testing.assert_allclose(V.hac(d, f, 7, 10, 200), want, rtol=1e-8)
    one = [V.Functional(np.eye(3)[e], f.coef[:, e], np.linalg.inv(f.xtx)[:, [1]], 2) for e in range(3)]
    got = V.long_run(d, names, one, 7, 10, 200, n)
    np.testing.assert_allclose([m[0, 0] for m in got], np.diag(want), rtol=1e-8)
    acf = V.residual_acf(d, f, 3, 10, 200).where("leg = 'b'").orderBy("lag").toPandas()
    u = y[:, 1] - x @ f.coef[:, 1]
    for k, r in zip((1, 2, 3), acf.itertuples(), strict=True):
        same = pdf.run.to_numpy()[k:] == pdf.run.to_numpy()[:-k]
        assert r.acf == pytest.approx(np.corrcoef(u[k:][same], u[:-k][same])[0, 1]) and r.pairs == same.sum()
    assert V.audit(d, f) == [] and len(V.audit(d.withColumn("dx_a", F.lit(float("nan"))), f)) == 1


def test_decay_by_roots_is_the_iteration():
    rng = np.random.default_rng(8)
    m = V.companion(rng.normal(0, 0.1, (2 + 6, 3)), 2)
    state, want = np.eye(len(m))[0], [1.0]
    for _ in range(40):
        state = m @ state
        want.append(state[0])
    np.testing.assert_allclose(V.decay(m, 40), want, atol=1e-10)
    jordan = np.array([[0.5, 1.0], [0.0, 0.5]])
    assert V.decay(jordan, 3)[3] == pytest.approx(0.125)
    assert V.first_half(np.array([1, 0.8, 0.4])) == pytest.approx(1.75) and V.first_half(np.array([1, 0.9])) is None


def leading_panel(n=3_000, seed=4):
    """Leg a moves the basis a step later; nothing else leads."""
    rng = np.random.default_rng(seed)
    da, db = rng.normal(0, 1e-4, n), rng.normal(0, 1e-4, n)
    z = np.zeros(n)
    for i in range(1, n):
        z[i] = 0.8 * z[i - 1] + 0.6 * da[i - 1] + rng.normal(0, 5e-5)
    a, b = 0.66 * np.exp(np.cumsum(da)), 152 * np.exp(np.cumsum(db))
    return pd.DataFrame({"s": np.arange(n) * 60, "a_mid": a, "b_mid": b, "c_mid": a * b * np.exp(z), "cell": np.zeros(n, int)})


def test_recovery_of_a_planted_lead(spark):
    rows = V.with_logs(frame(spark, leading_panel()), 60, 36_000).cache()
    d = V.design(rows, 2, 60, 36_000, F.col("z").isNotNull(), F.col("cell"), 0, 2, with_runs=True).cache()
    tests = K.leg_tests(d, 2, 60, 36_000)
    own = {x["from"]: x for x in tests if x["conditioning"] == "own memory"}
    assert own["a"]["delta_r2"] > 0.2 and max(own["b"]["delta_r2"], own["a"]["p"]) < 0.01 < own["b"]["p"] and own["a"]["horizon"] < 1.3
    assert len(tests) == 6 + 9 and all(x["p"] > 1e-4 for x in tests if x["conditioning"] == "full system" and x["to"] == "b")
    beyond = {x["from"]: x for x in tests if x["conditioning"].endswith("bounce")}
    assert beyond["a"]["df"] == 1 and beyond["a"]["delta_r2"] < own["a"]["delta_r2"]
    ccf = K.cross_correlations(K.increments_in_runs(frame(spark, leading_panel()), 60, 36_000).withColumn("dz", -F.col("dx_a") - F.col("dx_b") + F.col("dx_c")), [("dz", "dx_a"), ("dz", "dx_b")], 3, 60, 36_000)
    table = {(r.leads, r.horizon): r.asymmetry for r in K.lead_lag_table(ccf, [1, 2]).collect()}
    assert table["dx_a", 1] > 0.3 > abs(table["dx_b", 1])
    f = V.fit(V.design(rows, 1, 60, 36_000, F.col("z").isNotNull(), F.col("cell"), 0).cache(), 1)
    assert sum(V.closure_shares(f).values()) == pytest.approx(1) and f.lam == pytest.approx(-0.2, abs=0.05)
    assert f.half_life == pytest.approx(math.log(0.5) / math.log(0.8), rel=0.3)


def test_lag_choice_and_stored_coefficients(spark):
    rows = V.with_logs(frame(spark, leading_panel()), 60, 36_000).cache()
    d = V.design(rows, 3, 60, 36_000, F.col("z").isNotNull(), F.col("cell"), 0).cache()
    t = V.select_lag({"x": d, "y": d}, (1, 2, 3))
    assert t.best.sum() == 1 and t.p[t.best].iloc[0] == 1 and t.n.iloc[0] == 2 * d.count()
    coefs = spark.createDataFrame(V.coefficients(V.fit(d, 3), "x"), V.TERMS)
    assert [tuple(r) for r in V.lag_order(coefs).collect()] == [("x", 3)]
    assert all(r.agrees and r.worst == 0 for r in V.compared(coefs, coefs).collect())
    off = V.compared(coefs, coefs.where("term <> 'const' or equation <> 'a'").withColumn("coef", F.col("coef") * F.when(F.col("equation") == "b", 1.1).otherwise(1.0)))
    assert {r.equation: r.agrees for r in off.collect()} == {"a": False, "b": False, "c": True}


def test_labels(spark):
    panel = frame(spark, pd.DataFrame({"s": np.arange(0, 100, 5)}))
    post = spark.createDataFrame([(20, [0.9, 0.1]), (40, [0.2, 0.8])], "s long, p array<double>")
    lab = L.labelled(panel, post, 20).cache()
    got = {r.s: r.regime for r in lab.collect()}
    assert [got[s] for s in (0, 15, 20, 39 // 5 * 5, 40, 60, 95)] == [0, 0, 0, 0, 1, 1, 1]  # from the next, then from the last
    assert L.with_labels(panel, lab).where(L.sure(0.85)).count() == 8
    with pytest.raises(ValueError, match="1 rows have no label"):
        L.with_labels(panel, lab.where("s <> 5"))
    moved = L.relabelled(lab, 0, 10, 1)
    assert {(r.regime, r.rows, r.blocks) for r in L.stretches(moved, 30).collect()} == {(0, 6, 1), (1, 14, 2)} and L.relabelled(lab, 0, 10).count() == 18
    ties = frame(spark, pd.DataFrame({"k": [1, 1, 1, 1], "v": [3, 2, 2, 3]}))
    assert L.modes(ties, "k", "v").first().mode == 2


def test_grid_checks(spark):
    many = frame(spark, pd.DataFrame({"s": np.cumsum(np.concatenate([np.arange(2, 1_502), np.ones(300)])).astype(int)}))
    with pytest.raises(ValueError, match="no grid"):
        G.checked_grid(many, 1, 10_000)
    assert G.checked_grid(frame(spark, pd.DataFrame({"s": range(10)})), 1, 100).count() == 10
    # any number of boundary pairs is taken: each of these windows holds two of the three cells
    cells = frame(spark, pd.DataFrame({"cell": [1, 2, 30_000], "n": [1, 1, 1], "z": [1.0, 2.0, 3.0], "zz": [1.0, 4.0, 9.0]}))
    assert X.sweep(cells, spark.range(3, 20_003).select(F.lit(0).alias("onset"), F.col("id").alias("back")), 1).where("inside and days = 2 and n = 2").count() == 20_000


def test_holm_and_chi2(spark):
    p = [0.001, 0.02, 0.5, 0.9, float("nan")]
    got = K.holm(frame(spark, pd.DataFrame({"i": range(5), "p": p})), "p").orderBy("i").toPandas().p_holm
    np.testing.assert_allclose(got[:4], [0.004, 0.06, 1, 1])
    assert math.isnan(got[4])
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and chi2_tail(18.307038053275146, 10) == pytest.approx(0.05) and chi2_tail(0, 3) == 1


def test_variance_shares_and_gate(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"day": np.repeat(np.arange(6), 50), "v": rng.normal(size=300) + np.repeat(rng.normal(size=6), 50)})
    r = S.variance_decomposition(frame(spark, pdf), "day", "v", 10).first()
    assert r.within + r.between == pytest.approx(pdf.v.var(ddof=0))
    v = frame(spark, pd.DataFrame({"value": [1.0]}))
    assert [X.exit_code(X.gate([("x", v, t)])) for t in (F.col("value") == 1, F.col("value") == 2)] == [0, 1]


def test_changes_are_found_and_calibrated(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=60)
    y[20:40] += 4
    series = frame(spark, pd.DataFrame({"s": np.arange(60) * 10, "y": y}))
    t = C.null_calibration(series, 10, 8, 6).cache()
    rows = {r.key: r for r in t.collect()}
    assert len(rows) == 7 and rows["observed"].best == "M2" and rows["observed"].log_bf > 5 and rows["observed"].ratio > 20
    one = C.null_summary(t).first()
    assert one.replicates == 6 and one.bf_exceeds == one.ratio_exceeds == 1 and one.ratio95 < 20
    flat = C.null_series(series, 0.9, 1.0, 10, 200).toPandas()
    assert flat.groupby("key").size().eq(60).all() and 0.7 < np.corrcoef(flat.y[1:60], flat.y[:59])[0, 1] < 1
    empty = spark.createDataFrame([], "s long, n long, mad double, iqr double, coverage double, moves long")
    with pytest.raises(ValueError, match="no bucket is admitted"):
        C.admitted(empty, 0.9, 1, refuse=True)


def enumerated(series, step, least, rhos):
    """Evidence of every placement of (s, y) rows, as loops: {(model, rho): {(t1, t2): ll}}."""
    s, y = zip(*sorted(series))
    n, m0, b0, k0, a0 = len(y), float(np.mean(y)), float(np.var(y, ddof=1)), 0.01, 2.0
    out = {}
    for rho in rhos:
        def ll(parts, rho=rho):
            ww = wz = zz = 0.0
            count = 0
            for lo, hi in parts:
                for i in range(lo, hi):
                    near = i > lo and s[i] - s[i - 1] == step
                    w, z = (1 - rho, y[i] - rho * y[i - 1]) if near else (math.sqrt(1 - rho * rho), y[i] * math.sqrt(1 - rho * rho))
                    ww, wz, zz, count = ww + w * w, wz + w * z, zz + z * z, count + 1
            kn, an = ww + k0, count / 2 + a0
            mn = (wz + k0 * m0) / kn
            bn = (zz + k0 * m0 * m0 - kn * mn * mn) / 2 + b0
            return math.lgamma(an) + a0 * math.log(b0) - math.lgamma(a0) - an * math.log(bn) + math.log(k0 / kn) / 2 - count / 2 * math.log(2 * math.pi)
        out["M0", rho] = {(None, None): ll([(0, n)])}
        out["M1", rho] = {(i + 1, None): ll([(0, i)]) + ll([(i, n)]) for i in range(least, n - least + 1)}
        pairs = [(i, j) for i in range(least, n) for j in range(i + least, n - least + 1)]
        out["M2", rho] = {(i + 1, j + 1): ll([(i, j)]) + ll([(0, i), (j, n)]) for i, j in pairs}
        out["M3", rho] = {(i + 1, j + 1): ll([(0, i)]) + ll([(i, j)]) + ll([(j, n)]) for i, j in pairs}
    return out


def best_of(placed, rhos):
    """(log_z by model, best model)."""
    z = {m: np.logaddexp.reduce([np.logaddexp.reduce(list(placed[m, r].values())) - math.log(len(placed[m, r])) for r in rhos]) - math.log(len(rhos)) for m in C.MODELS}
    return z, max(z, key=lambda m: z[m])


@pytest.mark.parametrize("cells", [60, 1 << 19])
def test_folded_evidence_is_that_of_all_placements(spark, monkeypatch, cells):
    """Two series with gaps, each with its own settings, in one block and in many."""
    monkeypatch.setattr(C, "CELLS", cells)
    rng, rhos = np.random.default_rng(9), (0.0, 0.45)
    times = [10 * i + 30 * (i > 7) for i in range(22)]
    data = {"a": [(t, float(v)) for t, v in zip(times, rng.normal(size=22) + 3 * (np.arange(22) > 12))], "b": [(t, float(v)) for t, v in zip(times[:17], rng.normal(size=17))]}
    each = {"a": C.settings(10, 3, rhos=rhos), "b": C.settings(10, 5, rhos=rhos)}
    f = C.folds(spark.createDataFrame([(k, *r) for k, rows in data.items() for r in rows], "key string, s long, y double"), each).cache()
    z = {(r.key, r.model): r for r in C.models(f).collect()}
    m = {(r.key, r.model, r.which, r["at"]): r.prob for r in C.change_marginals(f).collect()}
    picked = dict(tuple(r) for r in C.chosen(f).collect())
    for key, rows in data.items():
        placed = enumerated(rows, 10, each[key]["least"], rhos)
        want, best = best_of(placed, rhos)
        assert picked[key] == best
        for model in C.MODELS:
            assert z[key, model].log_z == pytest.approx(want[model], abs=1e-9) and z[key, model].configs == len(placed[model, 0.0])
            if model == "M0":
                continue
            everything = [(t, math.exp(v - want[model])) for r in rhos for t, v in placed[model, r].items()]
            for k, which in enumerate(("t1", "t2")):
                for at in {t[k] for t, _ in everything} - {None}:
                    assert m[key, model, which, at] == pytest.approx(sum(w for t, w in everything if t[k] == at) / sum(w for _, w in everything), abs=1e-9)


def test_series_deseasoned_at_once_are_those_deseasoned_alone(spark):
    rng = np.random.default_rng(21)
    gaps = np.cumsum(rng.choice([1, 1, 1, 1, 1, 1, 5], size=160))
    each = {"settled": (21_600, 4, False), "none": (21_600, 0, False), "halves": (10_800, 4, False), "raw": (21_600, 4, True), "flat": (21_600, 4, False)}
    data = {k: [(int(g) * size, 3.0 if k == "flat" else float(v)) for g, v in zip(gaps, rng.normal(size=160))] for k, (size, _, _) in each.items()}
    series = spark.createDataFrame([(k, s, v, *each[k]) for k, rows in data.items() for s, v in rows], "key string, s long, v double, size int, settled int, raw boolean")
    got = {(r.key, r.s): r.y for r in C.deseasoned_each(series).collect()}
    assert len(got) == 160 * len(each)
    for k, (size, settled, raw) in each.items():
        one = spark.createDataFrame(data[k], "s long, v double")
        want = data[k] if raw else [(r.s, r.y) for r in C.deseasoned(one, "v", F.floor(F.pmod("s", F.lit(86_400)) / size), size, settled, 4 * 86_400).collect()]
        assert sorted((s, y) for (key, s), y in got.items() if key == k) == sorted(want)


def test_a_series_that_does_not_vary_has_no_change(spark):
    """The shares of models of flat series are the limit that loops give; one of a single bucket has no change either, and
    a series beside them is as it was alone."""
    rng, rhos = np.random.default_rng(12), (0.0, 0.45)
    data = {"zero": [0.0] * 15, "level": [7.3] * 15, "one": [2.5], "free": list(rng.normal(size=15) + 3 * (np.arange(15) > 7))}
    series = spark.createDataFrame([(k, 10 * i, float(y)) for k, v in data.items() for i, y in enumerate(v)], "key string, s long, y double").cache()
    f = C.folds(series, {k: C.settings(10, 4, rhos=rhos) for k in data}).cache()
    fits = {r.key: r for r in C.fits(series, f).collect()}
    z = {(r.key, r.model): r.log_z for r in C.models(f).collect()}
    ww = lambda n, rho: (1 - rho * rho) + (n - 1) * (1 - rho) ** 2
    part = lambda n, w: math.lgamma(2 + n / 2) - math.lgamma(2) + math.log(0.01 / (0.01 + w)) / 2
    cuts, pairs = range(4, 12), [(i, j) for i in range(4, 12) for j in range(i + 4, 12)]
    each = {
        "M0": lambda r: [part(15, ww(15, r))], "M1": lambda r: [part(i, ww(i, r)) + part(15 - i, ww(15 - i, r)) for i in cuts],
        "M2": lambda r: [part(j - i, ww(j - i, r)) + part(15 - j + i, ww(i, r) + ww(15 - j, r)) for i, j in pairs],
        "M3": lambda r: [part(i, ww(i, r)) + part(j - i, ww(j - i, r)) + part(15 - j, ww(15 - j, r)) for i, j in pairs],
    }
    want = {m: np.logaddexp.reduce([np.logaddexp.reduce(v(r)) - math.log(len(v(r))) for r in rhos]) for m, v in each.items()}
    for key in ("zero", "level"):
        assert fits[key].best == "M0" and fits[key].onset is None and fits[key].back is None and fits[key].ratio is None
        assert fits[key].posterior == pytest.approx(1 / sum(math.exp(v - want["M0"]) for v in want.values()), abs=1e-9)
        for m in C.MODELS:
            assert z[key, m] - z[key, "M0"] == pytest.approx(want[m] - want["M0"], abs=1e-9)
    assert fits["one"].best == "M0" and fits["one"].posterior == 1.0 and fits["one"].ratio is None
    placed, best = enumerated([(10 * i, float(y)) for i, y in enumerate(data["free"])], 10, 4, rhos), fits["free"].best
    assert (best_of(placed, rhos)[1], best) == (best, best) and z["free", best] == pytest.approx(best_of(placed, rhos)[0][best], abs=1e-9)


def test_null_replicates_against_loops(spark):
    rng = np.random.default_rng(4)
    series = frame(spark, pd.DataFrame({"s": np.arange(26) * 10, "y": rng.normal(size=26) + 3.0 * ((np.arange(26) > 8) & (np.arange(26) < 17))}))
    rows = {r.key: r for r in C.null_calibration(series, 10, 4, 3).collect()}
    placed = enumerated([tuple(r) for r in series.collect()], 10, 4, C.RHOS)
    z, best = best_of(placed, C.RHOS)
    assert rows["observed"].best == best and rows["observed"].log_bf == pytest.approx(z["M2"] - z["M0"], abs=1e-8)
    f = C.fits(series.withColumn("key", F.lit("")), C.fold(series, 10, 4)).first()
    label = np.zeros(26, int)
    label[f.onset - 1 : f.back - 1 if f.back else 26] = 1
    y = np.array([r.y for r in series.orderBy("s").collect()])
    if f.back and best == "M3":
        label[f.back - 1 :] = 2
    sd = np.std(y - np.array([y[label == k].mean() for k in label]), ddof=1)
    sim = C.null_series(series, f.rho, float(sd), 10, 3).collect()
    for k in "123":
        z, best = best_of(enumerated([(r.s, r.y) for r in sim if r.key == k], 10, 4, C.RHOS), C.RHOS)
        assert rows[k].best == best and rows[k].log_bf == pytest.approx(z["M2"] - z["M0"], abs=1e-2)


def test_the_number_of_labels_and_their_roles_follow_from_the_series(spark):
    """One change gives two labels; of three segments the widest is under stress wherever it is."""
    rng = np.random.default_rng(6)
    noise = rng.normal(size=45) * 0.3
    i = np.arange(45)
    shapes = {"none": 0 * i, "one": 4.0 * (i >= 20), "back": 4.0 * ((i >= 15) & (i < 30)), "stairs": 4.0 * (i >= 15) + 5.0 * (i >= 30)}
    series = spark.createDataFrame([(k, int(10 * a), float(y)) for k, shape in shapes.items() for a, y in zip(i, shape + noise)], "key string, s long, y double").cache()
    f = C.folds(series, {k: C.settings(10, 8, rhos=(0.0, 0.3)) for k in shapes}).cache()
    p = C.chosen_probabilities(f, series.groupBy("key").agg(F.count("*").alias("n"))).collect()
    labels = {k: [int(np.argmax(r.p)) for r in sorted((r for r in p if r.key == k), key=lambda r: r.i)] for k in shapes}
    assert {r.key: len(r.p) for r in p} == {"none": 1, "one": 2, "back": 2, "stairs": 3}
    assert labels["none"] == [0] * 45 and labels["one"] == [0] * 20 + [1] * 25 and labels["back"] == [0] * 15 + [1] * 15 + [0] * 15 and labels["stairs"] == [0] * 15 + [1] * 15 + [2] * 15
    wide = {0: 5.0, 1: 1.0, 2: 2.0}
    rows = frame(spark, pd.DataFrame({"label": np.repeat([0, 1, 2], 40), "v": np.concatenate([rng.normal(size=40) * wide[k] for k in range(3)])}))
    assert {r.label: r.role for r in X.widest(rows, "label", "v").collect()} == {0: "stress", 1: "post", 2: "post"}
    t = X.routes(spark.createDataFrame([("r", "stress", 6.0), ("r", "post", 3.0), ("r", "post", 2.0)], "route string, role string, value double")).first()
    assert t.calmest == 2.0 and t.multiple == 3.0


def test_files(spark, tmp_path):
    (tmp_path / "t_1.csv").write_text("20240701 000000123,1.5,1.6,0\n20240701 000001000,1.7,1.7,0\n")
    rows = G.valid_ticks(P.read_ticks(spark, f"{tmp_path}/t_*.csv")).collect()
    assert len(rows) == 1 and str(rows[0].ts) == "2024-07-01 00:00:00.123000"
    (tmp_path / "b.csv").write_text("time,Close\n2024-07-01T04:00:00Z,1.0\n2024-07-01T04:00:00Z,1.1\n")
    (tmp_path / "a.csv").write_text("time,Close\n2024-07-01T04:00:00Z,1.2\n2024-07-01T04:00:00Z,1.3\n")
    both = P.read_sided_ticks(spark, f"{tmp_path}/b.csv", f"{tmp_path}/a.csv").orderBy("line").collect()
    assert [(r.bid, r.ask) for r in both] == [(1.0, 1.2), (1.1, 1.3)] and str(both[0].ts) == "2024-07-01 00:00:00"
    (tmp_path / "a.csv").write_text("time,Close\n2024-07-01T04:00:00Z,1.2\n")
    with pytest.raises(ValueError, match="differ"):
        P.read_sided_ticks(spark, f"{tmp_path}/b.csv", f"{tmp_path}/a.csv")
    with pytest.raises(FileNotFoundError, match="run the first stage"):
        P.require(spark, f"{tmp_path}/none", "the first stage")
    (tmp_path / "a.csv").write_text("time,Close\n2024-07-01T04:00:00Z,1.2\n2024-07-01T04:00:00Z,1.3\n")
    pair = P.read_paired_ticks(spark, f"{tmp_path}/b*.csv", f"{tmp_path}/a*.csv").orderBy("line").collect()
    assert [(r.file, r.line, r.bid) for r in pair] == [(0, 0, 1.0), (0, 1, 1.1)] and P.read_paired_ticks(spark, f"{tmp_path}/no*", f"{tmp_path}/no*") is None
    with pytest.raises(ValueError, match="1 bid files and 0 ask"):
        P.read_paired_ticks(spark, f"{tmp_path}/b*.csv", f"{tmp_path}/none*.csv")
    panel = frame(spark, pd.DataFrame({"s": [86_400, 5, 3], "v": [3.0, 2.0, 1.0], "w": [0, 0, 0]}))
    P.write_grid(panel, f"{tmp_path}/grid")
    back = P.read_grid(spark, f"{tmp_path}/missing", ["v"], older=f"{tmp_path}/grid", name="stored_grid")
    assert back.columns == ["s", "v"] and sorted(r.s for r in spark.sql("SELECT s FROM stored_grid").collect()) == [3, 5, 86_400]
    with pytest.raises(KeyError, match="nothing"):
        P.read_grid(spark, f"{tmp_path}/grid", ["nothing"])
    table = frame(spark, pd.DataFrame({"a_b": ["1,234", "x"], "v": [1.5, None]}))
    cells = reports.save_table(table, str(tmp_path), "r", "c", "l")
    assert cells[1][1] == reports.MISSING and not reports.undefined_cells(cells) and reports.undefined_cells([["nan", "nano", "-inf"]]) == ["nan", "-inf"]
    tex = "".join(r.value for r in spark.read.text(f"{tmp_path}/r.tex").collect())
    assert "tabular" in tex and "nan" not in tex
    assert [r.n for r in reports.read_table(spark, str(tmp_path), "r").select(reports.cell("a_b").alias("n")).collect()] == [1234.0, None]
    assert reports.p_value(1e-13) == "< 1e-12" and reports.verdict(7, 2) == "clears (3.5x)" and reports.verdict(1, 2) == "below (0.5x)" and reports.verdict(1, 0) == "clears" and reports.verdict(None, 1) == reports.MISSING and reports.interval(None, 1) == reports.MISSING


def test_streams(spark, tmp_path):
    pdf = pd.DataFrame({"k": ["a", "a", "a", "b"], "t": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:09", "2024-01-01 00:01:00", "2024-01-01 00:00:05"]), "v": [1.0, None, 3.0, 2.0]})
    frame(spark, pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    known = drained(ST.last_known(stream(), "k", "t", "v"), "append").orderBy("k", "t").collect()
    assert [(r.k, r.v) for r in known] == [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0)]
    spans = drained(ST.sessions(stream(), "t", ["k"], F.col("v") > 0, "v", "30 seconds", "1 minute"), "complete").orderBy("k", "start").collect()
    assert [(r.k, r.ticks, r.peak) for r in spans] == [("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 2.0)]
