"""Lead-lag correlations, block causality tests, placebos and multiplicity correction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions.lagged import lag_correlations
from gridweave.functions.special import chi2_tail
from gridweave.operators import vecm as V


def cross_correlations(df: DataFrame, pairs: list[tuple[str, str]], lags: int, step: int, chunk: int, run: str = "run") -> DataFrame:
    """leads, follows, lag, n, corr of ``follows`` at t with ``leads`` at t - lag, within runs (stretches of rows a step
    apart), for all (follows, leads) of ``pairs``. Lags of both signs."""
    found = lag_correlations(df, pairs, list(range(-lags, lags + 1)), step, chunk, run)
    name = lambda k: F.get(F.array(*(F.lit(p[k]) for p in pairs)), F.col("pair"))
    return found.select(name(1).alias("leads"), name(0).alias("follows"), "lag", "n", "corr")


def cross_correlation(df: DataFrame, x: str, y: str, lags: int, step: int, chunk: int, run: str = "run") -> DataFrame:
    """lag, n, corr of x at t with y at t - lag; lag > 0: y leads."""
    return cross_correlations(df, [(x, y)], lags, step, chunk, run).select("lag", "n", "corr")


def lead_lag_table(ccf: DataFrame, horizons: list[int]) -> DataFrame:
    """leads, follows, horizon, corr_leads, corr_follows, asymmetry at a few horizons."""
    up = ccf.where(F.col("lag").isin(horizons)).select("leads", "follows", F.col("lag").alias("horizon"), F.col("corr").alias("corr_leads"))
    down = ccf.where((-F.col("lag")).isin(horizons)).select("leads", "follows", (-F.col("lag")).alias("horizon"), F.col("corr").alias("corr_follows"))
    return up.join(down, ["leads", "follows", "horizon"]).withColumn("asymmetry", F.col("corr_leads") - F.col("corr_follows"))


def asymmetry(ccf: DataFrame, most: int) -> DataFrame:
    """lag, diff = corr(+lag) - corr(-lag), and the bands of one and of the largest of ``most`` lags."""
    up, down = ccf.where("lag > 0"), ccf.where("lag < 0").select((-F.col("lag")).alias("lag"), F.col("corr").alias("back"))
    d = up.join(down, "lag").where(F.col("lag") <= most)
    wide = math.sqrt(2 * math.log(most)) + 0.7
    return d.select("lag", "n", (F.col("corr") - F.col("back")).alias("diff"), (2 / F.sqrt("n")).alias("band"), (wide / F.sqrt("n")).alias("wide_band"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """``df`` with p_holm: step-down adjusted p-values, null where p is; for tables of tests."""
    d = df.withColumn("_ok", F.col(p).isNotNull() & ~F.isnan(p))
    w = W.partitionBy("_ok").orderBy(p)
    size = F.count("*").over(W.partitionBy("_ok"))
    d = d.withColumn("_s", F.least(F.lit(1.0), (size - F.row_number().over(w) + 1) * F.col(p)))
    # equal p-values share the largest of their steps, whatever their order
    out = F.max("_s").over(W.partitionBy("_ok").orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    return d.withColumn("p_holm", F.when(F.col("_ok"), out)).drop("_ok", "_s")


def with_placebo(df: DataFrame, leg: str, days: int) -> DataFrame:
    """``df`` with the leg's increments replaced by those ``days`` later; rows without such, or with a null there, go."""
    other = df.select((F.col("s") - days * 86_400).alias("s"), F.col(f"dx_{leg}").alias("_other")).where("_other is not null")
    return df.join(other, "s").withColumn(f"dx_{leg}", F.col("_other")).drop("_other")


BEYOND_BOUNCE = 2  #: first lag that a price's own quotation noise does not reach


def block_test(g: np.ndarray, names: list[str], model: list[str], block: list[str], target: np.ndarray, covariance: np.ndarray, first_lag: int = 1) -> dict[str, float]:
    """Does ``block``, a part of ``model``, help to explain ``target`` (weights on dx_a, dx_b, dx_c)?

    From sums of products: the gain in explained variation, its share and size, where on the lags the block's weight
    lies, and a chi-square test of its coefficients with the given covariance (robust to serial correlation)."""
    xty, yty = targeted(g, names, target)

    def rss(columns: list[str]) -> tuple[float, np.ndarray]:
        b, ix = least_squares(g, names, columns, xty)
        return yty - float(b @ xty[ix]), b

    small, (large, b) = rss([c for c in model if c not in block])[0], rss(model)
    n, k, m = g[0, 0], len(model), len(block)
    gain, at = max(0.0, small - large), b[[model.index(c) for c in block]]
    try:
        wald = float(at @ np.linalg.solve(covariance, at))
    except np.linalg.LinAlgError:
        wald = float("nan")
    size = np.abs(at)
    horizon = float(np.arange(first_lag, first_lag + m) @ size / size.sum()) if size.sum() > 0 else float("nan")
    return {"n": int(n), "df": m, "wald": wald, "p": chi2_tail(wald, m) if math.isfinite(wald) else float("nan"), "delta_r2": gain / yty if yty > 0 else float("nan"), "gain": math.sqrt(gain / max(1, n - k)), "resid_sd": math.sqrt(max(0.0, large) / max(1, n - k)), "horizon": horizon}


def targeted(g: np.ndarray, names: list[str], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of products of all regressors with a target, and of the target with itself."""
    y = np.zeros(len(g))
    y[len(names) :] = target
    return g @ y, float(y @ g @ y)


def least_squares(g: np.ndarray, names: list[str], columns: list[str], xty: np.ndarray) -> tuple[np.ndarray, list[int]]:
    ix = [names.index(c) for c in columns]
    return np.linalg.solve(g[np.ix_(ix, ix)], xty[ix]), ix


def functional(g: np.ndarray, names: list[str], model: list[str], block: list[str], target: np.ndarray) -> V.Functional:
    """The block's coefficients in the model, as a functional whose covariance ``vecm.long_run`` takes."""
    xty, _ = targeted(g, names, target)
    b, ix = least_squares(g, names, model, xty)
    inverse = np.linalg.inv(g[np.ix_(ix, ix)])
    beta, q = np.zeros(len(names)), np.zeros((len(names), len(block)))
    beta[ix] = b
    q[ix] = inverse[:, [model.index(c) for c in block]]
    return V.Functional(np.asarray(target, float), beta, q, len(model))


def leg_tests(d: DataFrame, p: int, step: int, chunk: int, block: int = 31, legs: tuple[str, ...] = V.LEGS, full: bool = True) -> list[dict]:
    """For each leg: do its lags help to explain the gap's change beyond the gap and its own changes (all lags, and
    those from BEYOND_BOUNCE on), and, ``full``, each other leg and the gap beyond the whole system?

    ``d``: a design with p lags of the legs and of the gap, and runs. One pass for sums, one for all covariances."""
    names = V.regressors(p, p)
    g = V.gram(d, [*names, *(f"dx_{x}" for x in V.LEGS)])
    if g[0, 0] <= 4 * len(names):
        raise ValueError(f"{int(g[0, 0])} rows are too few for {len(names)} regressors")
    lags = lambda x, first=1: [f"dx_{x}_{i}" for i in range(first, p + 1)]
    memory, system, gap = ["const", "z1", *(f"dz_{i}" for i in range(1, p + 1))], V.regressors(p), np.array(V.WEIGHTS)
    jobs = [(x, "basis", "own memory" if first == 1 else "own memory, beyond bounce", [*memory, *lags(x)], lags(x, first), gap, first) for x in legs for first in (1, BEYOND_BOUNCE) if first <= p]
    if full:
        targets = {**{e: np.eye(3)[k] for k, e in enumerate(V.LEGS)}, "basis": gap}
        jobs += [(x, to, "full system", system, lags(x), t, 1) for to, t in targets.items() for x in legs if x != to]
    wanted = [functional(g, names, model, tested, target) for _, _, _, model, tested, target, _ in jobs]
    covariances = V.long_run(d, names, wanted, block, step, chunk, int(g[0, 0]))
    return [{"from": x, "to": to, "conditioning": what} | block_test(g, names, model, tested, target, s, first) for (x, to, what, model, tested, target, first), s in zip(jobs, covariances, strict=True)]


TESTS = "from string, to string, conditioning string, n long, df int, wald double, p double, delta_r2 double, gain double, resid_sd double, horizon double"


def increments_in_runs(panel: DataFrame, step: int, chunk: int) -> DataFrame:
    """s, run and increments, runs being cut at gaps."""
    d = V.with_logs(panel, step, chunk)
    d = O.with_previous(d, {"prev_s": "s"}, chunk)
    return O.with_run(d, ~O.adjacent(step), chunk)
