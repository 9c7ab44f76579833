"""Error-correction models with a known cointegrating vector, from cross-products that Spark sums up.

The data stay in Spark: admitted rows, cell means, lags and residuals are DataFrames, and a model is
solved from a table of at most K x K sums. Restricted models use parts of the same table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions.lagged import lag_correlations
from gridweave.operators import stats as S

LEGS = ("a", "b", "c")
WEIGHTS = (-1.0, -1.0, 1.0)
SCALE = 1e4


def with_logs(panel: DataFrame, step: int, chunk: int, weights: tuple[float, ...] = WEIGHTS, scale: float = SCALE) -> DataFrame:
    """s, z = scale times the weighted sum of log mids, dx_leg: increments, null after a gap."""
    d = panel.select("s", *(F.log(f"{g}_mid").alias(f"x_{g}") for g in LEGS), *(c for c in panel.columns if c in ("group", "cell", "ok")))
    d = O.with_lagged(d, {f"_p_{g}": (f"x_{g}", 1) for g in LEGS}, step, chunk)
    z = sum((w * F.col(f"x_{g}") for g, w in zip(LEGS, weights, strict=True)), F.lit(0.0)) * scale
    return d.select("s", z.alias("z"), *((scale * (F.col(f"x_{g}") - F.col(f"_p_{g}"))).alias(f"dx_{g}") for g in LEGS), *(c for c in d.columns if c in ("group", "cell", "ok")))


def design(rows: DataFrame, p: int, step: int, chunk: int, ok: Column, group: Column, least: int, basis_lags: int = 0, cell: str = "cell", with_runs: bool = False) -> DataFrame:
    """Admitted rows with z1 (the gap a step before), dx_leg_lag for p lags, dz_lag for ``basis_lags``, and dx_leg:
    z1 and dx_leg less their cell means.

    A row is admitted if it and the rows of the p + 1 steps before are there, ``ok`` and of one group: exactly-lagged
    values say so, and one window over chunks gives them all. ``with_runs``: also ``run``, a number for each stretch of
    admitted rows a step apart and of one group. Cells of under ``least`` admitted rows are left out."""
    back = max(p, basis_lags) + 1
    dz = sum((w * F.col(f"dx_{g}") for g, w in zip(LEGS, WEIGHTS, strict=True)), F.lit(0.0))
    state = F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), group.alias("group"), "z", dz.alias("dz"), *(f"dx_{g}" for g in LEGS))
    d = rows.select("s", F.col(cell).alias("_cell"), state.alias("_0"))
    d = O.with_lagged(d, {f"_{i}": ("_0", i) for i in range(1, back + 1)}, step, chunk)
    same = F.col("_0.ok")
    for i in range(1, back + 1):
        same = same & F.coalesce(F.col(f"_{i}.ok") & (F.col(f"_{i}.group") == F.col("_0.group")), F.lit(False))
    lags = {"z1": "_1.z"} | {f"dx_{g}_{i}": f"_{i}.dx_{g}" for i in range(1, p + 1) for g in LEGS} | {f"dz_{i}": f"_{i}.dz" for i in range(1, basis_lags + 1)}
    d = d.where(same).select("s", F.col("_cell").alias(cell), F.col("_0.group").alias("_group"), *(F.col(c).alias(n) for n, c in lags.items()), *(F.col(f"_0.dx_{g}").alias(f"dx_{g}") for g in LEGS))
    if with_runs:
        d = O.with_previous(d, {"_ps": "s", "_pg": "_group"}, chunk)
        d = O.with_run(d, ~(O.adjacent(step, "_ps") & F.coalesce(F.col("_pg") == F.col("_group"), F.lit(False))), chunk)
    centred = ["z1", *(f"dx_{g}" for g in LEGS)]
    means = d.groupBy(cell).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in centred)).where(F.col("_n") >= least)
    d = d.join(means, cell).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in centred})
    return d.select("s", cell, *(["run"] if with_runs else []), *centred, *(c for c in lags if c != "z1"))


def regressors(p: int, basis_lags: int = 0) -> list[str]:
    return ["const", "z1", *(f"dx_{g}_{i}" for i in range(1, p + 1) for g in LEGS), *(f"dz_{i}" for i in range(1, basis_lags + 1))]


def gram_sql(d: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """i, j, v: sums of products of columns, i <= j by place, as built-in sums; for a few columns."""
    d = d.withColumn("const", F.lit(1.0))
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    keys = keys or []
    sums = d.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"p{k}").alias("v")) for k, (a, b) in enumerate(pairs)))
    return sums.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")


def gram(d: DataFrame, columns: list[str]) -> np.ndarray:
    """The matrix of sums of products: one partial matrix a task and Arrow batch, summed by Spark."""
    n = len(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for b in batches:
            x = b[columns].to_numpy(float)
            total += x.T @ x
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = d.withColumn("const", F.lit(1.0)).select(*columns).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # n * n rows
    out = np.zeros((n, n))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


@dataclass
class Fit:
    """A system of three equations on shared regressors; ``coef`` is K x 3."""

    p: int
    names: list[str]
    n: int
    coef: np.ndarray
    sigma: np.ndarray
    xtx: np.ndarray
    rss: np.ndarray
    lam: float
    radius: float = float("nan")
    half_life: float | None = None
    one_step: float | None = None
    decay: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def alpha(self) -> np.ndarray:
        return self.coef[1]


def solve(g: np.ndarray, all_names: list[str], p: int, horizon: int = 1_800, basis_lags: int = 0) -> Fit:
    """The fit with p lags from the sums of ``all_names`` + dx_a, dx_b, dx_c (a smaller p uses a part of them)."""
    names = regressors(p, basis_lags)
    x = [all_names.index(c) for c in names]
    y = [len(all_names) + k for k in range(3)]
    xtx, xty, yty = g[np.ix_(x, x)], g[np.ix_(x, y)], g[np.ix_(y, y)]
    n, k = int(round(g[x[0], x[0]])), len(names)
    if n <= 4 * k:
        raise ValueError(f"{n} rows are too few for {k} regressors")
    try:
        coef = np.linalg.solve(xtx, xty)
    except np.linalg.LinAlgError:
        coef = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    rss = yty - coef.T @ xty
    w = np.array(WEIGHTS)
    lam = float(w @ coef[1])
    fit = Fit(p, names, n, coef, rss / (n - k), xtx, rss, lam)
    if not basis_lags:
        m = companion(coef, p)
        fit.radius = float(np.abs(np.linalg.eigvals(m)).max())
        fit.decay = decay(m, horizon)
        fit.half_life = first_half(fit.decay)
    fit.one_step = math.log(0.5) / math.log1p(lam) if -1 < lam < 0 else None
    return fit


def companion(coef: np.ndarray, p: int) -> np.ndarray:
    """The matrix that carries (z, dx, ..., dx of p - 1 steps ago) a step on."""
    w, k = np.array(WEIGHTS), 1 + 3 * p
    m = np.zeros((k, k))
    step = np.zeros((3, k))
    step[:, 0] = coef[1]
    step[:, 1:] = coef[2 : 2 + 3 * p].T
    m[0] = w @ step
    m[0, 0] += 1
    if p:
        m[1:4] = step
    if p > 1:
        m[4:, 1:-3] = np.eye(3 * (p - 1))
    return m


def decay(m: np.ndarray, horizon: int) -> np.ndarray:
    """How much of a unit gap is left after each step: the powers of ``m`` by its eigenvalues, in which each step is a
    sum of weighted powers; where the eigenvectors are too close to dependent, by powers of the matrix itself."""
    values, vectors = np.linalg.eig(m)
    if np.linalg.cond(vectors) < 1e8:
        weight = vectors[0] * np.linalg.solve(vectors, np.eye(len(m))[:, 0])
        return (weight @ np.power(values[:, None], np.arange(horizon + 1)[None, :])).real
    powers = np.linalg.matrix_power
    return np.array([powers(m, t)[0, 0] for t in range(horizon + 1)])


def first_half(path: np.ndarray) -> float | None:
    """The time at which the path, drawn through its points, first comes down to a half; None if it does not."""
    crossing = np.flatnonzero((path[:-1] > 0.5) & (path[1:] <= 0.5))
    if not len(crossing):
        return None
    i = int(crossing[0])
    return float(np.interp(-0.5, [-path[i], -path[i + 1]], [i, i + 1]))


def fit(d: DataFrame, p: int) -> Fit:
    names = regressors(p)
    return solve(gram(d, [*names, *(f"dx_{g}" for g in LEGS)]), names, p)


LAGS = (1, 2, 3, 5, 8, 13, 21)


def select_lag(designs: dict[str, DataFrame], lags: tuple[int, ...] = LAGS) -> pd.DataFrame:
    """p, n, aic, bic, best of each lag, summed over the designs of several regimes: each on one set of rows (admitted
    at the largest lag), all lags from one table of sums a regime. Regimes with too few rows for the largest are left out."""
    top = max(lags)
    names = regressors(top)
    tables = [gram(d, [*names, *(f"dx_{x}" for x in LEGS)]) for d in designs.values()]
    tables = [g for g in tables if g[0, 0] > 4 * len(names)]
    rows = []
    for p in lags if tables else ():
        fits = [solve(g, names, p, 1) for g in tables]
        n, size = sum(f.n for f in fits), len(fits) * 3 * (2 + 3 * p)
        ll = sum(f.n * float(np.linalg.slogdet(f.sigma)[1]) for f in fits)
        rows.append((p, n, ll + 2 * size, ll + size * math.log(n)))
    out = pd.DataFrame(rows, columns=["p", "n", "aic", "bic"])
    return out.assign(best=(out.bic == out.bic.min()) if len(out) else [])


def audit(d: DataFrame, f: Fit) -> list[str]:
    """What is wrong with a fit: residuals that are not finite or have a mean, a covariance that is none."""
    r = residuals(d, f)
    row = r.agg(*(F.count_if(F.col(f"u_{g}").isNull() | F.isnan(f"u_{g}") | (F.abs(f"u_{g}") == float("inf"))).alias(f"b_{g}") for g in LEGS), *(F.avg(f"u_{g}").alias(f"m_{g}") for g in LEGS), *(F.avg(F.abs(f"u_{g}")).alias(f"a_{g}") for g in LEGS)).first()
    out = [f"residuals of {g} are not all finite" for g in LEGS if row[f"b_{g}"]]
    out += [f"residuals of {g} have a mean of {row[f'm_{g}']:.2e}" for g in LEGS if not row[f"b_{g}"] and row[f"a_{g}"] is not None and abs(row[f"m_{g}"]) > 1e-6 * (row[f"a_{g}"] + 1)]
    if not np.allclose(f.sigma, f.sigma.T, atol=1e-12):
        out.append("the residual covariance is not symmetric")
    if np.linalg.eigvalsh((f.sigma + f.sigma.T) / 2).min() <= 0:
        out.append("the residual covariance is not positive definite")
    return out


def residuals(d: DataFrame, f: Fit) -> DataFrame:
    """``d`` with u_leg."""
    x = {c: (F.lit(1.0) if c == "const" else F.col(c)) for c in f.names}
    return d.withColumns({f"u_{g}": F.col(f"dx_{g}") - sum((float(f.coef[k, e]) * x[c] for k, c in enumerate(f.names)), F.lit(0.0)) for e, g in enumerate(LEGS)})


def residual_acf(d: DataFrame, f: Fit, lags: int, step: int, chunk: int) -> DataFrame:
    """leg, lag, acf, pairs: correlations of residuals with those of rows ``lag`` steps before in the same run."""
    found = lag_correlations(residuals(d, f), [(f"u_{g}", f"u_{g}") for g in LEGS], list(range(1, lags + 1)), step, chunk, "run")
    return found.select(F.get(F.array(*map(F.lit, LEGS)), F.col("pair")).alias("leg"), "lag", F.col("corr").alias("acf"), F.col("n").alias("pairs"))


def block_sums(d: DataFrame, columns: list[str], block: int, step: int, chunk: int) -> DataFrame:
    """s and the sums of ``columns`` over the ``block`` rows up to s, for rows whose block lies whole in their run."""
    reach = (block - 1) * step
    if reach > chunk:
        raise ValueError("chunks must be longer than the block")
    own = F.floor(F.col("s") / chunk)
    dealt = d.withColumn("_k", F.explode(F.array_distinct(F.array(own, F.floor((F.col("s") + reach) / chunk)))))
    w = W.partitionBy("_k", "run").orderBy("s").rangeBetween(-reach, 0)
    r = dealt.select("s", "_k", F.count("*").over(w).alias("_n"), *(F.sum(c).over(w).alias(c) for c in columns))
    return r.where((F.col("_n") == block) & (F.col("_k") == own)).select("s", *columns)


def hac(d: DataFrame, f: Fit, block: int, step: int, chunk: int, functional: np.ndarray | None = None) -> np.ndarray:
    """Covariance of q'coef of the three equations, robust to serial correlation: sums over overlapping blocks
    of ``block`` admitted rows within a run. ``functional`` picks the coefficient (the one of z1 by default)."""
    pick = np.eye(len(f.names))[1] if functional is None else functional
    q = np.linalg.solve(f.xtx, pick)
    h = sum((float(q[k]) * (F.lit(1.0) if c == "const" else F.col(c)) for k, c in enumerate(f.names)), F.lit(0.0))
    r = residuals(d, f).select("run", "s", *((h * F.col(f"u_{g}")).alias(f"h_{g}") for g in LEGS))
    s = gram(block_sums(r, [f"h_{g}" for g in LEGS], block, step, chunk), [f"h_{g}" for g in LEGS])
    return s / block * f.n / (f.n - len(f.names))


def hac_by_lags(d: DataFrame, f: Fit, block: int, step: int, chunk: int) -> np.ndarray:
    """What ``hac`` gives for z1, from products of rows k steps apart instead of block sums: a pair of rows of a run counts
    once for each whole block that holds both."""
    q = np.linalg.solve(f.xtx, np.eye(len(f.names))[1])
    h = sum((float(q[k]) * (F.lit(1.0) if c == "const" else F.col(c)) for k, c in enumerate(f.names)), F.lit(0.0))
    r = residuals(d, f).select("s", "run", *((h * F.col(f"u_{g}")).alias(f"h_{g}") for g in LEGS))
    runs = r.groupBy("run").agg(F.min("s").alias("_lo"), F.count("*").alias("_n"))
    r = r.join(runs, "run").select("s", F.struct("run", "_n", ((F.col("s") - F.col("_lo")) / step).alias("at"), *(f"h_{g}" for g in LEGS)).alias("v"))
    r = O.with_lagged(r, {f"l{k}": ("v", k) for k in range(1, block)}, step, chunk)
    at, n = F.col("v.at"), F.col("v._n")
    held = lambda k: F.greatest(F.lit(0), F.least(at - k, n - block) - F.greatest(F.lit(0), at - block + 1) + 1)
    before = {g: sum((F.when(F.col(f"l{k}.run") == F.col("v.run"), held(k) * F.col(f"l{k}.h_{g}")).otherwise(0.0) for k in range(1, block)), F.lit(0.0)) for g in LEGS}
    r = r.select(*(F.col(f"v.h_{g}").alias(f"h_{g}") for g in LEGS), held(0).alias("_w"), *(c.alias(f"b_{g}") for g, c in before.items()))
    sums = r.agg(*(F.sum(F.col("_w") * F.col(f"h_{x}") * F.col(f"h_{y}")).alias(f"s_{x}_{y}") for x in LEGS for y in LEGS), *(F.sum(F.col(f"h_{x}") * F.col(f"b_{y}")).alias(f"c_{x}_{y}") for x in LEGS for y in LEGS)).first()
    own, cross = (np.array([[sums[f"{k}_{x}_{y}"] for y in LEGS] for x in LEGS], float) for k in "sc")
    return (own + cross + cross.T) / block * f.n / (f.n - len(f.names))


def fingerprint(d: DataFrame, p: int) -> tuple:
    """rows, a sum of hashes of what a design holds as it is (times, lags), and sums of what it centres."""
    raw = ["s", *(f"dx_{g}_{i}" for i in range(1, p + 1) for g in LEGS)]
    row = d.agg(F.count("*"), F.sum(F.xxhash64(*raw).cast("decimal(38,0)")), *(F.sum(F.abs(c)) for c in ("z1", *(f"dx_{g}" for g in LEGS)))).first()
    return tuple(row)


def audit_tests(d: DataFrame, other: DataFrame, f: Fit, p: int, block: int, step: int, chunk: int) -> list[tuple[str, float, bool]]:
    """(check, value, passed) of what block tests rest on: the robust covariance built in two ways, the designs ``d`` and
    ``other`` of two stages, and shares of closing that add up to one."""
    one, two = hac(d, f, block, step, chunk), hac_by_lags(d, f, block, step, chunk)
    gap = float(np.abs(one - two).max() / np.abs(one).max())
    a, b = fingerprint(d, p), fingerprint(other, p)
    apart = max(abs(x - y) / max(abs(x), 1e-300) for x, y in zip(a[2:], b[2:], strict=True)) if a[0] and b[0] else float("inf")
    shares = abs(sum(closure_shares(f).values()) - 1)
    return [("robust covariance", gap, gap <= 1e-8), ("same rows", float(abs(a[0] - b[0])), a[:2] == b[:2]), ("same centring", apart, apart <= 1e-9), ("closing shares", shares, shares <= 1e-9)]


@dataclass
class Functional:
    """Linear functionals Q'beta of a model for the target ``weight`` (on dx_a, dx_b, dx_c): ``beta`` has K and
    ``q`` K x m numbers in the order of the design's regressors; ``k`` regressors are in the model."""

    weight: np.ndarray
    beta: np.ndarray
    q: np.ndarray
    k: int


def long_run(d: DataFrame, names: list[str], wanted: list[Functional], block: int, step: int, chunk: int, n: int) -> list[np.ndarray]:
    """The covariances of several functionals, robust to serial correlation, in one pass.

    Spark deals the rows to chunks of time, the last of each also to the next; a task takes a chunk's block sums of
    every functional and gives their products, which Spark adds up."""
    reach = (block - 1) * step
    if reach > chunk:
        raise ValueError("chunks must be longer than the block")
    columns = [c for c in names if c != "const"]

    def partial(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        s, run = g["s"].to_numpy(), g["run"].to_numpy()
        x = np.column_stack([np.ones(len(g)) if c == "const" else g[c].to_numpy(float) for c in names])
        y = g[[f"dx_{x}" for x in LEGS]].to_numpy(float)
        whole = np.flatnonzero((run[block - 1 :] == run[: len(run) - block + 1]) & (s[block - 1 :] - s[: len(s) - block + 1] == reach) & (s[block - 1 :] // chunk == g["_k"].iloc[0])) if len(g) >= block else np.zeros(0, int)
        out = []
        for number, f in enumerate(wanted):
            phi = (x @ f.q) * (y @ f.weight - x @ f.beta)[:, None]
            sums = np.vstack([np.zeros(phi.shape[1]), np.cumsum(phi, axis=0)])
            b = sums[whole + block] - sums[whole]
            i, j = np.indices((phi.shape[1],) * 2)
            out.append(pd.DataFrame({"f": number, "i": i.ravel(), "j": j.ravel(), "v": (b.T @ b).ravel()}))
        return pd.concat(out)

    dealt = d.select("s", "run", *columns, *(f"dx_{g}" for g in LEGS)).withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / chunk), F.floor((F.col("s") + reach) / chunk)))))
    total = dealt.groupBy("_k").applyInPandas(partial, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v"))
    out = [np.zeros((f.q.shape[1],) * 2) for f in wanted]
    for r in total.collect():  # a row for each pair of functionals
        out[r.f][r.i, r.j] = r.v
    return [m / block * n / max(1, n - f.k) for m, f in zip(out, wanted, strict=True)]


def daily(d: DataFrame, p: int, least: int, key: str = "cell") -> pd.DataFrame:
    """key, n, lam, half_life of a fit for each cell with ``least`` rows, solved where Spark groups the cell's sums."""
    names = regressors(p)
    columns = [*names, *(f"dx_{g}" for g in LEGS)]
    sums = gram_sql(d, columns, [key])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(columns), len(columns)))
        place = {c: k for k, c in enumerate(columns)}
        for i, j, v in zip(g.i, g.j, g.v, strict=True):
            m[place[i], place[j]] = m[place[j], place[i]] = v
        empty = pd.DataFrame({key: [], "n": [], "lam": [], "half_life": []})
        if m[0, 0] < max(least, 4 * len(names) + 1):
            return empty
        f = solve(m, names, p)
        return pd.DataFrame({key: [g[key].iloc[0]], "n": [f.n], "lam": [f.lam], "half_life": [np.nan if f.half_life is None else f.half_life]})

    return sums.groupBy(key).applyInPandas(one, f"{key} long, n long, lam double, half_life double")


def closure_shares(f: Fit) -> dict[str, float]:
    """What part of the gap's closing each leg does; the parts add up to 1."""
    return {g: w * float(a) / f.lam for g, w, a in zip(LEGS, WEIGHTS, f.alpha, strict=True)}


def coefficients(f: Fit, regime: str) -> list[tuple]:
    """(regime, equation, term, coef) of all coefficients; a term ends in its lag, as in ``dx_a(-2)``."""
    term = lambda c: c if c == "const" else "z(-1)" if c == "z1" else f"{c.rpartition('_')[0]}(-{c.rpartition('_')[2]})"
    return [(regime, g, term(c), float(f.coef[k, e])) for e, g in enumerate(LEGS) for k, c in enumerate(f.names)]


TERMS = "regime string, equation string, term string, coef double"


def lag_order(stored: DataFrame) -> DataFrame:
    """regime, p: the lag order of stored coefficients, read from their terms."""
    lag = F.expr("try_cast(nullif(regexp_extract(term, '[(]-([0-9]+)[)]', 1), '') AS int)")
    return stored.groupBy("regime").agg(F.max(lag).alias("p"))


def compared(mine: DataFrame, stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """regime, equation, terms, worst, agrees: coefficients against stored ones, as a share of the largest stored one.

    A regime that is not stored whole has a null ``worst`` and does not agree."""
    both = mine.join(stored.select("regime", "equation", "term", F.col("coef").alias("other")), ["regime", "equation", "term"], "left")
    g = both.groupBy("regime", "equation").agg(F.count("*").alias("terms"), F.count("other").alias("have"), F.max(F.abs(F.col("coef") - F.col("other"))).alias("gap"), F.max(F.abs("other")).alias("size"))
    worst = F.when(F.col("terms") == F.col("have"), F.col("gap") / F.greatest(F.col("size"), F.lit(1e-6)))
    return g.select("regime", "equation", "terms", worst.alias("worst"), F.coalesce(worst <= tolerance, F.lit(False)).alias("agrees"))


def exogeneity(d: DataFrame, f: Fit, regime: str, block: int, step: int, chunk: int, z: float = 1.96) -> list[tuple]:
    """(regime, term, coef, lo, hi, t, expected, holds): each leg's adjustment with its robust interval, and whether
    its sign is the one that closes a gap."""
    s, w = hac(d, f, block, step, chunk), np.array(WEIGHTS)
    out = []
    for k, (g, a) in enumerate(zip(LEGS, f.alpha, strict=True)):
        se, sign = float(np.sqrt(s[k, k])), -np.sign(WEIGHTS[k])
        out.append((regime, g, float(a), float(a) - z * se, float(a) + z * se, float(a) / se, "> 0" if sign > 0 else "< 0", bool(a * sign > 0)))
    se = float(np.sqrt(w @ s @ w))
    return [*out, (regime, "lambda", f.lam, f.lam - z * se, f.lam + z * se, f.lam / se, "< 0", f.lam < 0)]


EXOGENEITY = "regime string, term string, coef double, lo double, hi double, t double, expected string, holds boolean"
