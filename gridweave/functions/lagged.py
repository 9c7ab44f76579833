"""Correlations at many lags from sums of chunks.

Spark deals rows to chunks of time, those near an edge also to the neighbours; a task computes a chunk's counts, means and
products for every lag and pair of columns side by side, and Spark puts the chunks together. No row is copied for a lag.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.tables import stored

SUMS = "pair int, lag int, n long, mx double, my double, xx double, yy double, xy double"


def lag_correlations(df: DataFrame, pairs: list[tuple[str, str]], lags: list[int], step: int, chunk: int, run: str) -> DataFrame:
    """pair (its number in ``pairs``), lag, n, corr of x at s with y at s - lag * step, both in one run, for every (x, y)
    and lag. Rows without one of the values are left out of that pair; corr is null where a side does not vary."""
    reach = max(map(abs, lags)) * step
    if reach > chunk:
        raise ValueError("chunks must be longer than the reach")
    names = list(dict.fromkeys(c for p in pairs for c in p))
    near = F.array_distinct(F.array(*(F.floor((F.col("s") + k) / chunk) for k in (0, -reach, reach))))
    dealt = df.select("s", F.col(run).alias("_run"), *(F.col(c).cast("double").alias(c) for c in names)).withColumn("_k", F.explode(near))

    def partial(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        s, runs, values = g["s"].to_numpy(), g["_run"].to_numpy(), {c: g[c].to_numpy(float) for c in names}
        here = np.flatnonzero(s // chunk == g["_k"].iloc[0])
        out = []
        for lag in lags:
            target = s[here] - lag * step
            at = np.minimum(np.searchsorted(s, target), len(s) - 1)
            ok = (s[at] == target) & (runs[at] == runs[here])
            a, b = here[ok], at[ok]
            for i, (x, y) in enumerate(pairs):
                u, v = values[x][a], values[y][b]
                both = ~(np.isnan(u) | np.isnan(v))
                u, v = u[both], v[both]
                if len(u):
                    mx, my = u.mean(), v.mean()
                    out.append((i, lag, len(u), mx, my, ((u - mx) ** 2).sum(), ((v - my) ** 2).sum(), ((u - mx) * (v - my)).sum()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])

    parts = stored(dealt.groupBy("_k").applyInPandas(partial, SUMS), "lags")  # a row a chunk, lag and pair
    n = F.col("n")
    means = parts.groupBy("pair", "lag").agg(F.sum("n").alias("_n"), F.sum(n * F.col("mx")).alias("_x"), F.sum(n * F.col("my")).alias("_y"))
    apart = lambda own, total: F.col(own) - F.col(total) / F.col("_n")
    dx, dy = apart("mx", "_x"), apart("my", "_y")
    t = parts.join(means, ["pair", "lag"]).groupBy("pair", "lag").agg(
        F.sum("n").alias("n"), F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"),
        F.max(F.abs("mx")).alias("mx"), F.max(F.abs("my")).alias("my"),
    )
    # what rounding of the means leaves is no variance
    varies = (F.col("xx") > n * F.pow(F.col("mx") * 1e-14, F.lit(2.0))) & (F.col("yy") > n * F.pow(F.col("my") * 1e-14, F.lit(2.0)))
    return t.select("pair", "lag", "n", F.when(varies, F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("corr"))
