"""Exact Bayesian segmentation of a bucketed series with up to two changes.

Models: M0 one segment; M1 one change; M2 two changes with equal outer segments; M3 two changes, three
segments. A segment's evidence is that of a normal with a normal-inverse-gamma prior, from prefix sums of
the whitened series, for each autocorrelation of a grid. All placements with segments of at least ``least`` buckets are
enumerated, but none is kept: a task gets the prefix sums of a series and a block of first changes, and gives back log
sums over the placements of each first change, each second change and of all, which add up over blocks. What leaves the
tasks is a few rows a bucket. Many series (variants, simulated ones) are handled side by side, told apart by ``key``,
each with its own settings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.functions.tables import small, stored
from gridweave.operators import stats as S

#: Prior: weight of the mean, shape; the scale follows from the variance of the series.
K0, A0 = 0.01, 2.0
RHOS = tuple(0.9 * i / 7 for i in range(8))


def bucket_features(panel: DataFrame, value: str, bucket: int, step: int, shut: tuple[int, int] | None, chunk: int) -> DataFrame:
    """s, n, mad, iqr, move_share, rho1, roll_c, coverage, moves of each bucket; rows in ``shut`` (seconds of the day)
    are left out. rho1 and roll_c are of a bucket's increments, those that are missing closed up."""
    from gridweave.operators import runs

    d = O.with_previous(panel.select("s", F.col(value).alias("v")), {"prev_s": "s", "_pv": "v"}, chunk)
    d = d.withColumn("dv", F.when(O.adjacent(step), F.col("v") - F.col("_pv")))
    if shut:
        d = d.where(~runs.in_window(*shut))
    d = d.withColumn("b", F.floor(F.col("s") / bucket) * bucket)
    mid = d.groupBy("b").agg(F.median("v").alias("_m"))
    g = d.join(mid, "b").groupBy("b").agg(
        F.count("*").alias("n"), (1.4826 * F.median(F.abs(F.col("v") - F.col("_m")))).alias("mad"), (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"),
        F.count_if(F.col("dv") != 0).alias("moves"), F.count("dv").alias("_d"),
    )
    before = F.lag("dv").over(W.partitionBy("b").orderBy("s"))  # within a bucket
    pairs = d.where("dv is not null").select("b", "dv", before.alias("_pd"))
    pair = F.col("_pd").isNotNull()
    x = F.when(pair, F.col("dv"))
    serial = pairs.groupBy("b").agg(S.corr(x, F.col("_pd")).alias("_r"), F.covar_samp(x, "_pd").alias("_c"), F.count("*").alias("_k"))
    g = g.join(serial, "b", "left")
    rho = F.when(F.col("_k") > 2, F.col("_r"))
    roll = F.when((F.col("_k") >= 3) & (F.col("_c") < 0), F.sqrt(-F.col("_c")))
    room = F.lit(bucket / step)
    if shut:
        lo = F.pmod(F.col("b"), F.lit(86_400))
        room = (bucket - F.greatest(F.lit(0), F.least(lo + bucket, F.lit(shut[1])) - F.greatest(lo, F.lit(shut[0])))) / step
    return g.select(F.col("b").alias("s"), "n", "mad", "iqr", F.try_divide("moves", F.col("_d").cast("double")).alias("move_share"), rho.alias("rho1"), roll.alias("roll_c"), F.try_divide("n", room).alias("coverage"), "moves")


def refusals(buckets: DataFrame, coverage: float, moves: int) -> DataFrame:
    """One row: how many buckets there are, how many fail each test, and how many pass all."""
    tests = {"coverage": F.col("coverage") >= coverage, "mad": F.col("mad") > 0, "iqr": F.col("iqr") > 0, "moves": F.col("moves") >= moves}
    every = F.lit(True)
    for t in tests.values():
        every = every & F.coalesce(t, F.lit(False))
    return buckets.agg(F.count("*").alias("buckets"), *(F.count_if(~F.coalesce(t, F.lit(False))).alias(f"fail_{n}") for n, t in tests.items()), F.count_if(every).alias("admitted"))


def admitted(buckets: DataFrame, coverage: float, moves: int, refuse: bool = False) -> DataFrame:
    """Buckets that pass all tests; with ``refuse`` an error that says how many fail each where none does."""
    if refuse and not (counts := refusals(buckets, coverage, moves).first()).admitted:
        raise ValueError(f"no bucket is admitted: {counts.asDict()}")
    return buckets.where((F.col("coverage") >= coverage) & (F.col("mad") > 0) & (F.col("iqr") > 0) & (F.col("moves") >= moves))


def persistence(rho: Column) -> Column:
    """arctanh of an autocorrelation, kept from the ends."""
    return F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), rho)))


def ended_before(buckets: DataFrame, bucket: int, event: int) -> DataFrame:
    """Buckets that end at or before a time."""
    return buckets.where(F.col("s") + bucket <= event)


def deseasoned(buckets: DataFrame, value: str, slot: Column, bucket: int, settled: int, chunk: int) -> DataFrame:
    """``value`` less the median of its slot of the day, then less that of its session age (``settled`` and beyond are 0)."""
    from gridweave.operators import runs

    d = runs.session_age(buckets, bucket, chunk).withColumns({"slot": slot, "band": F.least("age", F.lit(settled))})
    profile = d.groupBy("slot").agg(F.median(value).alias("_p"))
    d = d.join(profile, "slot").withColumn("_r", F.col(value) - F.col("_p"))
    bands = d.groupBy("band").agg(F.median("_r").alias("_b"))
    rest = bands.where(F.col("band") == settled).agg(F.max("_b").alias("_s"))
    bands = bands.crossJoin(F.broadcast(rest)).select("band", (F.col("_b") - F.coalesce("_s", F.lit(0.0))).alias("_b"))  # at most settled + 1 rows
    return d.join(F.broadcast(bands), "band").withColumn("y", F.col("_r") - F.col("_b")).drop("_p", "_r", "_b")


def deseasoned_each(series: DataFrame) -> DataFrame:
    """key, s, y of many series (key, s, v) at once, each ``deseasoned`` by its own ``size`` of buckets and ``settled``, or
    ``raw``, as it is. Windows of a series: it has a row a bucket, some thousands."""
    own = W.partitionBy("key").orderBy("s")
    new = ~F.coalesce(F.col("s") - F.lag("s").over(own) == F.col("size"), F.lit(False))
    d = series.withColumn("_run", F.sum(new.cast("int")).over(own)).withColumn("slot", F.floor(F.pmod("s", F.lit(86_400)) / F.col("size")))
    d = d.withColumn("band", F.least(F.row_number().over(W.partitionBy("key", "_run").orderBy("s")) - 1, "settled"))
    d = d.withColumn("_r", F.col("v") - F.median("v").over(W.partitionBy("key", "slot")))
    d = d.withColumn("_b", F.median("_r").over(W.partitionBy("key", "band")))
    rest = F.max(F.when(F.col("band") == F.col("settled"), F.col("_b"))).over(W.partitionBy("key"))
    return d.select("key", "s", F.when(F.col("raw"), F.col("v")).otherwise(F.col("_r") - (F.col("_b") - F.coalesce(rest, F.lit(0.0)))).alias("y"))


#: Settings of a series: seconds of its buckets, shortest segment, weight of the prior's mean, autocorrelations.
def settings(step: int, least: int, k0: float = K0, rhos: tuple[float, ...] = RHOS) -> dict:
    return {"step": step, "least": least, "k0": k0, "rhos": [float(r) for r in rhos]}


SETTINGS = "key string, step long, least long, k0 double, rhos array<double>"
SUMS = ("ww", "wz", "zz")
CELLS = 1 << 19  #: placements that a task looks at side by side
BLOCKS = 8  #: blocks of first changes that share one copy of a series' sums


def parameters(series: DataFrame, each: dict[str, dict]) -> DataFrame:
    """A row a key: its settings, n and the prior (m0, b0) from its values.

    Of a series that does not vary no sum of squares is left: b0 to the same power is a factor of all models' evidence,
    and any positive one gives the limit of their shares; it is as large as the values, so that rounding does not count."""
    own = series.sparkSession.createDataFrame([(k, v["step"], v["least"], v["k0"], v["rhos"]) for k, v in each.items()], SETTINGS)
    stats = series.groupBy("key").agg(F.count("y").alias("n"), F.avg("y").alias("m0"), F.var_samp("y").alias("_v"), (F.min("y") < F.max("y")).alias("_varies"))
    b0 = F.when(F.col("_varies") & (F.col("_v") > 0), (A0 - 1) * F.col("_v")).otherwise(F.greatest(F.lit(1.0), F.col("m0") * F.col("m0")))  # sums leave a flat series' variance near 0, not at it
    return stats.join(F.broadcast(own), "key").withColumn("b0", b0).drop("_v", "_varies")


def whitened(series: DataFrame, params: DataFrame) -> DataFrame:
    """key, rho, i, and of bucket i the weights and values (w, z) after a neighbour, and (w1, z1) as the first of a segment.

    A window a series: it has a row a bucket, some thousands."""
    order = W.partitionBy("key").orderBy("s")
    d = series.select("key", "s", "y", F.lag("s").over(order).alias("_ps"), F.lag("y").over(order).alias("_py"), F.row_number().over(order).cast("long").alias("i"))
    d = d.join(F.broadcast(params.select("key", "step", "rhos")), "key")  # a row a key
    d = d.select("key", "i", "s", "y", "_py", F.coalesce(F.col("s") - F.col("_ps") == F.col("step"), F.lit(False)).alias("near"), F.explode("rhos").alias("rho"))
    first = F.sqrt(1 - F.col("rho") * F.col("rho"))
    w, z = F.when(F.col("near"), 1 - F.col("rho")).otherwise(first), F.when(F.col("near"), F.col("y") - F.col("rho") * F.col("_py")).otherwise(F.col("y") * first)
    return d.select("key", "rho", "i", "s", w.alias("w"), z.alias("z"), first.alias("w1"), (F.col("y") * first).alias("z1"))


def prefix(rows: DataFrame) -> DataFrame:
    """Per key, rho and i the sums before i (p_ww, p_wz, p_zz), its own (x_) and what changes when i begins a segment (d_)."""
    w = W.partitionBy("key", "rho").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    x = {"ww": (F.col("w") * F.col("w"), F.col("w1") * F.col("w1")), "wz": (F.col("w") * F.col("z"), F.col("w1") * F.col("z1")), "zz": (F.col("z") * F.col("z"), F.col("z1") * F.col("z1"))}
    d = rows.select("key", "rho", "i", *(v[0].alias(f"x_{k}") for k, v in x.items()), *((v[1] - v[0]).alias(f"d_{k}") for k, v in x.items()))
    return d.select("key", "rho", "i", *(F.coalesce(F.sum(f"x_{k}").over(w), F.lit(0.0)).alias(f"p_{k}") for k in SUMS), *(f"{x}_{k}" for x in "dx" for k in SUMS))


def evidence(count: np.ndarray, sums: np.ndarray, prior: tuple[float, float, float], gammas: np.ndarray) -> np.ndarray:
    """Log evidence of segments of so many buckets from their sums (ww, wz, zz). ``prior``: k0, m0, b0; ``gammas``: ln
    gamma(A0 + i / 2) for every i up to the largest count."""
    k0, m0, b0 = prior
    ww, wz, zz = sums
    kn, an = ww + k0, count / 2 + A0
    mn = (wz + k0 * m0) / kn
    bn = np.maximum(1e-300, (zz + k0 * m0 * m0 - kn * mn * mn) / 2 + b0)
    with np.errstate(invalid="ignore"):  # cells that are no placement
        return gammas[count] + A0 * math.log(b0) - math.lgamma(A0) - an * np.log(bn) + (math.log(k0) - np.log(kn)) / 2 - count / 2 * math.log(2 * math.pi)


def log_sum_exp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """ln of the sum of exp(x), minus infinity where there is nothing to add."""
    top = np.max(x, axis=axis, keepdims=True, initial=-np.inf)
    total = np.sum(np.exp(x - np.where(np.isfinite(top), top, 0)), axis=axis, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.squeeze(top + np.log(total), axis=axis) if axis is not None else (top + np.log(total)).reshape(())[()]


MODELS = ("M0", "M1", "M2", "M3")
FOLDED = "key string, rho double, model string, which string, at long, lz double, configs long"


def fold_block(n: int, least: int, prior: tuple[float, float, float], p: np.ndarray, d: np.ndarray, t: np.ndarray, lo: int, hi: int, models: tuple[str, ...]) -> Iterator[tuple[str, str, int | None, float, int]]:
    """(model, which, at, lz, configs) of the placements whose first change is in [lo, hi), counted from 0: by first and
    second change (``at`` is counted from 1) and over ``all``. ``p``, ``d``, ``t``: rows ww, wz, zz of the sums before each
    bucket, of what its beginning a segment changes, and of the whole series."""
    gammas = np.array([math.lgamma(A0 + i / 2) for i in range(n + 1)])
    if lo == 0 and "M0" in models:
        yield "M0", "all", None, float(evidence(np.array([n]), t[:, None], prior, gammas)[0]), 1
    i = np.arange(max(lo, least), min(hi, n - least + 1))
    if not len(i):
        return
    after = t[:, None] - p + d  # of the buckets from each one on
    head, tail = evidence(i, p[:, i], prior, gammas), evidence(n - np.arange(n), after, prior, gammas)
    if "M1" in models:
        one = head + tail[i]
        yield from (("M1", "t1", int(at) + 1, float(v), 1) for at, v in zip(i, one, strict=True))
        yield "M1", "all", None, float(log_sum_exp(one)), len(one)
    j = np.arange(i[0] + least, n - least + 1)
    if not len(j) or not {"M2", "M3"} & set(models):
        return
    span = j[None, :] - i[:, None]
    there = span >= least
    span = np.where(there, span, least)
    middle = evidence(span, (p[:, None, j] - p[:, i, None]) + d[:, i, None], prior, gammas)
    outer = {"M2": lambda: evidence(n - span, p[:, i, None] + after[:, None, j], prior, gammas), "M3": lambda: head[:, None] + tail[None, j]}
    first, second = there.sum(axis=1), there.sum(axis=0)
    for model in ("M2", "M3"):
        if model in models:
            ll = np.where(there, middle + outer[model](), -np.inf)
            yield from ((model, "t1", int(at) + 1, float(v), int(c)) for at, v, c in zip(i, log_sum_exp(ll, 1), first, strict=True) if c)
            yield from ((model, "t2", int(at) + 1, float(v), int(c)) for at, v, c in zip(j, log_sum_exp(ll, 0), second, strict=True) if c)
            yield model, "all", None, float(log_sum_exp(ll)), int(there.sum())


def folds(series: DataFrame, each: dict[str, dict], models: tuple[str, ...] = MODELS) -> DataFrame:
    """key, rho, model, which, at, lz, configs: log sums of the evidence of all placements of every series (key, s, y) with
    its ``settings``, by first change (``t1``, 1-based bucket that begins a segment), second (``t2``) and over ``all``."""
    params = small(parameters(series, each))  # a row a key
    rows = prefix(stored(whitened(series, params), "whitened"))
    columns = [f"{x}_{k}" for x in "pd" for k in SUMS]
    whole = rows.groupBy("key", "rho").agg(F.array_sort(F.collect_list(F.struct("i", *columns, *(f"x_{k}" for k in SUMS)))).alias("r"))  # a series: a row a bucket
    arrays = [F.col("r")[c].alias(c) for c in columns]
    total = [(F.element_at("r", -1)[f"p_{k}"] + F.element_at("r", -1)[f"x_{k}"]).alias(f"t_{k}") for k in SUMS]
    d = whole.join(F.broadcast(params.select("key", "n", "least", "k0", "m0", "b0")), "key").select("key", "rho", "n", "least", "k0", "m0", "b0", *arrays, *total)
    size = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("n")))
    d = d.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, size * BLOCKS)).alias("lo")).repartition("key", "rho", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at] for c in batch.schema.names}
                value = lambda c, r=r: r[c].as_py()
                p, diff = (np.stack([r[f"{x}_{k}"].values.to_numpy(zero_copy_only=False) for k in SUMS]) for x in "pd")
                t, prior = np.array([value(f"t_{k}") for k in SUMS]), (value("k0"), value("m0"), value("b0"))
                n, size, first = value("n"), value("size"), value("lo")
                for lo in range(first, min(first + size * BLOCKS, n), size):
                    out = list(fold_block(n, value("least"), prior, p, diff, t, lo, lo + size, models))
                    if not out:
                        continue
                    model, which, place, lz, configs = zip(*out, strict=True)
                    same = [pa.array([value("key")] * len(out)), pa.array([value("rho")] * len(out))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(model), pa.array(which), pa.array(place, pa.int64()), pa.array(lz), pa.array(configs, pa.int64())], ["key", "rho", "model", "which", "at", "lz", "configs"])

    parts = d.mapInArrow(run, FOLDED).groupBy("key", "rho", "model", "which", "at").agg(F.collect_list("lz").alias("parts"), F.sum("configs").alias("configs"))  # a value a block
    return stored(parts.select("key", "rho", "model", "which", "at", added("parts").alias("lz"), "configs"), "folds")


def added(parts: str) -> Column:
    """ln of the sum of exp of an array."""
    top = F.array_max(parts)
    return top + F.log(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def fold(series: DataFrame, step: int, least: int, rhos: tuple[float, ...] = RHOS) -> DataFrame:
    """The log sums of one series (s, y)."""
    return folds(series.withColumn("key", F.lit("")), {"": settings(step, least, K0, rhos)})


def log_sum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """ln of the sum of exp(value) by key, and the number of rows."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_m"))
    return df.join(top, keys).groupBy(*keys, "_m").agg(F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s"), F.count("*").alias("configs")).select(*keys, (F.col("_m") + F.log("_s")).alias(name), "configs")


def models(folded: DataFrame) -> DataFrame:
    """key, model, configs, log_z (mean over placements and rhos), posterior (equal weights)."""
    z = folded.where("which = 'all'").select("key", "model", "rho", "configs", (F.col("lz") - F.log(F.col("configs").cast("double"))).alias("lz"))
    each = log_sum(z.select("key", "model", "rho", "lz"), ["key", "model"], "lz", "log_z")
    c = z.groupBy("key", "model").agg(F.max("configs").alias("configs"))
    out = each.select("key", "model", (F.col("log_z") - F.log(F.col("configs").cast("double"))).alias("log_z")).join(c, ["key", "model"])
    by = W.partitionBy("key")  # four rows
    w = F.exp(F.col("log_z") - F.max("log_z").over(by))
    return out.withColumn("posterior", w / F.sum(w).over(by))


def change_marginals(folded: DataFrame) -> DataFrame:
    """key, model, which (t1 or t2), at, prob: posterior of each change, rhos weighted by their evidence."""
    d = folded.where("at is not null")
    top = d.groupBy("key", "model").agg(F.max("lz").alias("_m"))
    g = d.join(F.broadcast(top), ["key", "model"]).groupBy("key", "model", "which", "at").agg(F.sum(F.exp(F.col("lz") - F.col("_m"))).alias("w"))  # three rows a key
    return g.select("key", "model", "which", "at", (F.col("w") / F.sum("w").over(W.partitionBy("key", "model", "which"))).alias("prob"))  # a row a bucket


def change_marginal(folded: DataFrame, model: str, which: str) -> DataFrame:
    """at, prob of one series."""
    return change_marginals(folded.where(F.col("model") == model)).where(F.col("which") == which).select("at", "prob")


def credible(marginal: DataFrame, mass: float = 0.95) -> DataFrame:
    """mode, median and the shortest window (lo, hi) of at least ``mass``; a row a bucket comes in."""
    w = W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    c = marginal.withColumn("cum", F.sum("prob").over(w))
    a, b = c.alias("a"), c.alias("b")
    windows = a.join(b, F.col("b.at") >= F.col("a.at")).where(F.col("b.cum") - F.col("a.cum") + F.col("a.prob") >= mass - 1e-12)
    shortest = windows.agg(F.min_by(F.struct(F.col("a.at").alias("lo"), F.col("b.at").alias("hi")), F.struct(F.col("b.at") - F.col("a.at"), F.col("a.at"))).alias("w"))
    point = c.agg(F.max_by("at", F.struct(F.round("prob", 12), -F.col("at"))).alias("mode"), F.min(F.when(F.col("cum") >= 0.5, F.col("at"))).alias("median"))
    return point.crossJoin(shortest).select("mode", "median", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))  # one row each


def bracket(series: DataFrame, window: DataFrame, step: int) -> DataFrame:
    """after, until, spans_gap: what the shortest window (lo, hi) says of when the change was: after the bucket before
    ``lo`` ended and by the start of bucket ``hi``; ``spans_gap`` if buckets are missing in between."""
    order = W.orderBy("s")  # a row a bucket
    d = series.select("s", F.row_number().over(order).alias("i"), F.lag("s").over(order).alias("_ps"))
    d = d.crossJoin(F.broadcast(window.select("lo", "hi")))  # one row
    out = d.agg(
        F.max(F.when(F.col("i") == F.col("lo"), F.coalesce(F.col("_ps") + step, F.col("s")))).alias("after"), F.max(F.when(F.col("i") == F.col("hi"), F.col("s"))).alias("until"),
        F.bool_or((F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi")) & ~F.coalesce(F.col("s") - F.col("_ps") == step, F.lit(False))).alias("spans_gap"),
    )
    return out


def segment_probabilities(folded: DataFrame, sizes: DataFrame, models: tuple[str, ...] = ("M1", "M2", "M3")) -> DataFrame:
    """key, model, i, p: array with the probability of each segment's label at bucket i, from running sums over the ends.

    M1 has two labels; M2 two as well, its outer segments sharing the first; M3 three. ``sizes``: key, n."""
    m = change_marginals(folded)
    ends = m.groupBy("key", "model", F.col("at").alias("i")).agg(F.sum(F.when(F.col("which") == "t1", F.col("prob"))).alias("b"), F.sum(F.when(F.col("which") == "t2", F.col("prob"))).alias("e"))
    full = sizes.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).select("key", "i", F.explode(F.array(*map(F.lit, models))).alias("model"))
    w = W.partitionBy("key", "model").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    run = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(w)
    d = full.join(ends, ["key", "model", "i"], "left").select("key", "model", "i", run("b").alias("b"), run("e").alias("e"))
    b, e = F.col("b"), F.col("e")
    return d.select("key", "model", "i", F.when(F.col("model") == "M1", F.array(1 - b, b)).when(F.col("model") == "M2", F.array(1 - b + e, b - e)).otherwise(F.array(1 - b, b - e, e)).alias("p"))


def chosen(folded: DataFrame) -> DataFrame:
    """key, model: that of the largest evidence, of equals the simplest."""
    return models(folded).groupBy("key").agg(F.max_by("model", F.struct(F.round("log_z", 9), -F.substring("model", 2, 1).cast("int"))).alias("model"))


def chosen_probabilities(folded: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, model, i, p under the chosen model: as many labels as it has different segments, one where nothing changes."""
    one = chosen(folded).transform(small)  # a row a key
    flat = sizes.join(one.where("model = 'M0'"), "key").select("key", "model", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"), F.array(F.lit(1.0)).alias("p"))
    return segment_probabilities(folded, sizes).join(F.broadcast(one), ["key", "model"]).select("key", "model", "i", "p").unionByName(flat)


def middle_probability(folded: DataFrame, n: int, model: str = "M2") -> DataFrame:
    """i, p: probability that bucket i of one series lies in the middle segment."""
    sizes = folded.select("key").distinct().withColumn("n", F.lit(n).cast("long"))
    return segment_probabilities(folded.where(F.col("model") == model), sizes, (model,)).select("i", F.get("p", 1).alias("p"))


def fits(series: DataFrame, folded: DataFrame, force: str | None = None) -> DataFrame:
    """key, best, posterior, log_bf (M2 against M0), rho, onset, back, ratio of every series: the chosen model (or
    ``force``), its modal changes, and the size of the shift they make: exp of the mean of the highest segment less
    that of the rest (outer segments of M2 are one)."""
    z = models(folded)
    by = lambda m: F.max(F.when(F.col("model") == m, F.col("log_z")))
    chosen = z.groupBy("key").agg(F.lit(force).alias("best") if force else F.max_by("model", "log_z").alias("best"), F.max_by("posterior", F.when(F.col("model") == force, 1) if force else F.col("log_z")).alias("posterior"), (by("M2") - by("M0")).alias("log_bf"))
    lz = folded.where("which = 'all'").groupBy("key", "model").agg(F.max_by("rho", F.struct("lz", -F.col("rho"))).alias("rho")).withColumnRenamed("model", "best")
    m = change_marginals(folded).groupBy("key", F.col("model").alias("best"), "which").agg(F.max_by("at", F.struct(F.round("prob", 12), -F.col("at"))).alias("at"))
    at = m.groupBy("key", "best").agg(F.max(F.when(F.col("which") == "t1", F.col("at"))).alias("onset"), F.max(F.when(F.col("which") == "t2", F.col("at"))).alias("back"))
    f = chosen.join(lz, ["key", "best"]).join(at, ["key", "best"], "left")
    i = F.row_number().over(W.partitionBy("key").orderBy("s"))
    rows = series.withColumn("i", i).join(F.broadcast(f.select("key", "best", "onset", "back")), "key")  # a row a key
    label = F.when(F.col("i") < F.col("onset"), 0).when(F.col("back").isNull() | (F.col("i") < F.col("back")), 1).otherwise(F.when(F.col("best") == "M3", 2).otherwise(0))
    seg = rows.where("onset is not null").groupBy("key", label.alias("label")).agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    hot = seg.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.max_by(F.struct("n", "t"), F.struct(F.col("t") / F.col("n"), -F.col("label"))).alias("h"))
    ratio = F.exp(F.col("h.t") / F.col("h.n") - (F.col("t") - F.col("h.t")) / (F.col("n") - F.col("h.n")))
    return f.join(hot.where("labels > 1").select("key", ratio.alias("ratio")), "key", "left").select("key", "best", "posterior", "log_bf", "rho", "onset", "back", "ratio")


def null_series(series: DataFrame, rho: float, sd: float, step: int, replicates: int) -> DataFrame:
    """key (1, 2, ...), s, y: series without a change at the times of ``series`` (s, a row a bucket): autoregressive paths
    that start anew after a gap, one a replicate, made where Spark groups the replicate's times."""
    import pandas as pd

    def path(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        s, e = g["s"].to_numpy(), np.random.default_rng([7, int(g["key"].iloc[0])]).normal(size=len(g))
        y, near = np.empty(len(g)), np.append(False, np.diff(s) == step)
        for i, x in enumerate(e):
            y[i] = rho * y[i - 1] + math.sqrt(1 - rho * rho) * x if near[i] else x
        return pd.DataFrame({"key": g["key"].to_numpy(), "s": s, "y": sd * y})

    times = F.broadcast(series.select("s"))  # a row a bucket, some thousands
    ids = series.sparkSession.range(1, replicates + 1).select(F.col("id").cast("string").alias("key"))
    return ids.crossJoin(times).groupBy("key").applyInPandas(path, "key string, s long, y double")


def null_calibration(series: DataFrame, step: int, least: int, replicates: int) -> DataFrame:
    """key, best, log_bf, ratio of the series (key ``observed``) and of simulated ones without a change: the model picked
    and M2 against M0 at the same shortest segment, and the shift of M2, forced, with segments as long as the one
    observed, so that every replicate gives one."""
    own = small(series.withColumn("key", F.lit("observed")).select("key", "s", "y"))  # a row a bucket
    folded = folds(own, {"observed": settings(step, least)})
    f = fits(own, folded).first()
    p = segment_probabilities(folded.where(F.col("model") == f.best), own.groupBy("key").agg(F.count("*").alias("n")), (f.best,)) if f.best != "M0" else None
    d = own.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("s")).cast("long"))
    label = d.join(p, ["key", "i"]).withColumn("label", F.array_position("p", F.array_max("p"))) if p is not None else d.withColumn("label", F.lit(1))
    mean = label.groupBy("label").agg(F.avg("y").alias("_m"))
    sd = label.join(F.broadcast(mean), "label").agg(F.stddev_samp(F.col("y") - F.col("_m"))).first()[0]  # three rows
    length = max(least, f.back - f.onset) if f.back else least
    sim = stored(null_series(own, f.rho, sd, step, replicates), "null")
    each = {str(i): settings(step, least) for i in range(1, replicates + 1)}
    free = fits(sim, folds(sim, each)).select("key", "best", "log_bf")
    forced = fits(sim, folds(sim, {k: v | {"least": length} for k, v in each.items()}), "M2").select("key", "ratio")
    observed = own.sparkSession.createDataFrame([("observed", f.best, f.log_bf, f.ratio)], "key string, best string, log_bf double, ratio double")
    return observed.unionByName(free.join(forced, "key", "left"))


def null_summary(table: DataFrame) -> DataFrame:
    """One row: replicates, share that picks a change, share that picks M2, the 95 % quantiles of log_bf and ratio, the
    observed ones, and how many replicates those exceed. A row a replicate comes in."""
    null = table.where("key <> 'observed'")
    seen = table.where("key = 'observed'").select(F.col("log_bf").alias("seen_bf"), F.col("ratio").alias("seen_ratio"))
    d = null.crossJoin(F.broadcast(seen))  # one row
    return d.groupBy("seen_bf", "seen_ratio").agg(
        F.count("*").alias("replicates"), F.avg((F.col("best") != "M0").cast("int")).alias("any_change"), F.avg((F.col("best") == "M2").cast("int")).alias("excursion"),
        F.percentile("log_bf", F.lit(0.95)).alias("bf95"), F.median("ratio").alias("ratio50"), F.percentile("ratio", F.lit(0.95)).alias("ratio95"),
        F.avg((F.col("seen_bf") > F.col("log_bf")).cast("int")).alias("bf_exceeds"), F.avg((F.col("seen_ratio") > F.col("ratio")).cast("int")).alias("ratio_exceeds"),
    )
