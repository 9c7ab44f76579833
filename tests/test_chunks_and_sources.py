"""Lags by chunk, sweeps by running sums, audits, files paired in one scan, and the splice of two streams."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.functions.lagged import lag_correlations
from gridweave.operators import grid as G
from gridweave.operators import reconcile as X
from gridweave.operators import vecm as V
from gridweave.plans.model_queries import drained
from gridweave.sources import panels as P
from gridweave.streaming import ticks as ST

from tests.test_operators import frame, leading_panel


def test_lag_correlations_against_loops(spark):
    """Runs with gaps, missing values, chunks shorter than the series, lags of both signs, a side that does not vary."""
    rng = np.random.default_rng(3)
    s = np.sort(rng.choice(np.arange(0, 2000, 10), 150, replace=False))
    run = np.cumsum(np.append(True, np.diff(s) != 10))
    x, y = 1e4 + rng.normal(size=150), rng.normal(size=150)
    y[rng.integers(0, 150, 20)] = np.nan
    pdf = pd.DataFrame({"s": s, "run": run, "x": x, "y": y, "c": 5.0})
    d = frame(spark, pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    pairs, lags = [("x", "y"), ("y", "y"), ("c", "x")], [-7, -1, 0, 1, 3]
    got = {(r.pair, r.lag): (r.n, r["corr"]) for r in lag_correlations(d, pairs, lags, 10, 90, "run").collect()}
    place = {t: i for i, t in enumerate(s)}
    for p, (a, b) in enumerate(pairs):
        for lag in lags:
            both = [(pdf[a][i], pdf[b][j]) for i, t in enumerate(s) if (j := place.get(t - 10 * lag)) is not None and run[i] == run[j]]
            both = [q for q in both if not any(math.isnan(v) for v in q)]
            if not both:
                assert (p, lag) not in got
                continue
            n, c = got[p, lag]
            assert n == len(both)
            assert c is None if a == "c" or n < 2 else c == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)
    with pytest.raises(ValueError, match="longer"):
        lag_correlations(d, pairs, [100], 10, 90, "run")


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_sweep_against_loops(spark, chunk):
    rng = np.random.default_rng(1)
    cells = pd.DataFrame({"cell": np.sort(rng.choice(60, 35, replace=False)), "n": rng.integers(1, 9, 35)})
    data = [rng.normal(size=n) + rng.normal() for n in cells.n]
    cells["z"], cells["zz"] = [v.sum() for v in data], [(v * v).sum() for v in data]
    bounds = [(a, b) for a in range(-2, 64, 7) for b in range(0, 64, 9)]
    got = {(r.onset, r.back, r.inside): r for r in X.sweep(frame(spark, cells), spark.createDataFrame(bounds, "onset long, back long"), 4, chunk).collect()}
    seen = 0
    for a, b in bounds:
        sides = {f: [v for c, v in zip(cells.cell, data) if (a <= c < b) == f] for f in (True, False)}
        for f, vs in sides.items():
            if min(sum(map(len, x)) for x in sides.values()) < 4 or len(vs) < 2:
                assert (a, b, f) not in got
                continue
            seen += 1
            every, r = np.concatenate(vs), got[a, b, f]
            within = sum(((v - v.mean()) ** 2).sum() for v in vs) / len(every)
            assert (r.days, r.n) == (len(vs), len(every)) and r.within == pytest.approx(within) and r.within + r.between == pytest.approx(every.var())
    assert seen == len(got) > 40


def test_audit_of_tests_breaks_with_each_part(spark):
    rows = V.with_logs(frame(spark, leading_panel()), 60, 36_000).cache()
    make = lambda **k: V.design(rows, 2, 60, 36_000, F.col("z").isNotNull(), F.col("cell"), 0, with_runs=True, **k).cache()
    d, other = make(basis_lags=2), make()
    f = V.fit(other, 2)
    audit = lambda d=d, other=other, f=f: {name: ok for name, _, ok in V.audit_tests(d, other, f, 2, 5, 60, 36_000)}
    good = audit()
    assert len(good) == 4 and all(good.values())
    assert not audit(other=other.where("s % 7 <> 0"))["same rows"]
    assert not audit(other=other.withColumn("dx_a_1", F.col("dx_b_1")))["same rows"]
    assert not audit(other=other.withColumn("z1", F.col("z1") + 1))["same centring"]
    assert not audit(f=replace(f, lam=f.lam * 2))["closing shares"]
    # a run number that hides a gap changes which blocks are whole, and only one of the two ways sees it
    broken = d.where("s % 11 <> 0").withColumn("run", F.lit(1).cast("long"))
    assert not audit(d=broken)["robust covariance"]


def test_many_files_are_paired_in_one_scan(spark, tmp_path):
    """Twelve pairs, one of many blocks, names with spaces; the tie of equal times is (file, line)."""
    rng = np.random.default_rng(2)
    want = []
    for i in range(12):
        n = 4000 if i == 5 else int(rng.integers(0, 6))
        at = [f"2024-07-01T0{4 + k % 3}:00:00Z" for k in range(n)]
        for side, plus in (("bid", 0.0), ("ask", 0.5)):
            (tmp_path / f"{side} {i:02d}+.csv").write_text("time,Close\n" + "".join(f"{t},{i * 10_000 + k + plus}\n" for k, t in enumerate(at)))
        want += [(i, k, i * 10_000.0 + k, i * 10_000 + k + 0.5) for k in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        d = P.read_paired_ticks(spark, f"{tmp_path}/bid*.csv", f"{tmp_path}/ask*.csv").cache()
        assert sorted((r.file, r.line, r.bid, r.ask) for r in d.collect()) == want
        assert d.select("ts").distinct().count() == 3
        ticks = d.select(F.lit("a").alias("leg"), P.O.seconds("ts").alias("s"), "bid", "ask", F.struct("file", "line").alias("tie"))
        last = {r.s % 86_400 // 3600: r.bid for r in G.last_of_bucket(ticks, 3600, ["bid", "ask"]).collect()}
        times = {}
        for f, k, bid, _ in want:
            times[k % 3] = bid  # in the order of (file, line)
        assert last == times
        with open(tmp_path / "ask 05+.csv", "a") as out:
            out.write("2024-07-01T04:00:00Z,1.0\n")
        with pytest.raises(ValueError, match="differ in length"):
            P.read_paired_ticks(spark, f"{tmp_path}/bid*.csv", f"{tmp_path}/ask*.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert P.read_paired_ticks(spark, f"{tmp_path}/none*.csv", f"{tmp_path}/none*.csv") is None
    with pytest.raises(ValueError, match="12 bid files and 0 ask files"):
        P.read_paired_ticks(spark, f"{tmp_path}/bid*.csv", f"{tmp_path}/none*.csv")


def test_streamed_splice_equals_that_of_tables(spark, tmp_path):
    """A primary tick that comes late replaces a backup one; a late backup one changes nothing; half a row does not count."""
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    batches = {
        "p": [[("a", at(1), 1.0, 1.5), ("a", at(12), None, 2.0)], [("a", at(4), 3.0, 3.5), ("b", at(3), 9.0, 9.5), ("a", at(33), 5.0, 5.5)]],
        "q": [[("a", at(2), 7.0, 7.5), ("b", at(2), 8.0, 8.5), ("a", at(13), 4.0, 4.5), ("a", at(22), 6.0, 6.5)], [("b", at(8), 1.0, 1.0), ("a", at(23), 6.1, 6.6), ("a", at(9), 2.0, 2.0)]],
    }
    schema = "leg string, t timestamp, bid double, ask double"
    for side, parts in batches.items():
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, "leg string, t string, bid double, ask double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}/batch={i}")
    stream = lambda side: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}/*")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    got = drained(ST.spliced(stream("p"), stream("q"), "t", ["leg"], ["bid", "ask"], "10 seconds", "1 minute"), "complete").collect()
    table = lambda side: G.last_of_bucket(spark.read.parquet(f"{tmp_path}/{side}").dropna(subset=["bid", "ask"]).withColumns({"s": F.unix_timestamp("t"), "tie": F.lit(0)}), 10, ["bid", "ask"])
    want = G.spliced(table("p"), table("q"), ["bid", "ask"]).collect()
    assert sorted((r.leg, r.start.second, r.bid, r.ask, r.source) for r in got) == sorted((r.leg, r.s % 60, r.bid, r.ask, r.source) for r in want)
    assert len(got) == 5 and {r.source for r in got} == {"primary", "backup"}
