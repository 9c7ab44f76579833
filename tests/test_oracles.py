"""Every query of the library against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

from gridweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


#: The rest is compared by the driver at a larger size; these cover each module in little time.
QUICK = (
    "grid_locf", "grid_locf_basis_mad", "splice_priority", "repaired_buckets", "tick_audit", "quote_spread_union", "coverage_by_day", "implied_gap_quantiles", "isolated_outage", "closure_runs", "moments",
    "acf1_roll", "survival_curve", "variance_decomposition", "usable_rows", "nearest_asof", "round_trip_edge", "haircut_ladder", "bucket_features", "changepoint_onset", "regime_summary", "holm", "placebo_shift", "boundary_sweep", "quality_gate",
    "second_labels", "bound_variants", "lead_lag_matrix", "hac_slopes", "residual_acf_slopes", "block_sums", "named_boundaries", "latency_ladder", "report_stamps",
)


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()), key=str)
    assert got == want
    spark.catalog.clearCache()


@pytest.mark.parametrize("zeros", ["rare", "both legs", "most"])
def test_gate_of_prices_that_are_zero(spark, tmp_path, zeros):
    """Gaps are then infinite or NaN (0 / 0), which count as SQL counts them."""
    value = {
        "rare": "CASE WHEN k = 'view' AND i IN (400, 401) THEN 0 ELSE 1 + i % 7 END",
        "both legs": "CASE WHEN i % 50 = 0 OR k = 'purchase' AND i % 100 = 51 THEN 0 WHEN i % 70 = 3 AND k = 'view' THEN '-0.0'::DOUBLE ELSE 1 + i % 7 END",
        "most": "CASE WHEN k = 'purchase' THEN -2 WHEN i < 300 THEN 0 ELSE 3 + i % 5 END",
    }[zeros]
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_seconds(600 * i + 5) AS ts, 1::BIGINT AS user_id, k AS event_type, ({value})::DOUBLE AS value, '{{}}' AS props
        FROM range(900) r(i), (VALUES ('click'), ('view'), ('purchase')) t(k)) TO '{tmp_path}/events.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(registry.ORACLES["quality_gate"]).fetchall()
    assert any(isinstance(r[1], float) and not math.isfinite(r[1]) for r in want) == (zeros != "rare")
    got = registry.QUERIES["quality_gate"](spark, str(tmp_path)).collect()
    assert sorted([plain(v) for v in r] for r in got) == sorted([plain(v) for v in r] for r in want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(registry.ORACLES) >= 40
