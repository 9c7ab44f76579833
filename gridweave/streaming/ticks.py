"""Structured Streaming forms: last tick of a bucket, splice of two sources, sessions beyond a threshold, last known values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_of_window(ticks: DataFrame, time: str, keys: list[str], values: list[str], step: str, late: str) -> DataFrame:
    """Per key and window the values of the last tick; ticks more than ``late`` behind the latest are dropped."""
    w = ticks.withWatermark(time, late).groupBy(F.window(time, step).alias("w"), *keys)
    return w.agg(F.max_by(F.struct(*values), time).alias("v")).select(F.col("w.start").alias("start"), *keys, "v.*")


def spliced(primary: DataFrame, backup: DataFrame, time: str, keys: list[str], values: list[str], step: str, late: str, names: tuple[str, str] = ("primary", "backup")) -> DataFrame:
    """Per key and window the last whole row of the primary stream where there is one, else of the backup, with
    ``source``. The state of a window is one row, which a primary tick replaces until the watermark, ``late`` behind the
    latest tick of either stream, closes the window; a backup tick never replaces a primary one."""

    def one(d: DataFrame, rank: int) -> DataFrame:
        whole = d.select(time, *keys, *values).dropna(subset=values)
        return whole.select(time, *keys, F.struct(F.lit(rank).alias("rank"), F.col(time).alias("at"), *values, F.lit(names[0] if rank else names[1]).alias("source")).alias("v"))

    both = one(primary, 1).unionByName(one(backup, 0)).withWatermark(time, late)
    w = both.groupBy(F.window(time, step).alias("w"), *keys).agg(F.max_by("v", F.struct("v.rank", "v.at")).alias("v"))
    return w.select(F.col("w.start").alias("start"), *keys, *(f"v.{c}" for c in (*values, "source")))


def sessions(ticks: DataFrame, time: str, keys: list[str], beyond: Column, value: str, gap: str, late: str) -> DataFrame:
    """Per key spans of ticks beyond a threshold that are less than ``gap`` apart."""
    w = ticks.withWatermark(time, late).where(beyond).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return w.agg(F.count("*").alias("ticks"), F.max(F.abs(value)).alias("peak")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "ticks", "peak")


def last_known(ticks: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each tick of a key with the last value known, nulls filled from the state kept between batches.

    The state of a key is one number. Ticks of a batch are put in order of time; a tick older than those
    of earlier batches gets what is known by then."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time)
        filled = rows[value].ffill()
        rows[value] = filled if known is None else filled.fillna(known)
        if pd.notna(last := rows[value].iloc[-1]):
            state.update((float(last),))
        yield rows[[key, time, value]]

    kinds = dict(ticks.dtypes)
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {value} double"
    return ticks.select(key, time, value).groupBy(key).applyInPandasWithState(step, schema, "known double", "append", GroupStateTimeout.NoTimeout)
