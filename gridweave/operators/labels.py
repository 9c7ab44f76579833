"""Labels of a finer grid from the posterior of its buckets: filling, admission, joins that refuse, runs of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import ordered as O
from gridweave.operators import grid as G


def filled(posterior: DataFrame, panel: DataFrame, bucket: int) -> DataFrame:
    """b, p for every bucket from the first to the last of ``panel``: those without a posterior (s, p) take the one
    before, else the next. A row a bucket, so one window over all."""
    ends = panel.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select(F.explode(F.array("lo", "hi")).alias("s")).where("s is not null")
    every = G.grid(ends.select((F.floor(F.col("s") / bucket) * bucket).alias("s")), bucket)
    d = every.join(posterior, "s", "left")
    before = F.last("p", ignorenulls=True).over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(W.orderBy("s").rowsBetween(0, W.unboundedFollowing))
    return d.select(F.col("s").alias("b"), F.coalesce(before, after).alias("p"))


def labelled(panel: DataFrame, posterior: DataFrame, bucket: int) -> DataFrame:
    """s, regime (the likeliest label, the first of equals), p of every row of ``panel``."""
    d = panel.select("s", (F.floor(F.col("s") / bucket) * bucket).alias("b")).join(filled(posterior, panel, bucket), "b")
    return d.select("s", (F.array_position("p", F.array_max("p")) - 1).cast("byte").alias("regime"), F.transform("p", lambda x: x.cast("float")).alias("p"))


def with_labels(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """``panel`` with regime and p; an error if a row has none, or if a row's probabilities do not add up to 1."""
    d = panel.join(labels, "s", "left")
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    n, bad = d.agg(F.count_if(F.col("regime").isNull()), F.count_if(F.abs(total - 1) > 1e-3)).first()
    if n or bad:
        raise ValueError(f"{n} rows have no label and {bad} have probabilities that do not add up to 1")
    return d


def sure(least: float) -> Column:
    """The likeliest label has at least this probability."""
    return F.array_max("p") >= least


def relabelled(df: DataFrame, lo: int, hi: int, to: int | None = None) -> DataFrame:
    """``df`` with rows in [lo, hi) left out, or given the label ``to``."""
    inside = (F.col("s") >= lo) & (F.col("s") < hi)
    return df.where(~inside) if to is None else df.withColumn("regime", F.when(inside, F.lit(to)).otherwise(F.col("regime")).cast(df.schema["regime"].dataType))


def stretches(labels: DataFrame, chunk: int) -> DataFrame:
    """regime, first, last, rows, blocks: where each label stands, and in how many separate blocks."""
    d = O.with_previous(labels.select("s", "regime"), {"_was": "regime"}, chunk)
    new = F.coalesce(F.col("_was") != F.col("regime"), F.lit(True))
    return d.groupBy("regime").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("rows"), F.count_if(new).alias("blocks"))


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mode: the most frequent value, the smallest of equals."""
    return df.groupBy(key, value).count().groupBy(key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("mode"))
