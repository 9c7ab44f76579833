"""Quotes, panels and series from tables and raw files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions import ordered as O
from gridweave.functions.tables import stored

DAY, TEN_MINUTES, HOUR = 86_400, 600, 3_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- raw files -------------------------------------------------------------------------------------
TICKS = T.StructType([T.StructField(n, t) for n, t in (("stamp", T.StringType()), ("bid", T.DoubleType()), ("ask", T.DoubleType()), ("volume", T.DoubleType()))])


def read_ticks(spark: SparkSession, pattern: str) -> DataFrame:
    """Headerless tick files (``YYYYMMDD HHMMSSmmm``, bid, ask, volume) as ts, bid, ask; a pattern without files is an error."""
    raw = spark.read.schema(TICKS).csv(pattern, header=False)
    return raw.select(F.to_timestamp_ntz("stamp", F.lit("yyyyMMdd HHmmssSSS")).alias("ts"), "bid", "ask")


def numbered(frame: DataFrame) -> DataFrame:
    """``frame``, a scan of files, with ``path`` and ``line``, the row's number in its file.

    Rows of a block of a file are in order in one partition: the number inside the block, and the rows of earlier blocks
    of the file, give the place. One scan numbers the rows of all files."""
    at = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "[+]", "%2B")), "^([a-z0-9]+):/+", "$1:/")
    d = frame.select("*", at.alias("path"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_in", F.monotonically_increasing_id())
    blocks = d.groupBy("path", "_block").agg(F.count("*").alias("n"), F.min("_in").alias("_first"))
    earlier = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    starts = blocks.select("path", "_block", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return d.join(starts, ["path", "_block"]).withColumn("line", F.col("_in") - F.col("_first") + F.col("_before")).drop("_block", "_in", "_first", "_before")


def read_sided_ticks(spark: SparkSession, bid_path: str, ask_path: str, hours: int = 4) -> DataFrame:
    """Two files of one side each (ISO-8601 UTC time, ..., Close), aligned by row, on a clock ``hours`` behind UTC.

    ``line`` is the row's number in the file; files of unequal length are an error."""
    return read_paired_ticks(spark, bid_path, ask_path, hours).drop("file")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, in order, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found) if found else []


def read_paired_ticks(spark: SparkSession, bid_pattern: str, ask_pattern: str, hours: int = 4) -> DataFrame | None:
    """All files of two patterns, paired in the order of their names, with ``file``; None where there are none, an error
    where there are more of one side. The last row in the order of (file, line) is the latest of equal times."""
    bids, asks = listed(spark, bid_pattern), listed(spark, ask_pattern)
    if len(bids) != len(asks):
        raise ValueError(f"{len(bids)} bid files and {len(asks)} ask files")
    if not bids:
        return None

    def side(files: list[str], name: str) -> DataFrame:
        frame = spark.read.csv(files, header=True)
        places = spark.createDataFrame([(re.sub("^([a-z0-9]+):/+", r"\1:/", p), i) for i, p in enumerate(files)], "path string, file int")  # a row a file
        rows = numbered(frame.select(F.col(f"`{frame.columns[0]}`").alias("at"), F.col("Close").cast("double").alias(name), "_metadata"))
        return rows.drop("_metadata").join(F.broadcast(places), "path").drop("path")

    both = side(bids, "bid").withColumn("_b", F.lit(True)).join(side(asks, "ask").drop("at").withColumn("_a", F.lit(True)), ["file", "line"], "full")
    both = stored(both, "paired")
    uneven = both.where("_a is null or _b is null").groupBy("file").agg(F.count("_b").alias("b"), F.count("_a").alias("a")).orderBy("file").limit(1).collect()
    if uneven:
        r = uneven[0]
        raise ValueError(f"bid and ask files differ in length: {bids[r.file]} has {r.b} rows and {asks[r.file]} {r.a} that the other lacks")
    ts = F.to_timestamp_ntz(F.regexp_replace("at", r"Z$|\+00:00$", "")) - F.expr(f"INTERVAL '{hours}' HOUR")
    return both.select(ts.alias("ts"), "bid", "ask", "line", "file")


def require(spark: SparkSession, path: str, stage: str) -> str:
    """The path, or an error that names the stage that writes it; for any store that Spark reads."""
    if not listed(spark, path):
        raise FileNotFoundError(f"{path} is missing; run {stage} first")
    return path


# -- stages' tables --------------------------------------------------------------------------------
def write_grid(panel: DataFrame, path: str, span: int = DAY) -> None:
    """Writes a panel as Parquet (Snappy), a folder for each ``span`` of time, ordered by time inside."""
    part = F.floor(F.col("s") / span).alias("part")
    panel.select("*", part).repartition("part").sortWithinPartitions("s").write.mode("overwrite").partitionBy("part").option("compression", "snappy").parquet(path)


def read_grid(spark: SparkSession, path: str, columns: list[str] | None = None, older: str | None = None, name: str | None = None) -> DataFrame:
    """A stored panel, or the one at ``older`` where that is missing: the columns asked for and always ``s``, ordered by
    time within partitions; ``name`` registers it as a view for SQL. Missing columns are an error that names them."""
    at = path if listed(spark, path) or older is None else older
    d = spark.read.parquet(require(spark, at, "the grid stage"))
    if columns is not None:
        if lost := [c for c in columns if c not in d.columns]:
            raise KeyError(f"{at} has no {', '.join(lost)}")
        d = d.select("s", *(c for c in columns if c != "s"))
    d = d.sortWithinPartitions("s")
    if name:
        d.createOrReplaceTempView(name)
    return d


# -- adapters of the tables ------------------------------------------------------------------------
ROW = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
ROLES = {"A": "a", "R": "b", "N": "c"}


def lineitem_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, s, bid, ask and ``tie``, the whole row: quotes of three legs."""
    m = F.col("l_extendedprice") / F.col("l_quantity") / 1500
    d = table(spark, sf_dir, "lineitem").withColumns({"bid": m * (1 - F.col("l_discount")), "ask": m * (1 + F.col("l_tax"))})
    role = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "b").when(F.col("l_returnflag") == "N", "c")
    return d.select(role.alias("leg"), O.seconds("l_shipdate").alias("s"), "bid", "ask", F.struct(*ROW).alias("tie"))


EVENT_ROLES = {"click": "a", "view": "b", "purchase": "c"}


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, s, mid, tie and event_id of the three event types that are legs."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*EVENT_ROLES))
    leg = F.create_map(*(F.lit(x) for p in EVENT_ROLES.items() for x in p))[F.col("event_type")]
    return e.select(leg.alias("leg"), O.seconds("ts").alias("s"), F.col("value").alias("mid"), F.struct("ts", "event_id").alias("tie"), "event_id")


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s (days), y: ln of the day's turnover in millions."""
    o = table(spark, sf_dir, "orders").groupBy(F.floor(O.seconds("o_orderdate") / DAY).alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return o.select((F.col("d") * DAY).alias("s"), F.ln(F.col("v") / 1e6).alias("y"))


def mid_of(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2
