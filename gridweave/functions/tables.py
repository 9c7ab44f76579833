"""Tables that later steps read instead of computing them again: written to the folder that all machines share, or, for
a few rows, held in the plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_MOST = 20_000  #: rows of a table that is held in the plan


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where ``spark.checkpoint.dir`` is; only where that is unset, on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, computed once and written as Parquet; its plan is then a scan."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, computed once: held in the plan if it has up to SMALL_MOST rows (a row a bucket, a key, a label), else
    written."""
    rows = df.limit(SMALL_MOST + 1).coalesce(1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= SMALL_MOST else stored(df)
