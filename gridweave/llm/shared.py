"""Small helpers of this subpackage: tables, the folder that all machines share, null texts, joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that words are cut at.
WORD_SPACE = r"\x20\x09-\x0D"
SLOTS = 1 << 18  #: bits of the bitmaps that keys are tested against before a shuffle
HOT_SLOTS = 1 << 12  #: bits of the bitmaps of hot keys
HOT_ROWS = 1_000  #: rows of a key from which a join deals them to SALTS places
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns _0, _1, ... and what each was called, so that no name of theirs meets one made here."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def back(own: dict[str, str], **new: Column) -> list[Column]:
    """The columns of ``renamed`` under their own names, some replaced."""
    return [new.get(c, F.col(x)).alias(c) for c, x in own.items()]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset, on one machine (a test), a new temporary one."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


Slots = list[int]  #: a bitmap, as whole numbers of 32 bits


def slot(keys: tuple[str | Column, ...], size: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def seen_slots(keys: DataFrame, *names: str, size: int = SLOTS) -> Slots:
    """A bitmap of where the keys of ``keys`` fall: what comes to the driver is at most a number for 32 of its bits."""
    parts = keys.select(slot(names, size).alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s % 32))").alias("bits"))
    out = [0] * (size // 32)
    for w, bits in parts.collect():
        out[w] = bits
    return out


def in_slots(slots: Slots, *names: str | Column) -> Column:
    """True for every key that went into ``slots``, and for few others."""
    at = slot(names, 32 * len(slots))
    word = F.get(F.expr(f"array({','.join(f'{x}L' for x in slots)})"), F.floor(at / 32).cast("int"))
    return F.expr("1L") == F.getbit(word, at % 32).cast("long")


def hot_set(n: Column, *keys: str) -> Column:
    """Aggregate over a row a key: where the keys fall whose ``n`` is HOT_ROWS or more, at most HOT_SLOTS whole numbers."""
    return F.collect_set(F.when(n >= HOT_ROWS, slot(keys, HOT_SLOTS)))


def bitmap(places: list[int], size: int = HOT_SLOTS) -> Slots:
    out = [0] * (size // 32)
    for s in places:
        out[s // 32] |= 1 << s % 32
    return out


def hot_slots(counts: DataFrame, *keys: str) -> Slots | None:
    """Where the keys fall that have HOT_ROWS rows and more by ``counts`` (keys, n); None if there is none."""
    places = counts.agg(hot_set(F.col("n"), *keys)).first()[0]
    return bitmap(places) if places else None


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: Slots | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, a table of few rows a key; ``hot``: of the keys that very many of ``rows`` have.

    Rows of hot keys are dealt to SALTS places, and those keys' rows of ``one`` to each of them, so that no task gets
    all rows of a key."""
    if hot is None:
        return rows.join(one, keys, how)
    salted = rows.withColumn("_salt", F.when(in_slots(hot, *keys), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    dealt = one.withColumn("_salt", F.explode(F.when(in_slots(hot, *keys), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [*keys, "_salt"], how).drop("_salt")
