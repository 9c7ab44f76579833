"""Operator 5: token files: Parquet with a list column of ids, in ascending doc_id order.

Layout: a row per document (doc_id, part, before, n_tokens, ids). Ids are dictionary-encoded (or
delta-encoded, ``encoding="delta"``), row groups and pages have set sizes, and Parquet's column and
offset indexes let a reader fetch a range of doc_id, or the lengths alone, without the ids. ``part`` is
the number of the file in doc_id order and ``before`` the ids of earlier rows of the file, so that the
place of a document in the whole stream is ``before`` and a sum over earlier files.

Defined results: a null or empty text is the end id alone; a very long text is one row of all its ids; rows of equal doc_id are ordered by a hash
of the text; null doc_ids come first; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gridweave.llm.bpe import codec, slices, small_batches
from gridweave.llm.packing import with_end
from gridweave.llm.shared import checkpointed, partitions, text_or_empty

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
FILES_MOST = 100_000  #: files whose starts (two numbers each) are sent to all tasks; with more, they are joined


def encode_rows(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, part, before, n_tokens, ids for ``docs`` in the order of its partitions and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, before, part_no = codec(path), 0, TaskContext.get().partitionId()
        for part in slices(batches):
            off, ids = with_end(*c.encode(part.column("text")), end_id)
            n = len(off) - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(n, part_no, np.int64)), pa.array(before + off[:-1]), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))],
                schema.names,
            )
            before += int(off[-1])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("part", "before", "n_tokens")), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 1, encoding: str = "dictionary", files: int | None = None) -> None:
    """Writes the token files of ``docs`` into the folder ``out``."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(files or partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (
        encode_rows(ordered, path, end_id)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(out)
    )


def file_starts(rows: DataFrame) -> DataFrame:
    """part, base: the ids in earlier files; reads no ids. There is a row a file."""
    sizes = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("size"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids."""
    rows = spark.read.parquet(out)
    starts = checkpointed(file_starts(rows))
    return rows.join(F.broadcast(starts) if starts.count() <= FILES_MOST else starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """``rows`` with ids replaced by ids_crc32, of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            off = lists.offsets.to_numpy().tolist()
            view = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])
    return rows.select(*kept, "ids").mapInArrow(run, schema)
