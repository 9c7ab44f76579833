"""Operator 1: best-fit decreasing packing of documents into windows of tokens.

``cut`` encodes whole documents, appends an end id and cuts overlong ones into full windows and a
rest. ``best_fit`` deals the pieces to shards, sorts each shard by falling length (in the JVM, so it
may spill) and streams it: a segment tree indexed by remaining capacity finds the tightest window
that is open. A task holds the open windows' fill levels only, never the pieces. Every shard leaves a
few windows part-filled, which is all the padding that sharding costs.

Defined results: a null or empty text is a document of the end id alone; a very long text is encoded alone and
cut into full windows and a rest; a null doc_id is carried like any other; repeated rows are packed as
often as they occur; an empty table gives no piece; columns beside those named are carried by
``best_fit`` and left out by ``cut``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.bpe import codec, slices, small_batches
from gridweave.llm.shared import partitions

SHARD_DOCS = 20_000  #: documents of a shard, as long as there are fewer shards than shuffle partitions
SHARD_MOST = 1_000_000  #: and beyond


def with_end(off: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows with ``end_id`` after each."""
    n = len(off) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[off[1:] + np.arange(n)] = False
    out[keep] = ids
    return off + np.arange(n + 1), out


def cut(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, with ``keep_ids``, ids array<int>: pieces of at most ``window`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches):
            off, ids = with_end(*c.encode(part.column("text")), end_id)
            size = np.diff(off)
            n = -(-size // window)
            doc = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, size[doc] - start)
            edge = np.append(off[doc] + start, off[-1])
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc])]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)])
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


class CapacityTree:
    """Open windows by remaining capacity; a node counts the open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest window with ``need`` left, None where there is none."""
        count, i = self.count, self.leaves + need
        while not count[i]:
            while i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def best_fit(pieces: DataFrame, shards: int, window: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, start, length and any more) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    lengths = [f.name for f in pieces.schema.fields].index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, name = CapacityTree(window), TaskContext.get().partitionId() << 40
        for batch in batches:
            sequence, offset = [], []
            for need in batch.column(lengths).to_pylist():
                if (found := tree.take(need)) is None:
                    found = window, name
                    name += 1
                capacity, one = found
                sequence.append(one)
                offset.append(window - capacity)
                if capacity > need:
                    tree.put(capacity - need, one)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    order = [F.col("length").desc(), *(F.col(c) for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns)]
    return pieces.repartition(shards, "doc_id", "start").sortWithinPartitions(*order).mapInArrow(run, schema)


def shards_for(docs: DataFrame) -> int:
    n = docs.count()
    return max(1, min(-(-n // SHARD_DOCS), max(partitions(docs.sparkSession), -(-n // SHARD_MOST))))


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, keep_ids: bool = True, shards: int | None = None) -> DataFrame:
    """The pieces of all documents with their places in the windows."""
    return best_fit(cut(docs, path, window, end_id, keep_ids), shards or shards_for(docs), window)
