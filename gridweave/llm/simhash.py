"""Operator 4: near-duplicates by SimHash and BK-trees.

Every document gets a 64-bit SimHash of its word shingles (XXH64, seed 42). Equal fingerprints are one
node. Two fingerprints within the radius r agree in at least m - r of m blocks of bits, so each is dealt
to shards by every choice of m - r blocks; m follows from the number of fingerprints, so that a shard
stays small whatever the size of the corpus, and no link is lost. A shard with more than SHARD_MOST
fingerprints is cut again by blocks of the bits that its members need not share: they shrink at each
cut, so this ends, and no task ever gathers an unbounded shard. In a task the shards' BK-trees (children
keyed by their Hamming distance to the parent) are built and searched side by side in numpy, following
only edges within the radius; a shard gives at most a link for each of its members. The components of
the links are found by rounds of star contraction on DataFrames, each checkpointed in the shared folder.
The trees of all shards are built where their shards are dealt to, not broadcast: they grow with the corpus.

``representatives`` keeps one row of each group of texts whose shingles are alike by Jaccard similarity. A bit of two
SimHashes differs with a chance of about 0.15 at a similarity of 0.8, so it takes 512 bits: tables deal the
fingerprints to shards by some bits each, BK-trees of a shard search within WIDE_RADIUS of 256 bits, and the texts of a
component of what is found are tested by their shingles.

Defined results: a null or empty text has fingerprint zero, linked like any other; a very long text is hashed
whole; a component's id is the smallest doc_id in it (nulls aside); repeated rows fall into one component; an
empty table gives no row; other columns are left out by ``near_duplicates`` and kept, whatever their names, by
``representatives``; there null doc_ids come last, and rows that share doc_id and text count as one row of which
any one stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.bpe import slices, small_batches
from gridweave.llm.shared import back, bitmap, checkpointed, hot_set, hot_slots, in_slots, partitions, renamed, seen_slots, spread_join

SHARD_AIM = 1_000  #: fingerprints that a shard would have if bits were even
SHARD_MOST = 5_000  #: above this it is cut again
SLAB_ROWS = 20_000  #: rows of whole shards handled at once
SLAB_EDGES = 1_000_000  #: edges that a task contracts at once

WIDE, COMPARED = 8, 4  #: longs of a wide fingerprint, and how many of them the trees compare
WIDE_RADIUS = 64  #: bits of 256; two texts alike to 0.8 differ in about 39, with a deviation of 6
BIT_DIFFERS = 0.16  #: at similarity 0.8, for sets of six shingles and more at most (0.19 for sets of four and five)
MISSED = 4e-4  #: share of pairs at similarity 0.8 that no table may bring together
SHARD_NODES = 64  #: fingerprints of a table's shard at most, if bits are even
VISITS = 1_000_000  #: pairs that a search visits at once at most
SAMPLE = 100  #: one node in so many is counted to find large shards
ALL_PAIRS = 16  #: nodes of a bucket whose pairs are all tested at once
LEADS_MOST = 2_000_000  #: shingles of leads (8 bytes each) that are sent to all tasks
LEAST_BLOCKS, BLOCK_LEAST = 8, 64  #: a bucket is cut in so many blocks where they keep so many nodes, so that many tasks share it
BLOCK_MOST, BLOCK_SHINGLES = 1_000, 250_000  #: nodes and shingles of a block, on average at most
COLUMNS = 1_024  #: shingles that are counted in one product of matrices
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, WIDE, np.uint64) | np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (of all words where there are fewer)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) > shingle:
        start, end = start[: len(words) - shingle + 1], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)


def simhash(text: bytes, shingle: int) -> int:
    """Fingerprint of a UTF-8 text; bit j is set if it is set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    h = shingle_hashes(words, shingle)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([simhash(t.as_buffer().to_pybytes(), shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


# -- trees ---------------------------------------------------------------------------------------
def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; a fingerprint is a long, or a row of longs."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))
    return bits.sum(axis=1, dtype=np.int64) if bits.ndim > 1 else bits.astype(np.int64)


class Forest:
    """BK-trees of many shards at once. ``root`` is the root of each item; items are distinct within a shard."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.most = most = 64 * (fp.shape[1] if fp.ndim > 1 else 1)
        self.root = np.zeros(n, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left, slot = np.arange(n), shard.astype(np.int64)
        at, step = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        top = True
        while len(left):
            _, first, which = np.unique(slot, return_index=True, return_inverse=True)
            node = left[first]
            parent[node], edge[node] = at[first], step[first]
            if top:
                self.root[left] = node[which]
                top = False
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], node[which[rest]]
            step = distance(fp[left], fp[at])
            slot = at * (most + 1) + step
        # children of a node, by their edge: a range of self.child
        has = np.flatnonzero(parent >= 0)
        key = parent[has] * (most + 1) + edge[has]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], has[order]

    def near(self, items: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of items of a shard within the radius, found from each of ``items``; level by level."""
        query, node = items, self.root[items]
        while len(query):
            d = distance(self.fp[query], self.fp[node])
            hit = (d <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.key, node * (self.most + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * (self.most + 1) + np.minimum(d + radius, self.most), side="right")
            many = hi - lo
            off = np.zeros(len(many) + 1, np.int64)
            np.cumsum(many, out=off[1:])
            spread = np.repeat(lo - off[:-1], many) + np.arange(off[-1])
            query, node = np.repeat(query, many), self.child[spread]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each item's is the smallest known of its component) after linking a and b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (jump := label[label])).any():
            label = jump


def shard_links(fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the shards' members within the radius connect: at most one an item."""
    forest, label = Forest(fp, shard), np.arange(len(fp))
    for i in range(0, len(fp), 2_048):
        for a, b in forest.near(np.arange(i, min(len(fp), i + 2_048)), radius):
            label = join_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


# -- shards --------------------------------------------------------------------------------------
def blocks(free: list[int], m: int) -> list[int]:
    """Masks of m blocks of the given bits, of even sizes."""
    edges = [round(i * len(free) / m) for i in range(m + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(n: int, radius: int) -> list[int]:
    """Bits that two fingerprints within the radius share for at least one of the masks."""
    for m in range(radius + 1, 2 * radius + 2):
        if n / 2 ** (64 * (m - radius) / m) <= SHARD_AIM:
            break
    return [sum(c) for c in combinations(blocks(list(range(64)), m), m - radius)]


def shards(nodes: DataFrame, radius: int) -> Iterator[DataFrame]:
    """DataFrames of (path, key, fp): shards of at most SHARD_MOST fingerprints, each pair within the radius in one at least."""
    masks = dict(enumerate(first_masks(nodes.count(), radius)))
    level = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for p, x in masks.items()))).alias("s")).select("s.path", "s.key", "fp")
    while True:
        sizes = level.groupBy("path", "key").count()
        large = checkpointed(sizes.where(F.col("count") > SHARD_MOST).select("path", "key"))
        if large.isEmpty():
            yield level
            return
        yield level.join(large, ["path", "key"], "left_anti")
        seen, children, parts = max(masks) + 1, {}, []
        for (path,) in large.select("path").distinct().collect():  # a few masks, however many shards
            shared = masks[path]
            own = []
            for block in blocks([b for b in range(64) if not shared >> b & 1], radius + 1):
                children[seen] = shared | block
                own.append(F.struct(F.lit(seen).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(shared | block))).alias("key")))
                seen += 1
            parts.append(F.when(F.col("path") == path, F.array(*own)))
        level = checkpointed(level.join(large, ["path", "key"], "left_semi").select("fp", F.explode(F.coalesce(*parts)).alias("s")).select("s.path", "s.key", "fp"))
        masks = children


def begins(path: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a shard begins, in rows sorted by path and key."""
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
    return new


def in_slabs(solve: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``solve`` over whole shards, about SLAB_ROWS rows at once, of batches sorted by their first columns, path and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= SLAB_ROWS:  # up to the last shard's start, which may go on
                cut = int(np.flatnonzero(begins(*held[:2]))[-1])
                if cut:
                    yield solve(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between fingerprints of ``nodes`` that give the components of all pairs within the radius."""

    def solve(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = shard_links(fp, np.cumsum(begins(path, key)), radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    run = in_slabs(solve)
    parts = [
        level.select(F.col("path").cast("long").alias("path"), "key", "fp").repartition(partitions(nodes.sparkSession), "path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "u long, v long")
        for level in shards(nodes, radius)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forests(edges: DataFrame) -> DataFrame:
    """(u, v): edges with the components of ``edges``: in every SLAB_EDGES of a task each node, and the smallest node that they
    join it to. So a node has at most one smaller neighbour a slab, and edges that many tasks found are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= SLAB_EDGES:
                yield solve(held)
                held, rows = [], 0
        if rows:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = join_labels(np.arange(len(ids)), at[: len(u)], at[len(u) :])
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the smallest node of its component, by star contraction.

    Edges are contracted inside tasks before each round. A round is of three shuffles and ends in one pass over a row
    a node: it tells whether all components are stars, so that no round is run to see that nothing changes."""
    edges = checkpointed(forests(edges.where("u <> v")))
    while True:
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        smaller = F.when(F.col("v") < F.col("u"), F.col("v"))
        nodes = checkpointed(ends.groupBy("u").agg(F.min(smaller).alias("low"), F.max(smaller).alias("high"), F.max("v").alias("top"), F.count("*").alias("n")))
        # a star's nodes have one smaller neighbour and no larger one, its root has no smaller one
        unlike = F.col("low").isNotNull() & ((F.col("low") < F.col("high")) | (F.col("top") > F.col("u")))
        left, hot = nodes.agg(F.max(unlike), hot_set(F.col("n"), "u")).first()
        if not left:
            return nodes.where("low is not null").select(F.col("u").alias("node"), F.col("low").alias("root"))
        # each node's larger neighbours go to its smallest neighbour
        least = nodes.select("u", F.coalesce("low", "u").alias("m"))
        large = spread_join(edges.select(F.col("v").alias("u"), F.col("u").alias("w")), least, ["u"], bitmap(hot) if hot else None)
        # then its smaller ones: each node has few, at most one for a smaller neighbour
        small = large.groupBy("w").agg(F.array_sort(F.collect_set("m")).alias("all"))
        first = F.get("all", F.lit(0))
        small = small.select(F.explode(F.transform("all", lambda x, i: F.struct(F.when(i == 0, F.col("w")).otherwise(x).alias("u"), first.alias("v")))).alias("e"))
        edges = checkpointed(forests(small.select("e.*")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    rows = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(nodes, ids.drop("n"), ["root"], hot_slots(ids, "root")).select("fp", "component_id")
    return spread_join(rows, named, ["fp"], hot_slots(rows.groupBy("fp").agg(F.count("*").alias("n")), "fp")).select("doc_id", "fp", "component_id")


# -- near copies by similarity ---------------------------------------------------------------------
def wide_simhash(h: np.ndarray) -> np.ndarray:
    """WIDE longs: bit j is set if it is set in over half of what the shingles' hashes ``h`` give for it."""
    bits = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 255):  # counts of a byte
        x = h[i : i + 255, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= FACTORS[::-1]
        x ^= x >> np.uint64(29)
        bits += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(h), bitorder="little").view("<i8")


def with_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, own (hash of the text), words (128-bit hash of its words), prints (the wide SimHash of its different shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digest, prints = [], []
            for t in pc.fill_null(part.column("text"), "").cast(pa.large_binary()):
                words = t.as_buffer().to_pybytes().lower().split()
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(wide_simhash(np.unique(shingle_hashes(words, shingle)) if words else np.zeros(0, np.uint64)))
            flat = pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * WIDE), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array(digest, pa.binary()), lists], schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("own", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("prints", T.ArrayType(T.LongType()))])
    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("own"))).mapInArrow(run, schema)


def tables(n: int) -> list[tuple[int, int]]:
    """(long, mask) of each table: with ``n`` fingerprints, so many bits that shards are small, and so many tables that
    all but MISSED of the pairs at similarity 0.8 agree in the bits of one at least."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / SHARD_NODES)))
    count = math.ceil(math.log(MISSED) / math.log1p(-((1 - BIT_DIFFERS) ** bits)))
    rng, left, out = np.random.default_rng(44), [[] for _ in range(WIDE)], []
    for t in range(count):
        own = left[t % WIDE]
        if len(own) < bits:  # each bit is taken once before any is taken again
            own[:] = rng.permutation(64).tolist()
        out.append((t % WIDE, sum(1 << own.pop() for _ in range(bits))))
    return out


def wide_links(path: np.ndarray, key: np.ndarray, node: np.ndarray, *longs: np.ndarray) -> pa.RecordBatch:
    """Links between nodes within WIDE_RADIUS of whole shards, sorted by path, key and longs: what connects all of them."""
    prints, new = np.stack(longs, axis=1), begins(path, key)
    again = ~new
    again[1:] &= (prints[1:] == prints[:-1]).all(axis=1)
    item, shard = np.flatnonzero(~again), np.cumsum(new)[~again]
    fp, label = prints[item], np.arange(len(item))
    # most of a large group is near its middle: those need no search of their own, since any other that is near them has one
    start = np.flatnonzero(begins(shard, shard))
    size = np.diff(np.append(start, len(item)))
    middle, size = np.repeat(start + size // 2, size), np.repeat(size, size)
    close = distance(fp, fp[middle]) <= WIDE_RADIUS
    label = join_labels(label, np.flatnonzero(close), middle[close])
    ask = np.flatnonzero(~close)
    if len(ask):
        forest, visits = Forest(fp, shard), np.cumsum(size[ask])
        at = 0
        while at < len(ask):
            to = max(at + 1, int(np.searchsorted(visits, (visits[at - 1] if at else 0) + VISITS, side="right")))
            for a, b in forest.near(ask[at:to], WIDE_RADIUS):
                label = join_labels(label, a, b)
            at = to
    linked, twice = np.flatnonzero(label != np.arange(len(item))), np.flatnonzero(again)
    u, v = np.concatenate([node[item[linked]], node[twice]]), np.concatenate([node[item[label[linked]]], node[twice - 1]])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def print_links(nodes: DataFrame) -> DataFrame:
    """(u, v): links between ``nodes`` (node, prints) that a table brings together and that lie within WIDE_RADIUS.

    A shard of over SHARD_MOST nodes by a sample of them is dealt to blocks, and every two blocks meet: the sample decides
    how large tasks get, not what is found."""
    by = tables(nodes.count())
    dealt = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("path"), F.get("prints", F.lit(w)).bitwiseAND(F.lit(signed(mask))).alias("key")) for t, (w, mask) in enumerate(by))))
    longs = [F.get("prints", F.lit(k)).alias(f"p{k}") for k in range(COMPARED)]
    spread = lambda d: d.select("node", *longs, dealt.alias("s")).select("s.path", "s.key", "node", *(f"p{k}" for k in range(COMPARED)))
    sample = spread(nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)).groupBy("path", "key").agg((F.count("*") * SAMPLE).alias("n"))
    large = checkpointed(sample.where(F.col("n") > SHARD_MOST).select("path", "key", "n", F.ceil(2 * F.col("n") / SHARD_MOST).cast("long").alias("blocks")))
    level = spread(nodes)
    if not large.isEmpty():
        level = spread_join(level, large.drop("n"), ["path", "key"], hot_slots(large, "path", "key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        level = level.withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.least("i", "j") * F.col("blocks") + F.greatest("i", "j")
        level = level.withColumn("path", F.col("path") + len(by) * pair).drop("i", "j", "blocks")
    order = ["path", "key", *(f"p{k}" for k in range(COMPARED))]
    return level.repartition(partitions(nodes.sparkSession), "path", "key").sortWithinPartitions(*order).mapInArrow(in_slabs(wide_links), "u long, v long")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, set: the different shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(w, shingle)).view(np.int64) if (w := t.as_buffer().to_pybytes().lower().split()) else [] for t in pc.fill_null(part.column("text"), "").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return small_batches(texts.select("node", "text")).mapInArrow(run, "node long, set array<long>")


def with_shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, shared, either of the pairs (u, v, lead; lead is one of the two): sizes of the intersection and the union of
    their sets. The sets of leads are sent to all tasks where they are few and small together, so that no pair is
    shuffled with a set."""
    pairs = pairs.withColumn("other", F.when(F.col("lead") == F.col("u"), F.col("v")).otherwise(F.col("u")))
    hot = lambda name, pairs=pairs: hot_slots(pairs.groupBy(name).agg(F.count("*").alias("n")), name)
    leads = checkpointed(sets.join(pairs.select(F.col("lead").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("lead"), F.col("set").alias("a")))
    pairs = spread_join(pairs, sets.select(F.col("node").alias("other"), F.col("set").alias("b")), ["other"], hot("other"))
    if (leads.agg(F.sum(F.size("a") + 2)).first()[0] or 0) <= LEADS_MOST:
        pairs = pairs.join(F.broadcast(leads), "lead")
    else:
        pairs = spread_join(pairs, leads, ["lead"], hot("lead"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.select("u", "v", shared.alias("shared"), (F.size("a") + F.size("b")).alias("sizes")).select("u", "v", "shared", (F.col("sizes") - F.col("shared")).alias("either"))


def coverage(sets: DataFrame) -> DataFrame:
    """node, len, cov: the size of each set, and how many of its members another set has too."""
    alone = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node", F.size("set").cast("long").alias("len")).join(own, "node", "left").select("node", "len", (F.col("len") - F.coalesce("alone", F.lit(0))).alias("cov"))


def possible(percent: int, cov: Column, one: Column, other: Column) -> Column:
    """Two sets of these sizes can be alike if ``cov`` members of one are all that the other can share with it."""
    return percent * (one + other) <= (100 + percent) * cov


def alike(percent: int) -> Column:
    """A Jaccard similarity of ``percent`` or more."""
    return 100 * F.col("shared") >= percent * F.col("either")


def block_links(rows: pa.Table, percent: int) -> pa.Table:
    """(u, v): each node of ``rows`` (node, side, set), and the node that stands for what links join it to, by links
    between side 0 and side 1 (within side 0 if there is no other). Shared shingles are counted as a product of
    matrices of zeros and ones."""
    node, side, sets = rows["node"].to_numpy(), rows["side"].to_numpy(), rows["set"].combine_chunks()
    flat, size = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n[at] > 1  # what one set alone holds is not shared
    column, owner = (np.cumsum(n > 1) - 1)[at[common]], np.repeat(np.arange(len(node)), size)[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(node), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        shared += held[left] @ held[right].T
    one, other = np.nonzero((100 + percent) * shared >= percent * (size[left][:, None] + size[right]))
    one, other, label = left[one], right[other], np.arange(len(node))
    while True:
        low, now = np.minimum(label[one], label[other]), label.copy()
        np.minimum.at(now, label[one], low)
        np.minimum.at(now, label[other], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    found = np.flatnonzero(label != np.arange(len(node)))
    return pa.table({"u": node[found], "v": node[label[found]]})


def open_links(large: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): what links between the nodes of the buckets of ``large`` (bucket, node, len) join, in buckets that
    ``linked`` leaves in several components. A bucket's nodes are dealt to blocks and every two blocks meet in a task,
    so that no task gets a bucket, and no pair is a row."""
    roots = components(linked).withColumnRenamed("root", "r")
    rooted = checkpointed(large.select("bucket", "node", "len").join(roots, "node", "left").withColumn("r", F.coalesce("r", "node")))
    counts = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("len").alias("shingles"), F.min("r").alias("low"), F.max("r").alias("high"))
    blocks = F.greatest(F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / BLOCK_LEAST)), F.ceil(F.col("n") / BLOCK_MOST), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    counts = checkpointed(counts.where("low <> high").select("bucket", "n", blocks.cast("int").alias("blocks")))
    dealt = spread_join(rooted.select("bucket", "node"), counts.drop("n"), ["bucket"], hot_slots(counts, "bucket"))
    dealt = dealt.join(sets, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("bucket", "node", "set", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    met = met.select("bucket", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "node", (F.col("i") > F.col("j")).cast("int").alias("side"), "set")
    return met.groupBy("bucket", "a", "b").applyInArrow(lambda rows: block_links(rows, percent), "u long, v long")


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): connects all ``nodes`` (node, doc_id, own, bands: its buckets) that links between nodes that share a bucket
    connect, and no others.

    A node leaves a bucket if what it shares with any other node at all is too little to be alike even the shortest of
    the bucket: texts with passages of their own around a common one go without a test. All pairs of what is left of a
    bucket of up to ALL_PAIRS nodes are tested. In a larger one every node is tested against two leads; in those that
    this leaves in several components every two nodes are tested, in blocks of a bounded size inside tasks."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    hot = hot_slots(shared, "bucket")
    members = checkpointed(spread_join(buckets.where(in_slots(seen_slots(shared, "bucket"), "bucket")), shared.select("bucket"), ["bucket"], hot))
    chosen = nodes.select("node", F.col("doc_id").alias("doc"), "own").join(members.select("node").distinct(), "node")
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("_own")).where(in_slots(seen_slots(chosen, "own"), "_own"))
    wanted = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["doc"]) & (keyed["_own"] == chosen["own"])).select("node", "text").dropDuplicates(["node"])
    sets = checkpointed(shingle_sets(wanted, shingle))
    members = checkpointed(members.join(coverage(sets), "node"))
    shortest = members.groupBy("bucket").agg(F.min("len").alias("short"), F.count("*").alias("n"))
    members = spread_join(members, shortest, ["bucket"], hot).where(possible(percent, F.col("cov"), F.col("len"), F.col("short"))).select("bucket", "node", "len", "cov")
    members = checkpointed(members)
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("node"))
    sizes = checkpointed(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order)["node"].alias("low"), F.max(order)["node"].alias("high")).where("n > 1"))
    sized = spread_join(members, sizes, ["bucket"], hot)
    small = sized.where(F.col("n") <= ALL_PAIRS).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "len", "cov"))).alias("all"))
    fits = lambda u, v: possible(percent, F.least(u["cov"], v["cov"]), u["len"], v["len"])
    tails = F.flatten(F.transform("all", lambda u, i: F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda v: fits(u, v)), lambda v: F.struct(u["node"].alias("u"), v["node"].alias("v"), u["node"].alias("lead")))))
    large = checkpointed(sized.where(F.col("n") > ALL_PAIRS).select("bucket", "node", "len", "low", "high"))
    # the leads are the ends of an order that all buckets share: few different pairs, and no join
    led = large.select("node", F.explode(F.array("low", "high")).alias("lead")).where("node <> lead")
    led = led.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"), "lead")
    pairs = checkpointed(small.select(F.explode(tails).alias("p")).select("p.*").unionByName(led).groupBy("u", "v").agg(F.min("lead").alias("lead")))
    found = checkpointed(with_shared(pairs, sets).where(alike(percent)).select("u", "v"))
    return found if large.isEmpty() else found.unionByName(open_links(large, found, sets, percent))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component of near copies: of the smallest doc_id (nulls last), then hash of the text.

    Near copies share ``percent`` or more of their different shingles. Candidates are the components of wide SimHashes
    that are near each other."""
    rows = checkpointed(with_prints(docs, shingle))
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "own"))
    nodes = checkpointed(rows.groupBy("words").agg(best.alias("best"), F.first("prints").alias("prints")).select(F.monotonically_increasing_id().alias("node"), "best", "prints"))
    near = components(print_links(nodes.select("node", "prints")))
    flat = checkpointed(nodes.join(near, "node", "left").select("node", "best.doc_id", "best.own", F.array(F.coalesce("root", "node")).alias("bands")))
    roots = components(similar_links(flat, docs, shingle, percent))
    named = nodes.select("node", "best").join(roots, "node", "left")
    won = checkpointed(named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("doc"), "best.own"))
    d, own = renamed(docs)
    d = d.withColumn("this", F.xxhash64(own["text"]))
    out = d.join(won, d[own["doc_id"]].eqNullSafe(won["doc"]) & (d["this"] == won["own"]), "left_semi")
    # only where rows of one doc_id and text are there twice do the rows kept need another look
    if not rows.groupBy("doc_id", "own").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([own["doc_id"], "this"])
    return out.select(*back(own))
