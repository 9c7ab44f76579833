"""Operator 7 [native]: deduplication of content-defined chunks of lines.

Every line is hashed, and a rolling hash runs over each WINDOW adjacent line hashes. Chunk boundaries are where
the rolling hashes change between those that stood somewhere before (in order of doc_id, hash of the text, place)
and those that did not: so a passage that documents share is one chunk in all of them, whole, wherever it stands
and however short. A line of LONG_WORDS words is a window by itself. A window counts as repeated only after the
SHA-256 of its bytes has been compared (the smallest and the largest digest of a hash are the same); where they
differ windows are grouped by their digest. A chunk (adjacent lines that lie in windows which stood before) of ``min_chars``
characters or more is removed. The first occurrence of a line is in no such window, so no line is lost.

Counts are combined before the shuffle, so that a window that a third of all documents hold costs a row a task;
windows whose hash may be repeated (a bitmap, which is full on large tables and then lets all through) give a digest of
32 bytes, never their text, so that what is shuffled grows with the number of windows; the join that marks occurrences
deals the rows of a hot window to many tasks. Texts are shuffled once, to meet the places found.

Defined results: a null text stays null; a text without removed chunks stays as it is; a text of removed
chunks alone becomes empty; rows of equal doc_id and text share their fate, as one occurrence, null doc_ids
coming first; a very long text is handled in time in proportion to its lines; an empty table gives no row;
extra columns are kept whatever their names, one named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import WORD_SPACE, Slots, back, checkpointed, hot_slots, in_slots, renamed, seen_slots, spread_join

WINDOW = 2  #: line hashes in the rolling hash
BASE = 31
LONG_WORDS = 50  #: words of a line that is a window alone
MIN_CHARS = 80  #: characters of a chunk that is removed
KEY = ("doc", "own")
WORD = rf"[^{WORD_SPACE}]+"


def line_hash(line: Column) -> Column:
    """56 bits, so that a rolling hash does not overflow."""
    return F.shiftrightunsigned(F.xxhash64(line), 8)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("own"), F.col("text").alias("text"))


def is_long(line: Column) -> Column:
    return (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(WORD)) >= LONG_WORDS)


def windows(docs: DataFrame, keep: Slots | None = None) -> DataFrame:
    """doc, own (hash of the text), place (of the first line), size (lines), hash of all windows; with ``keep`` of those
    whose hash may be in it, and the digest of their bytes. Windows are made inside their document's array, so none carries its lines."""
    lines = keyed(docs.where("text is not null")).select(*KEY, F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    hashed = lines.select(*KEY, "lines", F.explode(F.array(F.transform("lines", line_hash))).alias("h"))
    rolled = F.transform("h", lambda x, i: F.struct(i.alias("place"), F.lit(WINDOW).alias("size"), (BASE * x + F.get("h", i + 1)).alias("hash")))
    single = F.filter(F.transform("lines", lambda x, i: F.when(is_long(x), F.struct(i.alias("place"), F.lit(1).alias("size"), F.get("h", i).alias("hash")))), lambda w: w.isNotNull())
    every = F.concat(F.filter(rolled, lambda w: w["hash"].isNotNull()), single)
    if keep is None:
        return hashed.select(*KEY, F.explode(every).alias("w")).select(*KEY, "w.place", "w.size", "w.hash")
    maybe = hashed.select(*KEY, "lines", F.explode(F.array(F.filter(every, lambda w: in_slots(keep, w["size"], w["hash"])))).alias("ws"))
    text = lambda w: F.when(w["size"] == 1, F.get("lines", w["place"])).otherwise(F.concat_ws("\n", F.get("lines", w["place"]), F.get("lines", w["place"] + 1)))
    each = maybe.select(*KEY, F.explode(F.transform("ws", lambda w: F.struct(w["place"].alias("place"), w["size"].alias("size"), w["hash"].alias("hash"), F.unhex(F.sha2(text(w), 256)).alias("digest")))).alias("w"))
    return each.select(*KEY, "w.place", "w.size", "w.hash", "w.digest")


def later(first: str = "first") -> Column:
    return ~(F.col("doc").eqNullSafe(F.col(first)["doc"]) & (F.col("own") == F.col(first)["own"]) & (F.col("place") == F.col(first)["place"]))


def removals(docs: DataFrame) -> DataFrame:
    """doc, own, gone: windows (place, size) that stood before; one row a document that has some."""
    first = F.min(F.struct(*KEY, "place")).alias("first")
    repeated = checkpointed(windows(docs).groupBy("size", "hash").agg(F.count("*").alias("n"), first).where("n > 1"))
    maybe = windows(docs, seen_slots(repeated, "size", "hash"))
    bytes_of = maybe.groupBy("size", "hash").agg((F.min("digest") == F.max("digest")).alias("same"))
    mixed = checkpointed(bytes_of.where("not same").select("size", "hash"))
    marked = spread_join(maybe.drop("digest"), repeated.join(mixed, ["size", "hash"], "left_anti"), ["size", "hash"], hot_slots(repeated, "size", "hash")).where(later()).select(*KEY, "place", "size")
    # hashes that different texts share, if there are any: by the digests
    if not mixed.isEmpty():
        shared = maybe.join(mixed, ["size", "hash"], "left_semi")
        by_bytes = shared.groupBy("size", "digest").agg(F.count("*").alias("n"), first).where("n > 1")
        marked = marked.unionByName(shared.join(by_bytes, ["size", "digest"]).where(later()).select(*KEY, "place", "size"))
    # repeated rows give equal marks
    return marked.groupBy(*KEY).agg(F.collect_set(F.struct("place", "size")).alias("gone"))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text that stays, and removed_chunks."""
    docs = docs.drop("removed_chunks")
    gone = removals(docs)
    d, own = renamed(docs)
    d = d.withColumn("this", F.xxhash64(own["text"]))
    both = d.join(gone, d[own["doc_id"]].eqNullSafe(gone["doc"]) & (d["this"] == gone["own"]), "left").select(*own.values(), "gone")
    rest = [*own.values()]
    once = lambda d, keep, name, value: d.select(*keep, F.explode(F.array(value)).alias(name))  # noqa: E731  evaluated once, not at each use
    d = once(both, [*rest, "gone"], "lines", F.when(F.col("gone").isNotNull(), F.split(own["text"], "\n", -1)))
    # runs of adjacent lines of windows: chunks
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda w: F.sequence(w["place"], w["place"] + w["size"] - 1)))))
    d = once(d, [*rest, "lines"], "at", covered)
    begins = F.filter("at", lambda x, k: (k == 0) | (F.get("at", k - 1) < x - 1))
    ends = F.filter("at", lambda x, k: (k == F.size("at") - 1) | (F.get("at", k + 1) > x + 1))
    # by single lines: a slice of an array reads all of it
    chars = lambda a, b: F.aggregate(F.sequence(a, b), F.lit(-1), lambda n, k: n + F.length(F.get("lines", k)) + 1)
    d = once(d, [*rest, "lines"], "runs", F.arrays_zip(begins.alias("a"), ends.alias("b")))
    d = once(d, [*rest, "lines"], "chunks", F.filter("runs", lambda c: chars(c["a"], c["b"]) >= min_chars))
    # what lies between the chunks
    upto = lambda k: F.coalesce(F.get("chunks", k)["a"], F.size("lines")) - 1
    ranges = F.concat(F.array(F.struct(F.lit(0).alias("a"), upto(F.lit(0)).alias("b"))), F.transform("chunks", lambda c, k: F.struct((c["b"] + 1).alias("a"), upto(k + 1).alias("b"))))
    places = F.flatten(F.transform(F.filter(ranges, lambda r: r["b"] >= r["a"]), lambda r: F.sequence(r["a"], r["b"])))
    left = F.array_join(F.transform(places, lambda k: F.get("lines", k)), "\n")
    text = F.when(F.coalesce(F.size("chunks"), F.lit(0)) > 0, left).otherwise(F.col(own["text"]))
    return d.select(*back(own, text=text), F.greatest(F.lit(0), F.coalesce(F.size("chunks"), F.lit(0))).cast("long").alias("removed_chunks"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, 2 AS size, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM l
      UNION ALL SELECT doc_id, i, 1, line FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG_WORDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY size, t ORDER BY doc_id, i) > 1 AS before FROM w WHERE t IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + unnest(range(size)) AS i FROM r WHERE before),
c AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM g),
s AS (SELECT c.doc_id, c.i, c.chunk, sum(length(line)) OVER v + count(*) OVER v - 1 AS chars FROM c JOIN l USING (doc_id, i) WINDOW v AS (PARTITION BY c.doc_id, c.chunk)),
k AS (SELECT doc_id, i, chunk FROM s WHERE chars >= {MIN_CHARS}),
n AS (SELECT doc_id, count(DISTINCT chunk) AS removed_chunks FROM k GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN k USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(removed_chunks, 0) AS removed_chunks
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
