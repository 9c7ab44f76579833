"""Operator 11: collocations, counted in sorted streams.

1. Words are counted. A word has a 64-bit id, the hash of its language and bytes; that no two words share an id is
   tested over all words, with another seed if two do, so ids are as good as the words. Up to KNOWN_MOST frequent words
   are sent to all tasks, as places in order of their counts; with more, windows are of ids, and a bitmap of bounded
   size tells most rare words.
2. Each place of a text gives the window of up to five words that begins there. Tasks sort and count their windows and
   deal them, packed, to ranges of the order of windows; the bounds of the ranges come from a sample and decide only how
   even the ranges are. A range merges its parts into one stream in prefix order, where all occurrences of a phrase
   of two to five words stand together: its count is the sum over that stretch, without a table of phrases. Only
   phrases that touch an end of a range (at most eight a range) need to be summed over ranges. Words that are too rare
   end windows early.
3. The frequent phrases are two streams: by first words for left counts, by last words for right counts; each is
   merge-joined with the counts of those parts, and the longest parts give the extension counts.

Defined results: null texts have no words; a null language is ``und``; a very long text is taken whole; repeated rows and
doc_ids count each; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.llm.bpe import slices, small_batches
from gridweave.llm.shared import SALTS, hot_slots, spread_join, stored

MOST_WORDS = 5  #: words of a phrase
#: How single bytes are read: A-Z as a-z, piece ends as a line end, tab as a space.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
CHUNK_TOKENS = 1 << 21  #: words that a task sorts at a time
BLOCK_BYTES = 4 << 20  #: bytes of a text that are cut into words at a time
DISTINCT_MOST = 1 << 20  #: different words that a task holds at a time
KNOWN_MOST = 1 << 20  #: frequent words that are sent to all tasks (8 bytes each)
RANGE_TOKENS = 1 << 21  #: words for which there is a range
SAMPLED, SAMPLES = 0.02, 40  #: share of documents that the bounds of ranges are sampled from, and windows a range
BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27  #: bits of the bitmap of frequent words


def texts_by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language of a batch, as one text with line ends between."""
    groups: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()), strict=True):
        if text.is_valid:
            groups["und" if lang is None else lang].append(text.as_buffer().to_pybytes())
    for lang, texts in groups.items():
        yield lang, b"\n".join(texts).translate(TABLE)


def word_id(lang: str, seed: int):
    """A function from a word's bytes to its id."""
    front = f"{seed}\0{lang}\0".encode()
    return lambda word: xxhash.xxh64_intdigest(front + word, 42)


def id_of(lang: str, word: str, seed: int) -> Column:
    """``word_id`` of columns, as a signed number."""
    return F.xxhash64(F.concat(F.lit(f"{seed}\0"), F.col(lang), F.lit("\0"), F.col(word)))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for part in slices(batches):
            for lang, text in texts_by_lang(part):
                held[lang].update(text.split())
            if sum(map(len, held.values())) > DISTINCT_MOST:
                yield from given()
        yield from given()

    parts = small_batches(docs.select("lang", "text")).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def checked_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, n, id of all words, and the first seed that gives them different ids."""
    counts = stored(word_counts(docs), "words")
    for seed in range(100):
        words = counts.withColumn("id", id_of("lang", "word", seed))
        if words.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id = 0").isEmpty():
            return words, seed
    raise ValueError("no seed gives all words different ids")


class Frequent:
    """What tasks know of the frequent words: their ids in order of counts, or, beyond KNOWN_MOST, a bitmap of ids."""

    def __init__(self, words: DataFrame):
        """``words``: id, n."""
        self.ids, self.bits, n = None, None, words.count()
        if n <= KNOWN_MOST:
            found = words.orderBy(F.desc("n"), "id").select("id").toArrow().column("id").to_numpy().view(np.uint64)
            self.ids = np.concatenate([np.zeros(1, np.uint64), found])
            self.order = np.argsort(self.ids).astype(np.int32)
            self.ascending = self.ids[self.order]
            return
        size = BITS_LEAST
        while size < BITS_MOST and size < 32 * n:
            size *= 2
        at = words.select(F.col("id").bitwiseAND(F.lit(size - 1)).alias("b"))
        found = at.groupBy(F.shiftright("b", 3).alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 as int)))").alias("bits")).toArrow()
        self.bits = np.zeros(size // 8, np.uint8)
        self.bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The place of each id (0: none or rare), and the ids of the places in ascending order, None where all tasks know them."""
        if self.ids is not None:
            at = np.minimum(np.searchsorted(self.ascending, h), len(self.ascending) - 1)
            return np.where(self.ascending[at] == h, self.order[at], 0).astype(np.int32), None
        h = np.where(has_bit(self.bits, h), h, np.uint64(0))
        values, rank = np.unique(np.append(h, np.uint64(0)), return_inverse=True)  # 0 comes first
        return rank[:-1].astype(np.int32), values


def has_bit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = (ids & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


# -- windows -----------------------------------------------------------------------------------------
def order_of(columns: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of rows of small numbers up to ``most``, and the columns packed into as few as they fit."""
    bits = max(1, int(most).bit_length())
    per = max(1, 63 // bits)
    packed = []
    for i in range(0, len(columns), per):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[i : i + per]:
            key = (key << bits) | c
        packed.append(key)
    order = np.lexsort(packed[::-1])
    return order, [p[order] for p in packed]


def blocks(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """(block, last) of a text, cut at white space about every BLOCK_BYTES."""
    begin = 0
    while len(text) - begin > BLOCK_BYTES:
        ends = [at for at in (text.find(b" ", begin + BLOCK_BYTES), text.find(b"\n", begin + BLOCK_BYTES)) if at >= 0]
        if not ends:
            break
        yield text[begin : min(ends)], False
        begin = min(ends)
    yield text[begin:], True


Chunk = tuple[np.ndarray | None, list[np.ndarray], np.ndarray]


def sorted_chunk(ids: dict[str, dict], runs: list[tuple[str, np.ndarray]], seed: int, frequent: Frequent, starts_to: int | None) -> Chunk | None:
    """(ids of places or None, columns of places, counts): the different windows of runs of words, in order. Place 0 stands
    for no word. ``starts_to``: only windows that begin before that many words of the end."""
    base, hashes, size = {}, [], 0
    for lang, d in ids.items():
        base[lang], size = size, size + len(d)
        hashes.append(np.fromiter(map(word_id(lang, seed), d), np.uint64, len(d)))
        hashes[-1][:2] = 0
    rank, values = frequent.places(np.concatenate([*hashes, np.zeros(1, np.uint64)]))
    x = rank[np.concatenate([run + base[lang] for lang, run in runs] + [np.full(MOST_WORDS, size)])]
    n = len(x) - MOST_WORDS
    at = np.flatnonzero((x[:n] > 0) & (x[1 : n + 1] > 0))
    at = at if starts_to is None else at[at < n - starts_to]
    if not len(at):
        return None
    columns = [x[at], x[at + 1]]
    for k in range(2, MOST_WORDS):
        columns.append(np.where(columns[-1] > 0, x[at + k], 0))
    order, keys = order_of(columns, int(x.max()))
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return values, [c[order][first] for c in columns], np.diff(np.append(first, len(at)))


def windows(batches: Iterator[pa.RecordBatch], seed: int, frequent: Frequent) -> Iterator[Chunk]:
    """Sorted chunks of all windows. A text that is longer than a chunk goes on in the next one, which begins with the words
    whose windows reach over the cut."""
    ids: dict[str, defaultdict] = {}
    runs: list[tuple[str, np.ndarray]] = []
    held = 0

    def add(lang: str, words: list[bytes]) -> None:
        nonlocal held
        if lang not in ids:
            d = ids[lang] = defaultdict()
            d.default_factory = d.__len__
            d[b""], d[b"\n"]  # noqa: B018 -- takes numbers 0, left out, and 1, the end of a piece
        x = np.fromiter(map(ids[lang].__getitem__, words), np.int32, len(words))
        runs.append((lang, x[x > 0]))
        held += len(runs[-1][1])

    def full() -> bool:
        return held > CHUNK_TOKENS or sum(map(len, ids.values())) > DISTINCT_MOST

    def given(starts_to: int | None = None) -> Iterator[Chunk]:
        nonlocal ids, runs, held
        if runs and (out := sorted_chunk(ids, runs, seed, frequent, starts_to)) is not None:
            yield out
        ids, runs, held = {}, [], 0

    for part in slices(batches):
        for lang, text in texts_by_lang(part):
            for block, last in blocks(text):
                words = block.replace(b"\n", b" \n ").split(b" ")
                add(lang, words)
                if last:
                    add(lang, [b"\n"])
                elif full():
                    reach = list(islice(filter(None, reversed(words)), MOST_WORDS - 1))[::-1]
                    yield from given(len(reach))
                    add(lang, reach)
        if full():
            yield from given()
    yield from given()


def as_bytes(values: np.ndarray | None, columns: list[np.ndarray]) -> np.ndarray:
    """Windows as strings of bytes whose order is that of their ids, or of their places where all tasks know these."""
    out = np.empty((len(columns[0]), MOST_WORDS), ">u8")
    for k, c in enumerate(columns):
        out[:, k] = c if values is None else values[c]
    return out.view(f"S{8 * MOST_WORDS}")[:, 0]


def range_bounds(docs: DataFrame, seed: int, frequent: Frequent, ranges: int, tokens: int) -> np.ndarray:
    """Bounds of ranges of windows, from a sample of about SAMPLES windows a range, as Spark's own ranges are found."""
    for share in (SAMPLED, 1.0):
        step = max(1, int(tokens * share / (SAMPLES * ranges)))

        def run(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(0)
            for values, columns, counts in windows(batches, seed, frequent):
                at = np.sort(rng.integers(0, len(counts), -(-len(counts) // step)))
                yield pa.RecordBatch.from_arrays([pa.array(as_bytes(values, [c[at] for c in columns]).tolist(), pa.binary())], ["w"])

        found = docs.sample(share, 7).select("lang", "text").mapInArrow(run, "w binary").toArrow().column("w").to_pylist()
        if len(found) >= ranges:
            break
    seen = np.sort(np.array(found, f"S{8 * MOST_WORDS}"))
    return np.unique(seen[np.linspace(0, len(seen), ranges + 1)[1:-1].astype(np.int64)]) if len(seen) >= ranges > 1 else seen[:0]


def packed_part(values: np.ndarray | None, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Windows as columns of places and counts, and the ids of the places where tasks do not know them, byte by byte of
    equal weight, compressed."""
    places, rank = np.zeros(0, np.int64), np.concatenate(columns)
    if values is not None:
        places, rank = np.unique(rank, return_inverse=True)
    numbers = np.concatenate([rank, counts]).astype("<u4")
    raw = numbers.view(np.uint8).reshape(-1, 4).T.tobytes() + (b"" if values is None else values[places].astype("<u8").tobytes())
    return np.array([len(counts), len(places), len(raw)], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_part(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, columns (a row each), counts of ``packed_part``."""
    n, ids, size = (int(v) for v in np.frombuffer(data, "<u4", 3))
    raw = pa.decompress(memoryview(data)[12:], decompressed_size=size, codec="zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size - 8 * ids).reshape(4, -1).T).view("<u4").reshape(MOST_WORDS + 1, n)
    return np.frombuffer(raw, "<u8", ids, size - 8 * ids), numbers[:MOST_WORDS], numbers[MOST_WORDS]


def dealt_windows(docs: DataFrame, seed: int, frequent: Frequent, bounds: np.ndarray) -> DataFrame:
    """range, part: packed windows of each chunk and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, columns, counts in windows(batches, seed, frequent):
            cuts = np.concatenate([[0], np.searchsorted(as_bytes(values, columns), bounds), [len(counts)]]).astype(np.int64)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed_part(values, [c[a:b] for c in columns], counts[a:b])], pa.binary())], ["range", "part"])

    return small_batches(docs.select("lang", "text")).mapInArrow(run, "range int, part binary")


def merged(packed: list[bytes], frequent: Frequent, least: int) -> pa.RecordBatch:
    """words, n, partial of the phrases of a range in prefix order: those that occur ``least`` times, and, as
    partial, those at the ends of the range, which may go on in the next one."""
    parts = [unpacked_part(p) for p in packed]
    values = frequent.ids
    if values is None:
        values = np.unique(np.concatenate([p[0] for p in parts] + [np.zeros(1, np.uint64)]))
    at = [p[1] if frequent.ids is not None else np.searchsorted(values, p[0])[p[1]] for p in parts]
    columns = [np.concatenate([x[k] for x in at]).astype(np.int32) for k in range(MOST_WORDS)]
    counts = np.concatenate([p[2] for p in parts]).astype(np.int64)
    del parts, at
    order, _ = order_of(columns, len(values))
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.zeros(len(counts), bool)
    new[0] = True
    words, sizes, totals, partial = [], [], [], []
    for k in range(MOST_WORDS):
        new[1:] |= columns[k][1:] != columns[k][:-1]
        if k == 0:
            continue
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts, first)
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        wanted = (columns[k][first] > 0) & (edge | (total >= least))
        first = first[wanted]
        words.append(np.stack([values[columns[j][first]] for j in range(k + 1)], axis=1).ravel())
        sizes.append(np.full(len(first), k + 1))
        totals.append(total[wanted])
        partial.append(edge[wanted])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words).view(np.int64)))
    return pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(totals)), pa.array(np.concatenate(partial))], ["words", "n", "partial"])


def merged_ranges(dealt: DataFrame, ranges: int, frequent: Frequent, least: int) -> DataFrame:
    """``merged`` of every range; a partition is a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for r, part in zip(batch.column("range").to_pylist(), batch.column("part").to_pylist(), strict=True):
                held[r].append(part)
        while held:
            yield merged(held.popitem()[1], frequent, least)

    return dealt.repartitionById(ranges, "range").mapInArrow(run, "words array<long>, n long, partial boolean")


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """words array<long> (ids), n of all phrases of two to five words that occur ``least`` times."""
    frequent = Frequent(words.where(F.col("n") >= least).select("id", "n"))
    tokens = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, round(tokens / RANGE_TOKENS))
    bounds = range_bounds(docs, seed, frequent, ranges, tokens) if ranges > 1 else np.array([], f"S{8 * MOST_WORDS}")
    dealt = dealt_windows(docs, seed, frequent, bounds)
    found = stored(merged_ranges(dealt, len(bounds) + 1, frequent, least), "phrases")
    whole = found.where("not partial").select("words", "n")
    edges = found.where("partial").groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return whole.unionByName(edges)


# -- scores ------------------------------------------------------------------------------------------
def _joined(stream: DataFrame, counts: DataFrame) -> DataFrame:
    """A stream of parts with their counts, merged in order of the parts; parts that very many phrases have are dealt."""
    hot = hot_slots(stream.groupBy("part").agg(F.count("*").alias("n")), "part")
    return spread_join(stream, counts.hint("merge"), ["part"], hot)


def score(k: int) -> Column:
    """1000 * a * n div (lk * rk), of products beyond 64 bits; it fits a long, as lk and rk are not below a."""
    product = "cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(17,0))"
    return F.expr(f"cast({product} as decimal(38,0)) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))")


def _top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 100, share: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language the ``most`` phrases of two to five words that occur
    ``least`` times, by score, without those that a longer phrase contains and reaches ``share`` percent of.

    A phrase's count is never above those of its parts, so only phrases longer by one word need be looked at for that."""
    words, seed = checked_counts(docs)
    known = words.where(F.col("n") >= least)
    phrases = stored(frequent_phrases(docs, words, seed, least), "frequent")
    m = F.size("words")
    counts = phrases.select(F.col("words").alias("part"), F.col("n").alias("f"), F.lit(None).cast("string").alias("lang")).unionByName(known.select(F.array("id").alias("part"), F.col("n").alias("f"), "lang"))
    cut = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    left = cut.select("words", "a", "k", F.lit("l").alias("side"), F.slice("words", F.lit(1), F.col("k")).alias("part"))
    right = cut.select("words", "a", "k", F.lit("r").alias("side"), F.slice("words", F.col("k") + 1, m - F.col("k")).alias("part"))
    sides = _joined(left, counts).unionByName(_joined(right, counts))
    at = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f")))
    span = range(1, MOST_WORDS)
    wide = sides.groupBy("words", "a").agg(F.max("lang").alias("lang"), *(at("l", k).alias(f"l{k}") for k in span), *(at("r", k).alias(f"r{k}") for k in span))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    wide = wide.join(totals, "lang")
    cuts = F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in span)))
    scored = wide.select("lang", "words", "a", "n", F.array_min(cuts).alias("best")).select("lang", "words", "a", "n", "best.score", "best.l", "best.r")
    near = left.where(F.col("k") == m - 1).select("part", "a").unionByName(right.where("k = 1").select("part", "a")).where(F.size("part") > 1)
    longer = near.groupBy("part").agg(F.max("a").alias("longer")).withColumnRenamed("part", "words")
    kept = scored.join(longer, "words", "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    kept = stored(kept, "scored")
    letters = kept.select("words", F.posexplode("words").alias("at", "id"))
    hot = hot_slots(letters.groupBy("id").agg(F.count("*").alias("n")), "id")
    spelled = spread_join(letters, known.select("id", "word"), ["id"], hot).groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    d = kept.join(spelled, "words").select("lang", "phrase", "a", "l", "r", "n", "score", F.pmod(F.xxhash64("words"), F.lit(SALTS)).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = _top(_top(d, ["lang", "_salt"], order, most).drop("rank", "_salt"), ["lang"], order, most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row_number() OVER () AS piece, lang, t FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS t FROM d)),
tokens AS (SELECT piece, lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM tokens) GROUP BY lang),
grams AS (SELECT lang, m, list_slice(ws, i, i + m - 1) AS p FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM tokens, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.p, c.m, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k) JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, c.m) JOIN words w ON w.lang = c.lang),
b AS (SELECT lang, p, m, any_value(a) AS a, any_value(n) AS n, min((score, k, l, r)) AS x FROM s GROUP BY lang, p, m),
e AS (SELECT lang, q, max(f) AS longer FROM (SELECT lang, f, list_slice(p, 1, m - 1) AS q FROM f WHERE m > 2 UNION ALL SELECT lang, f, list_slice(p, 2, m) FROM f WHERE m > 2) GROUP BY lang, q),
k AS (SELECT b.lang, array_to_string(p, ' ') AS phrase, a, x[3] AS l, x[4] AS r, n, x[1] AS score FROM b LEFT JOIN e ON e.lang = b.lang AND e.q = b.p WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k QUALIFY rank <= 2000"""
