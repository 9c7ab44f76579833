"""Operator 3: quality rules and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: the trusted target (every document labelled good)
and the raw corpus (every document). A document's score is the mean over
its n-grams of ln p_target - ln p_raw. Counts and scores are whole numbers (the log ratios are rounded
to millionths), so that sums do not depend on the order of rows or tasks, and every document is held
against the same threshold. A document is kept if it passes the base rules and its score is at least
the threshold. The queries set it from the trusted documents that pass the base rules: each of FOLDS parts of
them is scored with a target counted on the others, and the threshold is the LOW_QUANTILE of these scores
less MARGIN, so that it moves with the scores as the share of junk in the raw corpus does.

Cost: two passes over the text, two over that of the trusted documents; a task sends at most a row for each bucket, and
the table of log ratios (a long a bucket) goes to the tasks with the function. Up to TRUSTED_SENT trusted ids are sent to
all tasks and no text is shuffled; beyond, the trusted documents are found by a shuffle join and written once.

Defined results: a null or empty text has no words and fails the base rules; a very long text is handled alone
and whole; a null doc_id is no trusted one; doc_ids are compared as whole numbers; without trusted documents
every score is 0; repeated rows count as often as they occur; labels that repeat or are null do no
harm; an empty table gives no row; extra columns are carried and those named like a result replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.quantiles import quantiles
from gridweave.llm.bpe import slices, small_batches
from gridweave.llm.shared import checkpointed, stored

GRAM = 4  #: bytes of an n-gram
BUCKET_BITS = 16
SMOOTHING = 0.5  #: added to each bucket's counts
MICRO = 1_000_000
THRESHOLD = -0.75  #: fixed least mean log ratio, also where no trusted document can be held out
LOW_QUANTILE, MARGIN = 0.01, 0.05
FOLDS = 8  #: parts of the trusted documents, each scored by the target of the others
TRUSTED_SENT = 1_000_000  #: ids of trusted documents that are sent to all tasks; more are joined by a shuffle
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*BASE, "base_failed", "score", "kept")

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each begins, with the end."""
    texts = pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_binary())])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def codes_of(raw: np.ndarray, keep: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Equal numbers for equal byte strings: those that begin at ``begin`` and hold the bytes flagged by ``keep``."""
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    edge = np.append(place[begin], place[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edge), pa.py_buffer(raw[keep])]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def base_features(column: pa.Array) -> dict[str, np.ndarray]:
    raw, at = raw_texts(column)
    n = len(at) - 1
    space = _WS[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[at] = True
    head = head[:-1]
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    starts = ~space & (before | head)
    out = {"n_words": per_text(starts, at), "word_chars": per_text(~space & ((raw & 0xC0) != 0x80), at), "n_symbols": per_text(_SYMBOL[raw], at)}

    # lines with a word, equal to an earlier one of the text
    feed = raw == 10
    line = np.zeros(len(raw), bool)
    line[1:] = feed[:-1]
    line_at = np.flatnonzero(line | head)
    worded = np.add.reduceat(starts, line_at, dtype=np.int64) > 0 if len(line_at) else np.zeros(0, bool)
    of = np.searchsorted(at, line_at, side="right") - 1
    code = codes_of(raw, ~feed, line_at)
    first = ~pd.Series((of << 32) | code)[worded].duplicated().to_numpy() if len(line_at) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(of[worded][~first], minlength=n).astype(np.int64)

    # words in windows of three that the text has twice or more
    word_at = np.flatnonzero(starts)
    repeated = np.zeros(n, np.int64)
    if len(word_at) > 2:
        word = codes_of(raw, ~space, word_at)
        of = np.searchsorted(at, word_at, side="right") - 1
        pair = pd.factorize((word[:-2] << 32) | word[1:-1])[0]
        triple = pd.factorize((pair.astype(np.int64) << 32) | word[2:])[0]
        inside = np.flatnonzero(of[:-2] == of[2:])
        twice = inside[pd.Series((of[inside] << 32) | triple[inside]).duplicated(keep=False).to_numpy()]
        mark = np.zeros(len(word_at), bool)
        for k in range(3):
            mark[twice + k] = True
        repeated = np.bincount(of[mark], minlength=n).astype(np.int64)
    return out | {"n_repeat_words": repeated}


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that lie within a text, and where each text's begin, with the end."""
    raw, at = raw_texts(column)
    if len(raw) < GRAM:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = np.zeros(len(raw) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        h |= raw[k : len(raw) - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    bucket = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    whole = np.ones(len(raw), bool)
    for k in range(GRAM - 1):
        whole[np.maximum(at[1:] - 1 - k, at[:-1])[np.diff(at) > 0]] = False
    return bucket[whole[: len(bucket)]], np.concatenate([[0], np.cumsum(per_text(whole, at))])


def trusted_folds(labels: DataFrame) -> DataFrame:
    """doc_id, fold of all documents labelled good: the part of each by its place among them."""
    good = labels.where("quality = 1").select(F.col("doc_id").try_cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = checkpointed(good.sort("doc_id").select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")))
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row a partition
        starts.append((part, before % FOLDS))
        before += n
    start = F.create_map(*(F.lit(x) for pair in starts for x in pair))[F.col("part")] if starts else F.lit(0)
    return placed.select("doc_id", ((F.col("i") + start) % FOLDS).cast("int").alias("fold"))


def trusted_ids(labels: DataFrame) -> np.ndarray:
    """doc_ids of all documents labelled good, on the driver: for small tables. ``judged`` leaves them where they are."""
    return np.array(sorted(r[0] for r in trusted_folds(labels).select("doc_id").collect()), np.int64)


def trusted_texts(docs: DataFrame, trusted: DataFrame | np.ndarray) -> DataFrame:
    """fold, text of the rows of ``docs`` with a trusted doc_id; ``trusted``: a table of trusted_folds or sorted ids."""
    if isinstance(trusted, np.ndarray):
        ids = pd.DataFrame({"doc_id": trusted.astype(np.int64), "fold": np.arange(len(trusted), dtype=np.int32) % FOLDS})
        trusted = docs.sparkSession.createDataFrame(ids, "doc_id long, fold int")
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    if trusted.count() <= TRUSTED_SENT:
        return rows.join(F.broadcast(trusted), "doc_id").select("fold", "text")
    return stored(rows.join(trusted, "doc_id").select("fold", "text"), "trusted")


def bucket_counts(texts: DataFrame, parts: int) -> np.ndarray:
    """Counts by part and bucket of the n-grams of ``texts`` (fold, text)."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, size), np.int64)
        for part in slices(batches):
            bucket, at = grams(part.column("text"))
            fold = np.repeat(part.column("fold").to_numpy().astype(np.int64), np.diff(at))
            count += np.bincount(fold * size + bucket, minlength=parts * size).reshape(parts, size)
        some = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in count)], ["bucket", *names])

    names = [f"part{k}" for k in range(parts)]
    schema = ", ".join(f"{c} long" for c in ("bucket", *names))
    counts = small_batches(texts).mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
    count = np.zeros((parts, size))
    for row in counts.collect():  # at most a row a bucket
        count[:, row[0]] = row[1:]
    return count


def gram_counts(docs: DataFrame, trusted: DataFrame | np.ndarray, chosen: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket: of all documents, and of each part of the trusted ones (``chosen``, if they are known)."""
    raw = bucket_counts(docs.select(F.lit(0).alias("fold"), "text"), 1)[0]
    return raw, bucket_counts(trusted_texts(docs, trusted) if chosen is None else chosen, FOLDS)


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, ln p_target - ln p_raw in millionths."""
    size = len(raw)
    if not target.any():
        return np.zeros(size, np.int64)
    ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * size)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * size))
    return np.rint(ratio * MICRO).astype(np.int64)


def log_ratios(docs: DataFrame, trusted: DataFrame | np.ndarray) -> np.ndarray:
    raw, target = gram_counts(docs, trusted)
    return ratios(raw, target.sum(axis=0))


def failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])


def held_out_threshold(docs: DataFrame, trusted: DataFrame | np.ndarray, raw: np.ndarray, target: np.ndarray, chosen: DataFrame | None = None) -> float:
    """The LOW_QUANTILE, less MARGIN, of the trusted documents' scores, each part's by the target of the others."""
    if target.any(axis=1).sum() < 2:
        return THRESHOLD
    other = [ratios(raw, target.sum(axis=0) - t) for t in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fold, score = part.column("fold").to_numpy(), np.zeros(part.num_rows)
            for k in np.unique(fold):
                score[fold == k] = scores(part.column("text").filter(pa.array(fold == k)), other[k])
            yield pa.RecordBatch.from_arrays([pa.array(score[~failed(base_features(part.column("text")))])], ["score"])

    chosen = trusted_texts(docs, trusted) if chosen is None else chosen
    low = quantiles(stored(small_batches(chosen).mapInArrow(run, "score double"), "scores"), [], "score", {"low": LOW_QUANTILE}).first()["low"]
    return THRESHOLD if low is None else low - MARGIN


def scores(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams (0 without any)."""
    bucket, at = grams(column)
    total = np.zeros(len(bucket) + 1, np.int64)
    np.cumsum(ratio[bucket], out=total[1:])
    return np.diff(total[at]) / np.maximum(1, np.diff(at)) / MICRO


def judged(docs: DataFrame, labels: DataFrame, threshold: float | None = THRESHOLD) -> DataFrame:
    """``docs`` with the base features, base_failed, score and kept; a threshold of None is set from held-out scores, as the queries do."""
    docs = docs.drop(*RESULTS)
    trusted = trusted_folds(labels)
    chosen = trusted_texts(docs, trusted)
    raw, target = gram_counts(docs, trusted, chosen)
    ratio = ratios(raw, target.sum(axis=0))
    least = held_out_threshold(docs, trusted, raw, target, chosen) if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = base_features(part.column("text"))
            bad = failed(x)
            score = scores(part.column("text"), ratio)
            kept = ~bad & (score >= least)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x[c]) for c in BASE), pa.array(bad), pa.array(score), pa.array(kept)], schema.names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return small_batches(docs).mapInArrow(run, schema)
