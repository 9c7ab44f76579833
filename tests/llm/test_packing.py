import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from gridweave.llm import packing

PATH = P.path("byte_bpe_50k.json")


def check(rows, want, window):
    """Every id in one piece, windows gapless and not overfull; returns the share of padding."""
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        ids = want[r.doc_id]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert set(docs) == set(want)
    for d, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[d])
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return 1 - sum(r.length for r in rows) / (window * len(windows))


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert check(packing.pack(docs, PATH, keep_ids=False).collect(), want, 2048) < 0.01
    rows = packing.pack(docs.where("doc_id < 50"), PATH, window=64, shards=3).collect()
    assert all(r.ids == want[r.doc_id][r.start : r.start + r.length] for r in rows)
    check(rows, {k: v for k, v in want.items() if k < 50}, 64)


def test_edges(spark):
    schema = "doc_id long, text string, length string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 9_000, "x")], schema)
    lib = Tokenizer.from_file(PATH)
    check(packing.pack(docs, PATH).collect(), {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in docs.collect()}, 2048)
    none = packing.pack(spark.createDataFrame([(None, "a b", "x"), (None, "c", "x")], schema), PATH).collect()
    assert [r.doc_id for r in none] == [None, None] and {r.length for r in none} == {2, 3}
    twice = packing.pack(spark.createDataFrame([(7, "a b", "x")] * 3, schema), PATH).collect()
    assert len(twice) == 3 and sorted(r.offset for r in twice) == [0, 3, 6]
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0


def test_tree_is_best_fit():
    """The tree's windows are those of a plain search for the tightest fit."""
    rng = np.random.default_rng(3)
    tree, open_, plain = packing.CapacityTree(100), [], []
    for k, need in enumerate(sorted(rng.integers(1, 101, 500).tolist(), reverse=True)):
        found = tree.take(need)
        i = bisect.bisect_left(open_, need)
        want = open_.pop(i) if i < len(open_) else None
        assert (found[0] if found else None) == want
        left = (want or 100) - need
        if left:
            tree.put(left, k)
            bisect.insort(open_, left)
        plain.append(want)
    assert any(plain)
