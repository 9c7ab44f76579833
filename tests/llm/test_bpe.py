import json
import random
from hashlib import sha256

import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridweave.llm import bpe

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = [
    "", None, " ", "  a  b\n\n c \t", "it's we'll I'M <|endoftext|> x<|startoftext|><|endoftext|>y", "  x   y  \nz", "ΣΑΣ Σ ὈΔΥΣΣΕΎΣ İstanbul", "é ́a 日本語 テスト １２３ ²½ 12345",
    "a" * 5_000 + " " + "ab" * 3_000, "\x1c\x1d a\x85b \x0b\x0c", "don't  \n  stop!!! ...'s 's", "<|endoftext", "🙂🙂 👨‍👩‍👧 ok​", "　 a", "x\xa0 y\xa0\xa0 z",
]


def odd():
    r = random.Random(1)
    parts = ["a", "b", "'s", " ", "  ", "\n", "é", "1", "²", "Σ", "<|endoftext|>", ".", "!", "\xa0"]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(1_000)]


@pytest.mark.parametrize("file", FILES)
def test_like_the_library(file):
    texts, lib, c = odd(), Tokenizer.from_file(P.path(file)), bpe.BpeCodec(P.path(file))
    off, ids = c.encode(pa.array(texts, pa.string()))
    back = c.decode(off, ids).to_pylist()
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids[off[i] : off[i + 1]].tolist() == want, t
        assert back[i] == lib.decode(want, skip_special_tokens=False), t
    again = c.encode(pa.array(texts[::-1], pa.string()))  # from the cache
    assert again[1].tolist() == [x for i in reversed(range(len(texts))) for x in ids[off[i] : off[i + 1]].tolist()]


def test_digests_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(P.path(FILES[0]))
    got = {r[0]: tuple(r[1:]) for r in bpe.token_digests(docs, P.path(FILES[0])).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    for r in docs.collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_columns_and_empty(spark):
    schema = "doc_id long, text string, ids string"
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", "x"), (None, "", "x")], schema)
    rows = bpe.with_tokens(docs, P.path(FILES[1])).collect()
    assert sorted((r.decoded, len(r.ids)) for r in rows) == [("", 0), ("", 0), ("a b", 2)]
    assert bpe.with_tokens(spark.createDataFrame([], schema), P.path(FILES[1])).count() == 0
    assert bpe.token_digests(spark.createDataFrame([], schema), P.path(FILES[1])).count() == 0


def test_other_ids_and_repeated_rows(spark):
    for kind, ids in (("int", [1, 1, None]), ("string", ["a", "a", None])):
        docs = spark.createDataFrame([(i, "some text") for i in ids], f"doc_id {kind}, text string")
        rows = bpe.token_digests(docs, P.path(FILES[0])).collect()
        assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))


def test_other_files_are_refused():
    for file in FILES:
        spec = json.load(open(P.path(file), encoding="utf-8"))
        for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "byte_fallback": True}}, {"model": {**spec["model"], "end_of_word_suffix": "@@"}}):
            with pytest.raises(ValueError):
                bpe.check_settings({**spec, **change})


def test_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    texts = ["aaaa", "bbbb", "c" * 30, None, "", "dd", "e" * 9]
    batches = [pa.record_batch({"text": pa.array(texts[:3])}), pa.record_batch({"text": pa.array([], pa.string())}), pa.record_batch({"text": pa.array(texts[3:], pa.string())})]
    got = [b.column(0).to_pylist() for b in bpe.slices(iter(batches))]
    assert [t for g in got for t in g] == texts and got[0] == texts[:2]
    assert list(bpe.slices(iter([]))) == []
