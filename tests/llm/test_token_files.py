import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from gridweave.llm import token_files as TF
from gridweave.llm.queries import op5_token_files

PATH = P.path("word_bpe_49k.json")


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    lib, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: tuple(r)[1:] for r in op5_token_files(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout(spark, tmp_path, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = f"{tmp_path}/t"
    TF.write_token_files(docs, PATH, out, encoding=encoding, files=3)
    rows = TF.read_token_files(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.select("doc_id").collect())
    files = sorted(tmp_path.glob("t/*.parquet"))
    assert len(files) == 3
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert column.has_offset_index and column.has_column_index
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY" if "RLE_DICTIONARY" in column.encodings else "PLAIN_DICTIONARY") in column.encodings
    plan = TF.file_starts(spark.read.parquet(out))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<part:bigint,before:bigint,n_tokens:bigint>" in plan  # lengths are read without ids


def test_very_long_text_and_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TF, "FILES_MOST", 1)
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "a b"), (3, None)], "doc_id long, text string")
    TF.write_token_files(docs, PATH, f"{tmp_path}/l", files=3)
    assert [(r.start, r.n_tokens) for r in TF.read_token_files(spark, f"{tmp_path}/l").orderBy("doc_id").collect()] == [(0, 300_001), (300_001, 3), (300_004, 1)]


def test_edges(spark, tmp_path):
    schema = "doc_id long, text string, part string"
    TF.write_token_files(spark.createDataFrame([(None, "a", "x"), (2, None, "x"), (1, "", "x"), (1, "b c", "x"), (1, "b c", "x")], schema), PATH, f"{tmp_path}/a")
    rows = TF.with_crc(TF.read_token_files(spark, f"{tmp_path}/a")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 2] and sum(r.n_tokens for r in rows) == 5 + 1 + 2 + 2
    TF.write_token_files(spark.createDataFrame([], schema), PATH, f"{tmp_path}/b")
    assert TF.read_token_files(spark, f"{tmp_path}/b").count() == 0
