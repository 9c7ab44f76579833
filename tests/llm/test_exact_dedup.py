import re
from hashlib import sha256

import duckdb

from gridweave.llm import exact_dedup as X
from gridweave.llm.queries import op9_exact_dedup


def test_oracle(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op9_exact_dedup(spark, path).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert got == sorted(con.execute(X.ORACLE).fetchall())
    assert any(not r[3] for r in got)


def test_cases(spark):
    long = "x" * 70
    rows = [(5, "a b", "k"), (4, "ab", "k"), (3, "a\x0bb", "k"), (6, "a b ", "k"), (1, None, "k"), (2, "", "k"), (7, " \n\t\r\x0c", "k"), (8, long + "1", "k"), (9, long + "2", "k"), (10, long + "1", "k"), (11, "a\xa0b", "k"), (12, "dup", "k"), (12, "dup", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = X.exact_groups(docs).collect()
    assert len(got) == len(rows) and "text" not in got[0].asDict()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in {r.doc_id: r for r in got}.values():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        same = [(-len(t or ""), d) for d, t, _ in rows if norm(t) == norm(text)]
        assert (r.group_size, r.keep_id) == (len(same), min(same)[1])
    assert sum(r.kept for r in got) == len({sha256(norm(t).encode()).digest() for _, t, _ in rows})
    assert X.exact_groups(spark.createDataFrame([], docs.schema)).count() == 0


def test_clashing_columns_nulls_and_long(spark, monkeypatch):
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 4)
    names = ["_0", "_1", "this", "_len", "_prefix", "_row", "_in", "_out", "len", "prefix", "full", "row", "norm", "chars", "rest", "best", "n", "_salt"]
    long = "x y" * 200_000
    rows = [(None, long, *names), (None, long + "z", *names), (3, long + " ", *names), *((i, "same", *names) for i in range(10, 20)), (None, "same", *names)]
    got = X.exact_groups(spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")).collect()
    assert len(got) == len(rows) and all(r[c] == c for r in got for c in names)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got if r.group_size < 5) == [("3", "3", 2, True), ("None", "3", 2, False), ("None", "None", 1, True)]
    assert sum(r.group_size == 11 and r.keep_id is None for r in got) == 11 and sum(r.kept for r in got) == 3
