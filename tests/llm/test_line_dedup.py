import collections
import re

import duckdb
import pytest

from gridweave.llm import line_dedup as L

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows, min_chars=L.MIN_CHARS):
    """rows: (doc_id, text); repeated rows share their fate."""
    first, lines_of = {}, {}
    key = lambda d, t: (d is not None, d, L_hash(t))
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: key(*r)):
        lines = lines_of[d, t] = t.split("\n")
        for i in range(len(lines)):
            for size in (2, 1):
                w = tuple(lines[i : i + size])
                if len(w) == size and (size == 2 or len(re.findall(WORD, w[0])) >= L.LONG_WORDS):
                    first.setdefault(w, (d, t, i))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        lines, gone = lines_of[d, t], set()
        for i in range(len(lines)):
            for size in (2, 1):
                if first.get(w := tuple(lines[i : i + size]), (d, t, i)) != (d, t, i) and len(w) == size:
                    gone |= set(range(i, i + size))
        chunks, kept = [], []
        for i in sorted(gone):
            if chunks and chunks[-1][-1] == i - 1:
                chunks[-1].append(i)
            else:
                chunks.append([i])
        chunks = [c for c in chunks if len("\n".join(lines[c[0] : c[-1] + 1])) >= min_chars]
        kept = [x for i, x in enumerate(lines) if not any(i in c for c in chunks)]
        out.append((d, "\n".join(kept), len(chunks)))
    return sorted(out, key=str)


_HASHES: dict = {}


def L_hash(t):
    return _HASHES[t]


def learn(spark, rows):
    """The hash that orders texts of one doc_id."""
    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows if t is not None}] or [("",)], "t string")
    _HASHES.update({r.t: r.h for r in texts.select("t", L.F.xxhash64("t").alias("h")).collect()})


def check(spark, rows, **more):
    learn(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.removed_chunks) for r in L.deduplicated(docs, **more).collect()), key=str)
    assert got == brute(rows, **more)
    return {(d, t): n for d, t, n in got}


LINE = "line number {} with some words in it, and a few more of them"


def passage(a, b):
    return "\n".join(LINE.format(i) for i in range(a, b))


def test_cases(spark):
    p = passage(100, 112)
    rows = [(1, f"{LINE.format(1)}\n{LINE.format(2)}\n{p}\n{LINE.format(3)}"), (2, f"{LINE.format(4)}\n{p}\n{LINE.format(5)}"), (3, p), (4, p), (5, None), (6, ""), (7, "\n\n\n"), (8, "\n".join([p] * 3)), (9, p), (9, p), (None, p), (None, "null id"), (9, f"{p}\nend")]
    got = check(spark, rows)
    assert (2, f"{LINE.format(4)}\n{LINE.format(5)}") in got and (4, "") in got


@pytest.mark.parametrize("lines", [1, 2, 3, 5, 9])
def test_passages_go_whole(spark, lines):
    """A shared passage of over 50 words goes whole from the later document, whatever stands around it."""
    words = [f"w{i}" for i in range(60)]
    step = -(-60 // lines)
    p = "\n".join(" ".join(words[i : i + step]) for i in range(0, 60, step))
    rows = [(i, f"{passage(10 * i, 10 * i + i % 4)}\n{p}\n{passage(1000 + 10 * i, 1001 + 10 * i + i % 3)}") for i in range(1, 12)]
    got = check(spark, rows)
    assert sum("w59" in t for _, t in got) == 1 and sum("w0 " in t for _, t in got) == 1


def test_very_long_and_min_chars(spark):
    body = "\n".join(f"{i} of many" for i in range(30_000))
    got = check(spark, [(1, body), (2, "x\n" + body), (3, "a\nb"), (4, "a\nb\nc")])
    assert (2, "x") in got and (4, "a\nb\nc") in got
    assert (4, "c") in check(spark, [(3, "a\nb"), (4, "a\nb\nc")], min_chars=0)


def test_many_chunks_of_a_long_text(spark):
    rows = [(1, "\n".join(LINE.format(i) for i in range(8_000))), (2, "\n".join(LINE.format(i if i % 7 else -i - 1) for i in range(8_000)))]
    assert check(spark, rows)[2, "\n".join(LINE.format(-i - 1) for i in range(0, 8_000, 7))] == 1_143


def test_shared_hash(spark, monkeypatch):
    """Windows of one hash and several texts are told apart by their bytes."""
    monkeypatch.setattr(L, "line_hash", lambda line: L.F.length(line).cast("long"))
    a, b = ("\n".join(f"{x} line {i} of about as many words as any other one here" for i in range(100, 110)) for x in "ab")
    check(spark, [(1, a), (2, b), (3, a), (4, b), (5, b)])


def test_hot_windows(spark, monkeypatch):
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 5)
    p = passage(1, 4)
    got = check(spark, [(i, f"{p}\nown {i}") for i in range(40)])
    assert sum("own" in t and "line" in t for _, t in got) == 1


def test_corpus_and_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    learn(spark, rows)
    got = sorted(((r.doc_id, r.text, r.removed_chunks) for r in L.deduplicated(docs).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(L.ORACLE).fetchall(), key=str)
    assert sum(r[2] for r in got) > 0


def test_clashing_columns_and_empty(spark):
    names = ["_0", "_1", "this", "gone", "lines", "at", "chunks", "own", "doc", "_in", "_own", "place", "size", "hash", "first", "n", "removed_chunks"]
    p = passage(1, 5)
    docs = spark.createDataFrame([(i, p, *(f"{c}{i}" for c in names)) for i in range(3)], ["doc_id", "text", *names])
    out = {r.doc_id: r for r in L.deduplicated(docs).collect()}
    assert [out[i].text for i in range(3)] == [p, "", ""] and out[2].removed_chunks == 1
    assert all(out[i][c] == f"{c}{i}" for i in out for c in names if c != "removed_chunks")
    assert L.deduplicated(docs.limit(0)).count() == 0 and collections.Counter(L.deduplicated(docs).columns)["removed_chunks"] == 1


def test_what_is_compared_does_not_grow_with_texts(spark):
    """With a full bitmap every window is compared; what it sends for that is of one size, however long its lines."""
    rows = [(i, "\n".join(f"{i} {k} " + "x" * 5_000 for k in range(5))) for i in range(4)]
    docs = spark.createDataFrame([*rows, (9, rows[0][1] + "\nend")], "doc_id long, text string")
    got = L.windows(docs, [2**32 - 1] * 8).collect()
    assert len(got) == 4 * 4 + 5 and all(len(x) <= 32 for r in got for x in r if isinstance(x, str | bytes | bytearray))
    assert len({bytes(r.digest) for r in got}) == 4 * 4 + 1
    check(spark, [*rows, (9, rows[0][1] + "\nend")])
