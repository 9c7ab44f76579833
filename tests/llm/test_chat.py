import itertools
import re
from hashlib import sha256

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda t: sha256(t.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    made = chat.formatted(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(made).collect()}
    assert got == brute(rows)
    for r in made.collect():
        bare = re.sub(r"<\|(?:end|\+|[^|]*(?:\|\\[^|]*)*)\|>", "", r.formatted)
        assert "[INST]" not in bare and "</s>" not in bare and "<|" not in bare


def test_cases(spark):
    c = chat.CONTROL
    check(spark, [
        (-1, 0, "user", c), (-1, 1, "assistant", c), (1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "é<|end|>x<|+|>"),
        (2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "assistant", ""), (3, 7, "assistant", "\\"), (3, 700, "assistant", "<\\<"), (3, 701, "us|>er", "[\\[|"),
        (4, 0, "user", "long " * 20_000), (4, 1, "assistant", "y" * 50_000),
    ])


def test_null_keys(spark):
    """Null turns come first; rows of null conv_id are one conversation."""
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (5, 2, "assistant", "y"), (5, None, "user", "x"), (5, None, "user", "w")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {None: [("user", "a"), ("user", "b")], 5: [("user", "w"), ("user", "x"), ("assistant", "y")]}


def test_many_turns(spark):
    check(spark, [(7, i, ("user", "assistant", "assistant")[i % 3], f"t{i}<") for i in range(2_000)])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text("\\<[|>+a é\nend/INST]", max_size=30), min_size=1, max_size=40))
def test_any_text(spark, texts):
    check(spark, [(i % 3, i, ("user", "assistant", "system")[i % 5 % 3], t) for i, t in enumerate(texts)])


def test_empty_and_oracle(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
    path = "/root/testdata/sf0.001/conversations.parquet"
    turns = spark.read.parquet(path).select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", chat.CONTROL), (-1, 1, "assistant", chat.CONTROL)], SCHEMA)
    got = sorted(tuple(r) for r in chat.digests(chat.formatted(turns.unionByName(extra))).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(chat.ORACLE).fetchall())


def test_a_conversation_of_many_turns(spark):
    """Twenty thousand turns of one role, and as many in turn: places follow from one pass."""
    import time

    rows = [(1, i, "assistant", f"t{i}") for i in range(20_000)] + [(2, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    out = {r.conv_id: r for r in chat.formatted(turns).collect()}
    assert time.time() - began < 60
    for k, own in ((1, range(20_000)), (2, range(1, 20_000, 2))):
        assert [out[k].formatted[s.start : s.end] for s in out[k].loss] == [f"t{i}" for i in own]
