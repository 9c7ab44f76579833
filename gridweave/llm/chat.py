"""Operator 8 [native]: chat formatting by sorted turn structs and Spark expressions only.

A conversation's turns are collected as structs and sorted; runs of turns of one role become a block
(array aggregation over the run's slice), and the blocks are concatenated:

    <|role|>text<|+|>text of the same role<|end|>

so that every turn can be read back. Texts and roles cannot imitate the markers, nor ``</s>`` or
``[INST]``: a backslash is doubled, and one is put after each ``<``, ``[`` and ``|``. ``loss`` lists
the places (code points, end exclusive) of the assistant's texts in the formatted string.

A conversation becomes one string, so it is gathered into one row: a task's memory is a few times the longest
conversation, and a value of Spark holds 2 GB. Conversations are many and short next to that.

Defined results: a null text or role counts as empty; turns of equal number are ordered by role and
text; null turn numbers come first; repeated rows are turns each; rows of null conv_id form one
conversation; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.spans import gathered

SPECIAL = "<[|"
OPEN, CLOSE, NEXT, END = "<|", "|>", "<|+|>", "<|end|>"
TRAINED = "assistant"
BLOCK_TURNS = 256  #: turns that are combined before a conversation is put together


def escaped(c: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(s + "\\")), SPECIAL, F.replace(c, F.lit("\\"), F.lit("\\\\")))


def unescaped(c: Column) -> Column:
    return F.replace(reduce(lambda x, s: F.replace(x, F.lit(s + "\\"), F.lit(s)), SPECIAL, c), F.lit("\\\\"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss array of (start, end)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a very long conversation is first combined by stretches of turns
    part = turns.groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("_part")).agg(F.collect_list(turn).alias("t"))
    whole = part.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))

    # explode() of one struct makes Spark evaluate each step once
    once = lambda df, keep, **new: df.select(*keep, F.explode(F.array(F.struct(*(c.alias(k) for k, c in new.items())))).alias("_x")).select(*keep, *(f"_x.{k}" for k in new))
    t = once(whole, ["conv_id"], t=F.transform("t", lambda x: F.struct(escaped(x["role"]).alias("role"), escaped(x["text"]).alias("text"), (x["role"] == TRAINED).alias("loss"))))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform("t", lambda x: x["role"])), F.lit(1), F.size("t"))
    heads = F.filter(F.transform(F.arrays_zip(before.alias("was"), F.col("t").alias("t")), lambda x, i: F.when(x["was"].eqNullSafe(x["t"]["role"]), -1).otherwise(i)), lambda i: i >= 0)
    h = once(t, ["conv_id", "t"], heads=heads)
    runs = F.transform("heads", lambda i, k: F.slice("t", i + 1, F.coalesce(F.get("heads", k + 1), F.size("t")) - i))
    block = lambda r: F.concat(F.lit(OPEN), F.get(r, 0)["role"], F.lit(CLOSE), F.array_join(F.transform(r, lambda x: x["text"]), NEXT), F.lit(END))
    b = once(h, ["conv_id", "t"], runs=runs)
    text = F.array_join(F.transform("runs", block), "")

    def place(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        """Where a text stands, from the end of the one before it."""
        opened = F.when(x["was"].isNull(), 0).otherwise(len(END)) + len(OPEN) + F.length(x["t"]["role"]) + len(CLOSE)
        start = acc["at"] + F.when(x["was"].eqNullSafe(x["t"]["role"]), len(NEXT)).otherwise(opened)
        end = start + F.length(x["t"]["text"])
        return {"at": end}, F.struct(start.alias("start"), end.alias("end"), x["t"]["loss"].alias("loss"))

    places = gathered(F.arrays_zip(before.alias("was"), F.col("t").alias("t")), {"at": F.lit(0)}, "array<struct<start:int,end:int,loss:boolean>>", place)
    loss = F.transform(F.filter(places, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))
    return b.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_back(out: DataFrame) -> DataFrame:
    """``out`` with turns (array of role, text), parsed from the formatted string, and trained: the texts under the loss mask."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    parsed = out.select("*", F.explode(F.array(F.struct(blocks.alias("b")))).alias("_b"))

    def turns(x: Column) -> Column:
        role = F.substring_index(F.substring(x, len(OPEN) + 1, F.length(x)), CLOSE, 1)
        body = F.substring(x, F.length(role) + len(OPEN) + len(CLOSE) + 1, F.length(x))
        return F.transform(F.split(body, r"<\|\+\|>", -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    trained = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return parsed.withColumns({"turns": F.flatten(F.transform("_b.b", turns)), "trained": trained}).drop("_b")


def digests(out: DataFrame) -> DataFrame:
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read_back(out).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


CONTROL = "</s>[INST] ok [/INST]"

ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
r AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(text) + length(regexp_replace(text, '[^\\<\[|]', '', 'g'))
           + CASE WHEN head THEN length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + {len(OPEN) + len(CLOSE) + len(END)} ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
