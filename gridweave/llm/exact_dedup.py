"""Operator 9 [native]: exact deduplication by progressive refinement.

Texts are equal when they are identical without the white space ``[\\x20\\x09-\\x0D]``. Documents are grouped by
the length of what is left, groups of two and more by a hash of its first characters, and only what survives both
is hashed whole (SHA-256), where it stands: a bitmap of the surviving groups goes to the tasks, so no text is ever
shuffled. Counts are combined before the shuffle, and rows of a text that very many rows share are dealt to many
tasks when they meet the row that stays.

Defined results: a null text counts as empty, and empty texts are equal; a very long text is compared whole; of
equal texts the row with the most code points stays, then the one of the smallest doc_id (null counts as smallest),
then one of the repeated rows, exactly one in all cases; an empty table gives no row; other columns are kept,
whatever their names, and those named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import back, checkpointed, hot_slots, in_slots, renamed, seen_slots, spread_join, text_or_empty

PREFIX_CHARS = 64
RESULTS = ("keep_id", "group_size", "kept")


def normalised(column: str = "text") -> Column:
    """The text without white space."""
    return reduce(lambda c, space: F.replace(c, F.lit(space)), " \n\t\r\v\f", text_or_empty(column))


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` without text, with keep_id, group_size and kept."""
    d, own = renamed(docs.drop(*RESULTS))
    text = own.pop("text")
    rest, doc_id = [*own.values(), "chars"], F.col(own["doc_id"])
    whole = F.explode(F.array(normalised(text))).alias("norm")  # made once a row
    keyed = d.select(*own.values(), F.length(text_or_empty(text)).alias("chars"), whole).select(*rest, "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))

    sizes = checkpointed(keyed.groupBy("len", "prefix").count())
    lengths = sizes.groupBy("len").agg(F.sum("count").alias("n")).where("n > 1").select("len")
    alike = sizes.join(lengths, "len", "left_semi").where("count > 1")

    full = F.when(in_slots(seen_slots(alike, "len", "prefix"), "len", "prefix"), F.sha2("norm", 256))
    rows = checkpointed(keyed.select(*rest, "len", "prefix", full.alias("full"), F.monotonically_increasing_id().alias("row")))

    best = F.min(F.struct((-F.col("chars")).alias("chars"), doc_id.alias("doc_id"), F.col("row").alias("row"))).alias("best")
    keys = ["len", "prefix", "full"]
    groups = checkpointed(rows.where("full is not null").groupBy(*keys).agg(best, F.count("*").alias("n")).where("n > 1"))
    out = spread_join(rows.where("full is not null"), groups, keys, hot_slots(groups, *keys), "left").select(*rest, "row", "best", "n")
    alone = rows.where("full is null").select(*rest, "row", F.lit(None).cast(groups.schema["best"].dataType).alias("best"), F.lit(None).cast("long").alias("n"))
    return out.unionByName(alone).select(
        *back(own),
        F.when(F.col("n").isNull(), doc_id).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
