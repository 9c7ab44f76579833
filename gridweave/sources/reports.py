"""Report tables: small frames as CSV and LaTeX, and reading them again."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "\u2014"


def number(x: float | None, fmt: str = "%.4g") -> str:
    return MISSING if x is None or (isinstance(x, float) and math.isnan(x)) else fmt % x if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def interval(lo: float | None, hi: float | None, fmt: str = "%.4g") -> str:
    return MISSING if lo is None or hi is None else f"[{number(lo, fmt)}, {number(hi, fmt)}]"


def p_value(p: float | None) -> str:
    return MISSING if p is None or math.isnan(p) else "< 1e-12" if p < 1e-12 else f"{p:.3g}"


def verdict(x: float | None, threshold: float | None) -> str:
    """Whether a figure clears its threshold, and by how many times where that says something."""
    if x is None or threshold is None or math.isnan(x) or math.isnan(threshold):
        return MISSING
    times = f" ({x / threshold:.1f}x)" if threshold > 0 else ""
    return ("clears" if x > threshold else "below") + times


def save_table(df: DataFrame, folder: str, name: str, caption: str, label: str, fmt: str = "%.4g", most: int = 5_000, view: DataFrame | None = None) -> list[list[str]]:
    """Writes ``name``.csv and ``name``.tex (by Spark, folders) of a report frame of at most ``most`` rows; ``view`` is
    shown in its place where only a summary is of interest. Gives the cells as written."""
    df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} rows and is no report")
    cells = [[number(v, fmt) for v in r] for r in rows]
    escape = lambda t: t.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *cells])
    tex = f"\\begin{{table}}\n\\caption{{{caption}}}\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body}\n\\end{{tabular}}\n\\end{{table}}"
    df.sparkSession.createDataFrame([(tex,)], "value string").write.mode("overwrite").text(f"{folder}/{name}.tex")
    if view is not None:
        view.show(truncate=False)
    return cells


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}.csv", header=True)


def cell(column: str) -> Column:
    """A report's cell as a number; ``1,234`` and the mark for a missing value are understood."""
    return F.expr(f"try_cast(replace(`{column}`, ',', '') AS double)")


def transposed(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """item and a column for each value of ``key``: a report of a row a key turned on its side."""
    names = [r[0] for r in df.select(key).distinct().orderBy(key).collect()]  # a report has few rows
    each = F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("v")) for c in columns))
    return df.select(key, F.explode(each).alias("e")).groupBy(F.col("e.item").alias("item")).pivot(key, names).agg(F.first("e.v"))


def undefined_cells(cells: list[list[str]]) -> list[str]:
    """Cells that say nan, inf or None as a whole word, which no report may."""
    bad = re.compile(r"(?<![A-Za-z])(nan|-?inf|None)(?![A-Za-z])", re.IGNORECASE)
    return [c for row in cells for c in row if bad.search(c)]


def stamp_of(cell_: Column, first: Column) -> Column:
    """The time of a report's cell such as ``05 Aug 13:30``, in the year of ``first``, the earliest time of the data, or
    the next where that would be before it."""
    at = lambda year: F.to_timestamp_ntz(F.concat_ws(" ", year.cast("string"), cell_), F.lit("yyyy dd MMM HH:mm"))
    this = at(F.year(first))
    return F.when(this < F.date_trunc("DAY", first).cast("timestamp_ntz"), at(F.year(first) + 1)).otherwise(this)
