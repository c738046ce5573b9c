"""Sinks: CSV for spreadsheets, JSON lines, and a record rendered into a token budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookout.functions.text import csv_cell


def write_csv(df: DataFrame, path: str, columns: Sequence[str], single_file: bool = False) -> None:
    """CRLF, minimal quoting, formulas neutralized, line ends flattened. One file only if asked for: it is one task's work."""
    cells = df.select(*[csv_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    (cells.coalesce(1) if single_file else cells).write.mode("overwrite").csv(path, header=True, quoteAll=False, lineSep="\r\n", escape='"', emptyValue="", nullValue="")


def json_lines(df: DataFrame, path: str) -> None:
    """Columns in alphabetical order, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def within_budget(df: DataFrame, key: str, fields: Sequence[str], budget: int, tokens: Callable | None = None) -> DataFrame:
    """key, rendered: fields in the order given as ``name: value`` lines, up to the first that would exceed the budget.

    Once one is dropped, all later ones are. ``tokens`` maps a string column to its size (default: characters / 4, up).
    """
    size = tokens or (lambda c: F.ceil(F.length(c) / 4).cast("int"))
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{f}: "), F.col(f).cast("string")).alias("line")) for i, f in enumerate(fields)])
    flat = df.select(key, F.inline(lines)).where("line is not null").withColumn("size", size(F.col("line")))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = flat.withColumn("spent", F.sum("size").over(w)).where(F.col("spent") <= budget)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("rendered"))
