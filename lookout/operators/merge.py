"""Idempotent inserts, upserts, history and retirement, derived from append-only tables instead of updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators.latest import lagged, latest_by


def insert_new(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``batch`` to add: the first of each key in order, if ``existing`` doesn't hold the key (on conflict do nothing)."""
    return latest_by(batch, keys, order).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def last_wins(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after an upsert that replaces: the last row per key of both, by name."""
    return latest_by(existing.unionByName(batch, allowMissingColumns=True), keys, order)


def sightings(events: DataFrame, keys: Sequence[str], time: str, strong: Column) -> DataFrame:
    """first_seen, last_seen, observations and strength (strong if any is) per key: order-insensitive, so replays and late rows need no merge."""
    return events.groupBy(*keys).agg(
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.count(F.lit(1)).alias("observations"),
        F.when(F.max(F.coalesce(strong, F.lit(False))), "strong").otherwise("weak").alias("strength"),
    )


def merged_sightings(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The same from partial results, as a batch-wise upsert would merge them."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("observations").alias("observations"),
        F.when(F.max(F.col("strength") == "strong"), "strong").otherwise("weak").alias("strength"),
    )


def changes_only(history: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column | None = None) -> DataFrame:
    """The rows whose value differs from the key's row before (null-safe); the first row is a change. bucket: see :func:`latest.lagged`."""
    marked = lagged(history.withColumn("_value", value), keys, order, {"_before": F.col("_value")}, bucket)
    return marked.where(F.col("_first") | ~F.col("_value").eqNullSafe(F.col("_before"))).select(*history.columns)


def retired(current: DataFrame, kept: DataFrame, keys: Sequence[str], examined: Column) -> DataFrame:
    """Rows of ``current`` that were examined and aren't in ``kept``: those to mark inactive."""
    same = F.lit(True)
    k = kept.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return current.where(F.coalesce(examined, F.lit(False))).join(k, same, "left_anti")


def set_change(runs: DataFrame, keys: Sequence[str], order: Sequence[Column], members: str) -> DataFrame:
    """Adds ``added`` and ``removed``: members against the key's run before; both empty for a first run."""
    before = F.lag(members).over(Window.partitionBy(*keys).orderBy(*order))
    none = F.array().cast(runs.schema[members].dataType)
    b = runs.withColumn("_before", before)
    return b.withColumn("added", F.when(F.col("_before").isNull(), none).otherwise(F.array_sort(F.array_except(members, "_before")))).withColumn("removed", F.when(F.col("_before").isNull(), none).otherwise(F.array_sort(F.array_except("_before", members)))).drop("_before")


def oldest_beyond(df: DataFrame, size: str, newest_first: Sequence[Column], max_total: int) -> DataFrame:
    """Rows (files, segments) from the newest on whose running size is over the limit: those to delete.

    The listing must be one of files, not of data: the running sum is global, in one task.
    """
    w = Window.orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_total", F.sum(size).over(w)).where(F.col("_total") > max_total).drop("_total")
