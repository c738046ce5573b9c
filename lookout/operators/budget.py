"""Caps and budgets in order: per-key admission, running budgets that stop or skip, gaps and clipped intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(df: DataFrame, keys: Sequence[str], order: Sequence[Column], allowance: Column, taken: Column | None = None) -> DataFrame:
    """Adds ``place`` and ``admitted``: whether a row's place within its key, after those taken already, is in the allowance."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).withColumn("admitted", F.col("place") <= allowance - (taken if taken is not None else F.lit(0)))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, out: str, bucket: Column | None = None) -> DataFrame:
    """Adds the sum of ``size`` (null is 0) up to and with each row of a key.

    ``bucket``, if given, must not decrease in the order: windows then cover a bucket only, and what came before it is the
    running sum of the earlier buckets' sums, a small table. Keys that hold most rows need one.
    """
    value = F.coalesce(F.col(size), F.lit(0))
    within = lambda *k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bucket is None:
        return df.withColumn(out, F.sum(value).over(within(*keys)))
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    earlier = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), earlier.alias("_earlier"))
    same = F.col("_b").eqNullSafe(F.col("_bb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.withColumn("_in", F.sum(value).over(within(*keys, "_b"))).join(sums, same)
    return joined.select(*df.columns, (F.col("_in") + F.col("_earlier")).alias(out))


def until_spent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int, bucket: Column | None = None) -> DataFrame:
    """Rows of each key in order up to the first that would exceed the budget: it and all later rows are dropped (sizes >= 0)."""
    return running_sum(df, keys, order, size, "_spent", bucket).where(F.col("_spent") <= budget).drop("_spent")


def skipping(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Adds ``accepted``: each row of a key in order is taken if it still fits what the accepted ones left.

    Rejected rows don't count, so this isn't a window sum; it streams through partitions clustered by key and sorted, with
    one number as state, and never holds a group.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("accepted", BooleanType())])
    cols, key_names = df.columns, list(keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left = object(), budget
        for b in batches:
            flags = []
            for *k, s in b[[*key_names, size]].itertuples(index=False, name=None):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k != key:
                    key, left = k, budget
                s = 0 if pd.isna(s) else s
                flags.append(s <= left)
                left -= s if flags[-1] else 0
            yield b[cols].assign(accepted=flags)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)


def gaps(df: DataFrame, keys: Sequence[str], time: str, seq: str, threshold_seconds: float, bucket_seconds: int = 3600, keep_seq: bool = False) -> DataFrame:
    """keys, gap_start, gap_end, seconds of consecutive rows further apart than the threshold (ties by ``seq``).

    ``keep_seq`` adds the seq of the row that ends the gap.
    A key's rows, or all rows if there are no keys, are cut into buckets of time, so no task takes a whole key: gaps inside
    buckets come from a window per bucket, gaps between them from the buckets' first and last times.
    """
    rows = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(seq).alias("_s"), F.floor(F.unix_micros(time) / (bucket_seconds * 1_000_000)).alias("_b"))
    inside = rows.select(*keys, F.lag("_t").over(Window.partitionBy(*keys, "_b").orderBy("_t", "_s")).alias("gap_start"), F.col("_t").alias("gap_end"), "_s")
    ends = rows.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.min(F.struct("_t", "_s"))["_s"].alias("_s"))
    between = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("gap_start"), F.col("_first").alias("gap_end"), "_s")
    seconds = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1e6
    found = inside.unionByName(between).withColumn("seconds", seconds).where(F.col("seconds") > threshold_seconds)
    return found.withColumnRenamed("_s", seq) if keep_seq else found.drop("_s")


def clipped_seconds(spans: DataFrame, start: str, end: str, lower: Column, upper: Column) -> DataFrame:
    """One row: the seconds that intervals (open ones end at ``upper``) spend between lower and upper."""
    a = F.greatest(F.col(start), lower)
    b = F.least(F.coalesce(F.col(end), upper), upper)
    inside = F.greatest(F.unix_micros(b) - F.unix_micros(a), F.lit(0))
    return spans.where(F.col(start).isNotNull()).agg((F.coalesce(F.sum(inside), F.lit(0)) / 1e6).alias("seconds"))
