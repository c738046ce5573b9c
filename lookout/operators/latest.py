"""Latest, previous and running values per key: what the reference emulates with ordered scalar queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (give a total order); null keys form a group.

    Spark prunes the window to a per-partition top-1 before the shuffle (WindowGroupLimit), so a hot key moves one row
    per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, place: str | None = None) -> DataFrame:
    """The first n rows of each key; ``place`` keeps the rank under that name."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n)
    return ranked.withColumnRenamed("_place", place) if place else ranked.drop("_place")


def preferring(df: DataFrame, keys: Sequence[str], preferred: Column, order: Sequence[Column]) -> DataFrame:
    """The latest preferred row of each key, else its latest row."""
    return latest_by(df, keys, [F.coalesce(preferred, F.lit(False)).desc(), *order])


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], bucket: Column | None = None, known: bool = False) -> DataFrame:
    """Adds each value of the key's row before under its name, and ``_first``: whether there is no row before.

    known: the last non-null value before instead. ``bucket``, if given, must not decrease in the order and not be null:
    windows then cover a bucket only, and its first rows get what the key's earlier buckets ended with, a small table. Keys
    that hold most rows need one.
    """
    names = list(values)
    rows = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    rows = rows.withColumn("_b", bucket if bucket is not None else F.lit(0))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lambda i: F.last(f"_v{i}", ignorenulls=True).over(before) if known else F.lag(f"_v{i}").over(w)
    placed = rows.withColumns({**{f"_l{i}": inside(i) for i in range(len(names))}, "_first": F.row_number().over(w) == 1})
    if bucket is not None:
        ending = {f"_e{i}": F.last(f"_v{i}", ignorenulls=True).over(upto) if known else F.col(f"_v{i}") for i in range(len(names))}
        last = rows.withColumns({**ending, "_last": F.lead(F.lit(True)).over(w).isNull()}).where("_last")
        across = Window.partitionBy(*keys).orderBy("_b")
        carry = lambda i: F.last(f"_e{i}", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)) if known else F.lag(f"_e{i}").over(across)
        ends = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), *[carry(i).alias(f"_c{i}") for i in range(len(names))], (F.row_number().over(across) == 1).alias("_opening"))
        same = F.col("_b") == F.col("_bb")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = placed.join(ends, same)
        value = lambda i: F.coalesce(f"_l{i}", f"_c{i}") if known else F.when(F.col("_first"), F.col(f"_c{i}")).otherwise(F.col(f"_l{i}"))
        placed = joined.select(*placed.columns, *[value(i).alias(f"_m{i}") for i in range(len(names))], (F.col("_first") & F.col("_opening")).alias("_f"))
        return placed.select(*df.columns, *[F.col(f"_m{i}").alias(n) for i, n in enumerate(names)], F.col("_f").alias("_first"))
    return placed.select(*df.columns, *[F.col(f"_l{i}").alias(n) for i, n in enumerate(names)], "_first")


def previous_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, bucket: Column | None = None) -> DataFrame:
    """Adds the last non-null ``value`` strictly before each row: a backward as-of join of a table with itself. bucket: see :func:`lagged`."""
    return lagged(df, keys, order, {out: F.col(value)}, bucket, known=True).drop("_first")


def running_max_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, bucket: int = 100_000) -> DataFrame:
    """Adds the largest ``value`` strictly before each row in the order of a unique integer column.

    Ranges of ``bucket`` order values are the windows, so a key that holds most rows is spread: what came before a range
    is the running maximum of the earlier ranges' maxima, a small table.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket))
    tops = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), earlier.alias("_earlier"))
    same = F.col("_b") == F.col("_bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.max(value).over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("_inside", inside).join(tops, same)
    return joined.select(*df.columns, F.greatest("_inside", "_earlier").alias(out))


def last_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, condition: Column) -> DataFrame:
    """Keys whose last n rows exist and all meet the condition."""
    recent = top_per_key(df.withColumn("_met", F.coalesce(condition, F.lit(False))), keys, order, n)
    return recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_and("_met").alias("_all")).where((F.col("_n") == n) & F.col("_all")).select(*keys)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """Backward as-of join: every left row with the right values at the latest right time not after (strict: before) its own.

    One shuffle of the union on the keys and one sort replace a range join; no pair is formed. Ties in right_time: the
    largest struct of values. Null keys or times match nothing. With ``bucket_seconds`` (times must be timestamps), a
    key's rows are cut into buckets of time, and what earlier buckets last held is carried: for keys that hold most rows.
    """
    value_type = right.select(F.struct(*values)).schema.fields[0].dataType
    row_type = left.select(F.struct(*left.columns)).schema.fields[0].dataType
    names = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, time: str, row: Column, value: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(time).alias("_t"), row.alias("_row"), value.alias("_v"))

    both = side(left, left_time, F.struct(*left.columns), F.lit(None).cast(value_type)).unionByName(side(right, right_time, F.lit(None).cast(row_type), F.struct(*values)).where("_t is not null"))
    bucket = F.floor(F.unix_micros("_t") / (bucket_seconds * 1_000_000)) if bucket_seconds else F.lit(0)
    both = both.withColumn("_b", bucket)
    first = F.when(F.col("_row").isNull(), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    w = Window.partitionBy(*names, "_b").orderBy(F.col("_t").asc_nulls_first(), first, F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_row is not null")
    if bucket_seconds:
        ends = both.groupBy(*names, "_b").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"].alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*[F.col(n).alias(f"_e{n}") for n in names], F.col("_b").alias("_eb"), carried.alias("_carried"))
        same = F.col("_b") == F.col("_eb")
        for n in names:
            same = same & (F.col(n) == F.col(f"_e{n}"))
        filled = filled.join(ends, same, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    usable = F.col("_t").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull()
    return filled.withColumn("_found", F.when(usable, F.col("_found"))).select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
