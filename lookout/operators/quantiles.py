"""Exact per-key results when a few keys hold most rows: distributed selection over value histograms.

Every round counts rows by (key, value bin) with mergeable aggregates: the number of rows and the smallest and largest
value of the bin. A map task sends at most one entry per key and bin, so a hot key costs the shuffle no more than its
bins; its values are never gathered. The bin that holds a rank is known after a round. The rank is resolved if the bin
has one distinct value, or if it asks for the first or last value of the bin; otherwise the bin's [min, max] is the next
round's interval, and only rows inside unresolved intervals are read on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.session import broadcast_if_small, materialize

#: Bins per factor e of the first round, and equal bins of an interval in later rounds.
LOG_BINS = 24
LINEAR_BINS = 4096
#: Least copies of an interval, and salts of the rows, where the intervals are too many to broadcast; as many as there are
#: shuffle partitions otherwise, so that a key that holds most rows spreads over all of them.
SALTS = 16


def _log_bin(v: Column) -> Column:
    """A monotone bin number of a long value."""
    size = F.floor(F.log1p(F.abs(v.cast("double"))) * LOG_BINS)
    return (F.signum(v.cast("double")) * size).cast("int")


def histogram(rows: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Counts by key and bin: keys, ``bin`` (null for null values), ``n``, ``lo``, ``hi``, and the sums asked for.

    ``sums`` maps names to aggregate columns that merge by the same function (sum, min, max) in :func:`totals`.
    Null keys form a group of their own.
    """
    v = F.col(value).cast("long")
    return rows.groupBy(*keys, _log_bin(v).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), *[c.alias(n) for n, c in (sums or {}).items()])


def totals(hist: DataFrame, keys: Sequence[str], merges: dict[str, Column] | None = None) -> DataFrame:
    """One row per key from a histogram: ``n`` and the merged sums."""
    return hist.groupBy(*keys).agg(F.sum("n").alias("n"), *[c.alias(n) for n, c in (merges or {}).items()])


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_{k}"])
    return cond


def _locate(hist: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bin of each wanted rank. hist: keys, _from (the interval's start or 0), bin, n, lo, hi; wanted: _keys, _start, p, rank."""
    w = Window.partitionBy(*keys, "_from").orderBy("bin")
    cum = hist.withColumn("_upto", F.sum("n").over(w))
    hit = cum.join(wanted, _same(cum, wanted, keys) & (cum["_from"] == wanted["_start"]) & (wanted["rank"] <= cum["_upto"]) & (wanted["rank"] > cum["_upto"] - cum["n"]))
    return hit.select(*[cum[k] for k in keys], "p", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), "n", "lo", "hi")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], hist: DataFrame | None = None, max_rounds: int = 20) -> DataFrame:
    """keys, ``p``, ``quantile``: the smallest value whose rank is at least p times the key's non-null values (at least 1).

    ``value`` is cast to long. Without ``keys`` all rows are one key. Keys without a non-null value have no row. An empty
    table gives an empty result. ``hist`` is a materialized :func:`histogram` of the same rows, if the caller has it already.
    """
    keys = list(keys)
    narrow = rows.select(*keys, F.col(value).cast("long").alias("_v")).where("_v is not null")
    if hist is None:
        hist = materialize(histogram(narrow, keys, "_v"), "histogram")
    hist = hist.where("bin is not null").select(*keys, F.lit(0).cast("long").alias("_from"), F.col("bin").cast("long").alias("bin"), "n", "lo", "hi")
    counts = hist.groupBy(*keys).agg(F.sum("n").alias("_n"))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(p)))).cast("long").alias("rank")) for p in probs])
    wanted = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(0).cast("long").alias("_start"), F.inline(ranks))
    done: DataFrame | None = None
    source = narrow
    for _ in range(max_rounds):
        at = materialize(_locate(hist, wanted, keys), "ranks")
        first, last = (F.col("lo") == F.col("hi")) | (F.col("rank") == 1), F.col("rank") == F.col("n")
        ready = at.where(first | last).select(*keys, "p", F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("quantile"))
        done = ready if done is None else done.unionByName(ready)
        open_ = at.where(~(first | last))
        if open_.isEmpty():
            return done
        # One interval per key and bin, though several ranks may lie in it. The intervals of one key don't overlap, so a row
        # meets one at most.
        spans = materialize(open_.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_from"), F.col("hi").alias("_to")).distinct(), "intervals")
        spans, small = broadcast_if_small(spans)
        left = source
        if small:
            joined = left.join(spans, _same(left, spans, keys) & F.col("_v").between(F.col("_from"), F.col("_to")))
        else:
            salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            left = left.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)))
            spread = spans.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            joined = left.join(spread, _same(left, spread, keys) & (left["_salt"] == spread["_copy"]) & F.col("_v").between(F.col("_from"), F.col("_to")))
        inside = materialize(joined.select(*keys, "_v", "_from", "_to"), "survivors")
        # After the logarithmic round an interval is narrow against its values, so the differences can't overflow.
        linear = F.floor((F.col("_v") - F.col("_from")).cast("double") / ((F.col("_to") - F.col("_from")).cast("double") + 1) * LINEAR_BINS).cast("long")
        hist = inside.groupBy(*keys, "_from", linear.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        wanted = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_start"), "p", "rank")
        source = inside.select(*keys, "_v")
    raise RuntimeError(f"ranks are unresolved after {max_rounds} rounds")
