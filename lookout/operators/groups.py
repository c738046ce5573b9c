"""Results per stage and group of the job queue without hot tasks."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.operators.quantiles import exact_quantiles, histogram, totals
from lookout.session import materialize

KEYS = ["stage", "group_key"]


def effective_group(group_key: Column, payload_json: Column) -> Column:
    """group_key or, if null or empty, the payload's registrable_domain or, if that is missing or empty, its name.

    In lower case and without a dot at the end. Null if all three are missing, or the payload isn't JSON.
    """
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    key = F.coalesce(blank_to_null(group_key), blank_to_null(F.get_json_object(payload_json, "$.registrable_domain")), blank_to_null(F.get_json_object(payload_json, "$.name")))
    return F.regexp_replace(F.lower(key), r"\.\z", "")


def prepared(jobs: DataFrame) -> DataFrame:
    """stage, group_key (effective), attempts, created_at, updated_at and waited (microseconds between the two)."""
    return jobs.select(
        "stage",
        effective_group(F.col("group_key"), F.col("payload_json")).alias("group_key"),
        F.col("attempts").cast("long").alias("attempts"),
        "created_at",
        "updated_at",
        (F.unix_micros("updated_at") - F.unix_micros("created_at")).alias("waited"),
    )


def _histogram(jobs: DataFrame) -> DataFrame:
    sums = {"attempts": F.sum("attempts"), "first_at": F.min("created_at"), "last_at": F.max("updated_at")}
    return materialize(histogram(prepared(jobs), KEYS, "waited", sums), "job-histogram")


def _totals(hist: DataFrame) -> DataFrame:
    return totals(hist, KEYS, {"attempts": F.sum("attempts"), "first_at": F.min("first_at"), "last_at": F.max("last_at")})


def heavy_groups(jobs: DataFrame, share: float = 0.01) -> DataFrame:
    """stage, group_key of the pairs with at least ``share`` of all rows; null keys are no group.

    In the order of the pairs' hashes, a pair of so many rows holds one of every so many ranks: at most 1 / share ranks,
    which :func:`exact_quantiles` resolves from histograms of the hashes. A map task sends no more than their bins, however
    many pairs there are. Only rows with a hash found are counted by their pairs, so that a hash of two pairs joins nothing.
    """
    keyed = prepared(jobs).select(*KEYS, F.when(F.col("group_key").isNotNull(), F.xxhash64(*KEYS)).alias("hash"))
    hashes = materialize(keyed.select("hash"), "group-hashes")
    every, ranked = hashes.agg(F.count(F.lit(1)), F.count("hash")).first()
    # In fractions of the share as written: 0.07 of 700 rows are 49, in floating point a little more.
    least = max(1, math.ceil(Fraction(str(share)) * every))
    # Half a rank below each, so that rounding can't move it.
    probs = [(rank - 0.5) / ranked for rank in range(least, ranked + 1, least)]
    if not probs:
        return keyed.where(F.lit(False)).select(*KEYS)
    found = exact_quantiles(hashes, [], "hash", probs).select(F.col("quantile").alias("_hash")).distinct()
    counts = keyed.join(F.broadcast(found), F.col("hash") == F.col("_hash"), "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select(*KEYS)


def group_profile(jobs: DataFrame, probs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per stage and group: jobs, attempts, first and last times, and exact quantiles of the time from creation to update.

    Groups without any pair of times have null quantiles; rows without a key form the group null.
    """
    hist = _histogram(jobs)
    quantiles = exact_quantiles(prepared(jobs), KEYS, "waited", probs, hist)
    wide = quantiles.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(*[F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(f"waited_p{round(p * 100)}") for p in probs])
    t = _totals(hist)
    same = t["stage"].eqNullSafe(wide["_stage"]) & t["group_key"].eqNullSafe(wide["_group_key"])
    return t.join(wide, same, "left").select(*KEYS, F.col("n").alias("jobs"), "attempts", "first_at", "last_at", *[f"waited_p{round(p * 100)}" for p in probs])
