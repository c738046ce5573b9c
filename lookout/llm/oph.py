"""Near duplicates of sets by one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

One hash of every element puts it into one of K bins; a bin's sketch is its least hash. An empty bin borrows from bins that
a second hash picks one after the other until one isn't empty (optimal densification: every non-empty bin is as likely),
so two sets agree in a bin with the probability of their Jaccard similarity. Bands of ``rows`` bins make buckets; in each
bucket, only edges to its hub (the member of least hash with the bucket's key) are kept, so a bucket of n members has n - 1
edges, never n * n. Several permutations make sketches, buckets and hubs that miss different pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, ROWS, PERMUTATIONS = 128, 10, 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def placed(elements: np.ndarray, bins: int, permutation: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and bin of every element."""
    start = (0x632BE59BD9B4E019 + permutation * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    h = _mix(elements.astype(np.uint64) + np.uint64(start))
    return h, (h >> np.uint64(40)).astype(np.int64) % bins


def densified(sketches: np.ndarray, permutation: int) -> np.ndarray:
    """Rows of sketches whose empty bins have borrowed; rows without any full bin stay empty."""
    bins, full = sketches.shape[1], sketches != _EMPTY
    out = sketches.copy()
    row, at = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for attempt in range(1, 64 * bins):
        if not len(row):
            break
        step = np.uint64((attempt + permutation * 64 * bins) & 0xFFFFFFFF)
        donors = (_mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x100000001) + step) % np.uint64(bins)).astype(np.int64)
        donor = donors[at]
        lent = full[row, donor]
        out[row[lent], at[lent]] = sketches[row[lent], donor[lent]]
        row, at = row[~lent], at[~lent]
    return out


def sketch(elements: np.ndarray, bins: int = BINS, permutation: int = 0) -> np.ndarray | None:
    """K least hashes of a set of 64-bit elements; None for the empty set."""
    if not len(elements):
        return None
    h, where = placed(elements, bins, permutation)
    out = np.full(bins, _EMPTY, np.uint64)
    np.minimum.at(out, where, h)
    return densified(out[None], permutation)[0]


def subset_sketches(present: np.ndarray, bins: int = BINS, permutation: int = 0) -> np.ndarray:
    """Sketches of many subsets of the elements 0 to n - 1 at once. present: a row of n booleans for each subset."""
    h, where = placed(np.arange(present.shape[1]), bins, permutation)
    # From the largest hash to the smallest, so what is written last into a bin is its least; bins and elements are rows.
    out, has = np.full((bins, len(present)), _EMPTY, np.uint64), np.ascontiguousarray(present.T)
    for i in np.argsort(h)[::-1]:
        np.putmask(out[where[i]], has[i], h[i])
    return densified(np.ascontiguousarray(out.T), permutation)


def band_keys(sketches: np.ndarray, rows: int = ROWS, permutation: int = 0) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins; the last axis holds the bins, then the bands."""
    bands = sketches[..., : sketches.shape[-1] // rows * rows].reshape(*sketches.shape[:-1], -1, rows)
    key = _mix(np.arange(bands.shape[-2], dtype=np.uint64) + np.uint64(1 + (permutation << 32)))
    for i in range(rows):
        key = _mix(key ^ bands[..., i])
    return key.astype(np.int64)


def bucketed(items: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """item_id, key from a function that gives the ids and the rows of keys of a batch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, keys = keys_of(b)
            flat = [np.repeat(ids, keys.shape[1]), keys.ravel()] if len(ids) else [np.empty(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["item_id", "key"])

    return items.mapInArrow(batches, "item_id bigint, key bigint")


def banded(items: DataFrame, item_id: str, elements: str, bins: int = BINS, rows: int = ROWS, permutations: int = 1) -> DataFrame:
    """item_id (long), key: the buckets of every item with a non-empty set (``elements``: array of long; nulls don't count)."""

    def keys_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, keys = [], []
        for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = np.array([x for x in e or () if x is not None], np.int64)
            if len(found):
                ids.append(i)
                keys.append(np.concatenate([band_keys(sketch(found, bins, p), rows, p) for p in range(permutations)]))
        return np.array(ids, np.int64), np.array(keys, np.int64)

    return bucketed(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(elements).alias("elements")).where("item_id is not null"), keys_of)


def star_edges(buckets: DataFrame) -> DataFrame:
    """hub, item_id: in every bucket the edge from its hub to each other member, each edge once."""
    hubs = buckets.groupBy("key").agg(F.min_by("item_id", F.xxhash64("key", "item_id")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"), "hub")
    return buckets.join(hubs, F.col("key") == F.col("_key")).where("item_id <> hub").select("hub", "item_id").distinct()
