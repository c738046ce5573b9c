"""Image records that recur as the same bytes or slightly changed: all pairs within two Hamming thresholds, and groups.

Two records are alike if their sha256 are equal, or if both are measurable (spread of brightness, positive size), their
aspect ratios are close, and at most 10 bits of phash and 8 bits of dhash differ.

Groups (:func:`alike_groups`) come from one-permutation hashing with banded buckets and star edges
(:mod:`lookout.llm.oph`) over the 128 bits of both hashes: every edge is checked exactly, then connected. Stars miss a pair
of a bucket that doesn't include its hub, but hardly a group, as other permutations have other hubs (recall: README).

All pairs (:func:`alike_pairs`) are asked for without any missing, which hashing can't promise, so that search is exact: a
node becomes nine rows, one for each piece of dhash, two nodes within the thresholds share a piece, and
:mod:`lookout.llm.hamming` finds them among the nodes that share it. No bucket is capped; a crowded one is split by phash in
the same way. Equal (phash, dhash) pairs are one node, so copies meet once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.functions.text import hash_bits
from lookout.llm import components, hamming, oph
from lookout.session import materialize, spread

MAX_PHASH, MAX_DHASH, LEAST_SPREAD, MAX_ASPECT = hamming.MAX_P, hamming.MAX_D, 12.0, 1.35
#: Nodes in a bucket above which it is split by phash, and candidates a node above which a bucket is searched by phash. Both
#: change the plan only.
CROWDED, COUNTED = 2_000_000, 2_000


def prepared(corpus: DataFrame) -> DataFrame:
    """id, sha (lower case), p, d, aspect; the last three null unless the image is measurable. Rows without id are left out."""
    ok = (F.col("luma_stddev") >= LEAST_SPREAD) & ~F.isnan("luma_stddev") & (F.col("width") > 0) & (F.col("height") > 0)
    p, d = hash_bits(F.col("phash")), hash_bits(F.col("dhash"))
    seen = ok & p.isNotNull() & d.isNotNull()
    sha = F.nullif(F.lower(F.trim("sha256")), F.lit(""))
    rows = corpus.where("id is not null").select(F.col("id").cast("long").alias("id"), sha.alias("sha"), F.when(seen, p).alias("p"), F.when(seen, d).alias("d"), F.when(seen, F.col("width") / F.col("height")).alias("aspect"))
    return rows


def _close(p1: str, d1: str, p2: str, d2: str) -> Column:
    return (F.bit_count(F.col(d1).bitwiseXOR(F.col(d2))) <= MAX_DHASH) & (F.bit_count(F.col(p1).bitwiseXOR(F.col(p2))) <= MAX_PHASH)


def _keys(bits: str, pieces: tuple[tuple[int, int], ...]) -> Column:
    """Number and value of every piece: an array of ints."""
    return F.array(*[F.shiftrightunsigned(F.col(bits), at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(n << 8)).cast("int") for n, (at, width) in enumerate(pieces)])


def _searched(counted: int):
    """The search of one bucket: rows p, d, key, part."""

    def found(bucket: pa.Table) -> pa.Table:
        p, d = (bucket.column(c).to_numpy() for c in ("p", "d"))
        key, part = (bucket.column(c)[0].as_py() for c in ("key", "part"))
        i, j = hamming.close_pairs(p, d, key >> 8, part >> 8 if part >= 0 else None, counted)
        return pa.table({"p1": p[i], "d1": d[i], "p2": p[j], "d2": d[j]})

    return found


def hash_pairs(nodes: DataFrame) -> DataFrame:
    """p1, d1, p2, d2: all pairs of nodes (p, d; each once) within both thresholds, each pair once, in either order."""
    # Every node becomes nine rows here, so nodes that fit into one file are spread first.
    keyed = spread(nodes.select("p", "d")).select("p", "d", F.explode(_keys("d", hamming.PIECES)).alias("key"))
    # A piece has at most 256 values, so there are few buckets, however many nodes.
    crowded = [r.key for r in keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("key").collect()]
    parts = F.when(F.col("key").isin(crowded), _keys("p", hamming.PARTS)).otherwise(F.array(F.lit(-1))) if crowded else F.array(F.lit(-1))
    return keyed.withColumn("part", F.explode(parts)).groupBy("key", "part").applyInArrow(_searched(COUNTED), "p1 bigint, d1 bigint, p2 bigint, d2 bigint")


def node_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: the pairs of :func:`hash_pairs` by the names of their nodes (node, p, d; each (p, d) once), a < b."""
    pairs = materialize(hash_pairs(nodes), "hash-pairs")
    one, other = (nodes.select(F.col("node").alias(f"node{n}"), F.col("p").alias(f"_p{n}"), F.col("d").alias(f"_d{n}")) for n in "12")
    both = pairs.join(one, (F.col("p1") == F.col("_p1")) & (F.col("d1") == F.col("_d1"))).join(other, (F.col("p2") == F.col("_p2")) & (F.col("d2") == F.col("_d2")))
    return both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def _aspect_ok(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b)) <= F.least(F.col(a), F.col(b)) * MAX_ASPECT


def _packed(sha: Column) -> Column:
    """Bytes that are equal if and only if the texts are: 32 of a sha256 in hex, more of anything else."""
    return F.when(sha.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(sha)).otherwise(F.encode(F.concat(sha, F.lit("=" * 33)), "utf-8"))


def alike_pairs(corpus: DataFrame) -> DataFrame:
    """id_a, id_b (a < b) of every two alike records, each pair once: the size of the result is that of the problem.

    Records with the same id pair with others but not with each other. Null hashes match nothing; an empty table gives
    an empty result. See :func:`alike_groups` for a result that is linear in the corpus.
    """
    looks = Window.partitionBy("p", "d").orderBy("id")
    seen = prepared(corpus).where("p is not null").select("id", "p", "d", "aspect", (F.row_number().over(looks) == 1).alias("head"), F.lead("id").over(looks).isNotNull().alias("more"))
    rows = materialize(seen, "images")
    pairs = materialize(hash_pairs(rows.where("head")), "hash-pairs")
    linked = pairs.unionByName(rows.where("head and more").select(F.col("p").alias("p1"), F.col("d").alias("d1"), F.col("p").alias("p2"), F.col("d").alias("d2")))
    left, right = (rows.select(F.col("p").alias(f"_p{n}"), F.col("d").alias(f"_d{n}"), F.col("id").alias(f"i{n}"), F.col("aspect").alias(f"a{n}")) for n in "12")
    both = linked.join(left, (F.col("p1") == F.col("_p1")) & (F.col("d1") == F.col("_d1"))).select("p2", "d2", "i1", "a1")
    both = both.join(right, (F.col("p2") == F.col("_p2")) & (F.col("d2") == F.col("_d2"))).where(_aspect_ok("a1", "a2") & (F.col("i1") != F.col("i2")))
    alike = both.select(F.least("i1", "i2").alias("id_a"), F.greatest("i1", "i2").alias("id_b"))
    byte = prepared(corpus).where("sha is not null").select(_packed(F.col("sha")).alias("sha"), "id")
    same = byte.join(byte.select(F.col("sha").alias("_sha"), F.col("id").alias("_id")), (F.col("sha") == F.col("_sha")) & (F.col("id") < F.col("_id"))).select(F.col("id").alias("id_a"), F.col("_id").alias("id_b"))
    return alike.unionByName(same).distinct()


def _bit_keys(bins: int, rows: int, permutations: int):
    """Bucket keys of (id, p, d): the set of 128 elements (bit position and value), of 256 that there are."""

    def keys_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, p, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(ids):
            return ids, np.empty((0, 0), np.int64)
        raw = np.stack([p, d], axis=1).astype("<i8").view(np.uint8).reshape(len(ids), 16)
        bits = np.unpackbits(raw, axis=1, bitorder="little").astype(bool)
        present = np.stack([~bits, bits], axis=2).reshape(len(ids), 256)
        return ids, np.concatenate([oph.band_keys(oph.subset_sketches(present, bins, n), rows, n) for n in range(permutations)], axis=1)

    return keys_of


def oph_edges(looks: DataFrame, bins: int = oph.BINS, rows: int = oph.ROWS, permutations: int = oph.PERMUTATIONS) -> DataFrame:
    """a, b (a < b): the star edges of one-permutation buckets between looks (rep, p, d, aspect) that pass the exact test."""
    buckets = materialize(oph.bucketed(spread(looks.select("rep", "p", "d")), _bit_keys(bins, rows, permutations)), "oph-buckets")
    left, right = (looks.select(*[F.col(c).alias(f"{c}{n}") for c in ("rep", "p", "d", "aspect")]) for n in "12")
    both = oph.star_edges(buckets).join(left, F.col("hub") == F.col("rep1")).join(right, F.col("item_id") == F.col("rep2"))
    return both.where(_close("p1", "d1", "p2", "d2") & _aspect_ok("aspect1", "aspect2")).select(F.least("hub", "item_id").alias("a"), F.greatest("hub", "item_id").alias("b")).distinct()


def looks_of(rows: DataFrame) -> DataFrame:
    """rep (least id), p, d, aspect: one row for each different look among prepared rows, written once."""
    return materialize(rows.where("p is not null").groupBy("p", "d", "aspect").agg(F.min("id").alias("rep")), "looks")


def alike_groups(corpus: DataFrame, **parameters) -> DataFrame:
    """id, group_id: one row per record; groups are connected by alikeness, group_id is the least id.

    Copies aren't expanded: equal sha256 and equal (phash, dhash, aspect) hang on one representative, and edges are sought
    between representatives. ``parameters``: bins, rows and permutations of :func:`oph_edges`. Records without an edge are
    groups of their own; an empty table gives an empty result.
    """
    rows = materialize(prepared(corpus), "images")
    looks = looks_of(rows)
    same_look = (F.col("p") == F.col("_p")) & (F.col("d") == F.col("_d")) & (F.col("aspect") == F.col("_x"))
    by_look = rows.where("p is not null").join(looks.withColumnsRenamed({"p": "_p", "d": "_d", "aspect": "_x"}), same_look).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    shas = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("first")).select(F.col("sha").alias("_sha"), "first")
    by_sha = rows.where("sha is not null").join(shas, F.col("sha") == F.col("_sha")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    grouped = components.components(oph_edges(looks, **parameters).unionByName(by_look).unionByName(by_sha))
    ids = rows.select("id").distinct()
    return ids.join(grouped, F.col("id") == F.col("node"), "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
