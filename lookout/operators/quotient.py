"""Exactly one copy of each message delivered at least once: exact quotient hash tables.

Fixed-width identifiers (64 hex digits = four 64-bit words) go through an invertible permutation (two Feistel rounds
keyed by xxhash64), so any set of identifiers spreads evenly. The top bits of the permuted value are the quotient, which
names a shard; every other bit is kept as the remainder. Quotient and remainder together are the identifier, bit for
bit, so two entries agree exactly if the identifiers do: there are no false matches, unlike in a filter that keeps
remainder prefixes. A table is an aggregation keyed by (quotient, remainder): each map task inserts its rows into its own
hash table first, so an identifier that holds a third of all rows reaches the shuffle as one entry per map task.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.session import broadcast_if_small, materialize

QUOTIENT_BITS = 12
REMAINDER = ["r0", "r1", "r2", "r3"]
KEY = ["quotient", *REMAINDER]
#: Order values pack (microseconds, sequence number) into one decimal(38,0), which stays in Tungsten's hash aggregation.
_SPAN, _HALF = Decimal(1 << 64), Decimal(1 << 63)
_LATEST = 5 * 10**17
_CLAMP = 49 * 10**16


def hex_id(col: Column, digits: int = 64) -> Column:
    """``col`` without surrounding white space, in lower case; null unless it is then exactly ``digits`` hex digits."""
    bare = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(col.rlike(rf"\A[0-9a-f]{{{digits}}}\z"), col).otherwise(F.when(bare.rlike(rf"\A[0-9a-f]{{{digits}}}\z"), bare))


def permuted(id_col: Column, quotient_bits: int = QUOTIENT_BITS) -> list[Column]:
    """The columns of KEY for a 64-digit hex identifier."""
    a, b, c, d = (F.conv(F.substring(id_col, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4))
    a = a.bitwiseXOR(F.xxhash64(b, c, d))
    b = b.bitwiseXOR(F.xxhash64(a, c, d))
    quotient = F.shiftrightunsigned(a, 64 - quotient_bits).cast("int")
    rest = a.bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1))
    return [x.alias(n) for x, n in zip((quotient, rest, b, c, d), KEY, strict=True)]


def restored(quotient_bits: int = QUOTIENT_BITS) -> Column:
    """The identifier that a row with the columns of KEY stands for: the permutation run backwards."""
    a = F.shiftleft(F.col("quotient").cast("long"), 64 - quotient_bits).bitwiseOR(F.col("r0"))
    b, c, d = F.col("r1"), F.col("r2"), F.col("r3")
    b = b.bitwiseXOR(F.xxhash64(a, c, d))
    a = a.bitwiseXOR(F.xxhash64(b, c, d))
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (a, b, c, d)])


def _packed(time: Column, seq: Column) -> Column:
    micros = F.when(time.isNull(), F.lit(_LATEST)).otherwise(F.least(F.greatest(F.unix_micros(time), F.lit(-_CLAMP)), F.lit(_CLAMP)))
    return (micros.cast("decimal(19,0)") * F.lit(_SPAN) + (seq.cast("decimal(20,0)") + F.lit(_HALF))).cast("decimal(38,0)")


def _unpacked_seq(packed: Column) -> Column:
    return (F.pmod(packed, F.lit(_SPAN)) - F.lit(_HALF)).cast("long")


def quotient_table(rows: DataFrame, id_col: str, time_col: str, seq_col: str, quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """One row per identifier: KEY, ``kept`` (the seq of the copy to keep) and ``copies``.

    The kept copy has the earliest ``time_col`` (null is latest; times beyond the year 17,000 count as equal), then the
    smallest ``seq_col``. Rows whose identifier is not 64 hex digits, or whose seq is null, take no part.
    """
    valid = rows.select(hex_id(F.col(id_col)).alias("_id"), F.col(time_col).alias("_t"), F.col(seq_col).cast("long").alias("_s"))
    valid = valid.where("_id is not null and _s is not null")
    keyed = valid.select(*permuted(F.col("_id"), quotient_bits), _packed(F.col("_t"), F.col("_s")).alias("_o"))
    return keyed.groupBy(*KEY).agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("copies")).select(*KEY, _unpacked_seq(F.col("_o")).alias("kept"), "copies")


def _kept_seqs(rows: DataFrame, id_col: str, time_col: str, seq_col: str) -> DataFrame:
    return quotient_table(rows, id_col, time_col, seq_col).select(F.col("kept").alias("_kept"))


def first_copies(rows: DataFrame, id_col: str, time_col: str, seq_col: str) -> DataFrame:
    """The whole kept rows, exactly one per identifier; all columns of ``rows``, whatever their names.

    Rows that repeat a seq with the same identifier are one delivery written twice and come out once. Rows without a
    valid identifier are not in the result (see replay_stats for their number). Only narrow rows are aggregated: the seqs
    that repeat an identifier, and the seqs written twice. Within the broadcast's bounds whole rows aren't shuffled at all,
    beyond them once, by their seq, so no identifier can make a hot partition.
    """
    repeats = materialize(repeated_copies(rows, id_col, time_col, seq_col).select(F.col(seq_col).cast("long").alias("_repeat")).distinct(), "repeated-seqs")
    ids = rows.select(F.col(seq_col).cast("long").alias("_seq"), hex_id(F.col(f"`{id_col}`")).isNotNull().alias("_ok")).where("_ok and _seq is not null")
    twice = materialize(ids.groupBy("_seq").count().where("count > 1").select("_seq"), "seqs-written-twice")
    (repeats, _), (few, _) = broadcast_if_small(repeats), broadcast_if_small(twice)
    seq = F.col(seq_col).cast("long")
    kept = rows.where(hex_id(F.col(f"`{id_col}`")).isNotNull() & seq.isNotNull()).join(repeats, seq == F.col("_repeat"), "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(few, seq == F.col("_seq"), "left_anti").unionByName(kept.join(few, seq == F.col("_seq"), "left_semi").dropDuplicates([seq_col]))


def repeated_copies(rows: DataFrame, id_col: str, time_col: str, seq_col: str) -> DataFrame:
    """The seq of every row with a valid identifier that is not the kept copy."""
    kept = _kept_seqs(rows, id_col, time_col, seq_col)
    cases = rows.select(F.col(seq_col), hex_id(F.col(id_col)).alias("_id")).where(F.col("_id").isNotNull() & F.col(seq_col).isNotNull()).select(seq_col)
    return cases.join(kept, cases[seq_col].cast("long") == kept["_kept"], "left_anti")


def replay_stats(rows: DataFrame, batch_col: str, id_col: str, time_col: str, seq_col: str) -> DataFrame:
    """Per batch: records, ingested (kept copies), duplicates (copies not kept) and invalid (no identifier)."""
    kept = _kept_seqs(rows, id_col, time_col, seq_col)
    flat = rows.select(F.col(batch_col).alias("_b"), F.col(seq_col).cast("long").alias("_s"), hex_id(F.col(id_col)).isNotNull().alias("_ok"))
    joined = flat.join(kept, flat["_s"] == kept["_kept"], "left")
    ok, is_kept = F.col("_ok") & F.col("_s").isNotNull(), F.col("_kept").isNotNull()
    return joined.groupBy(F.col("_b").alias(batch_col)).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(ok & is_kept).alias("ingested"),
        F.count_if(ok & ~is_kept).alias("duplicates"),
        F.count_if(~ok).alias("invalid"),
    )


class QuotientStore:
    """Tables kept between batches, one folder per quotient: later batches are held against all earlier identifiers.

    ``insert`` adds a batch's new identifiers and returns the seqs of their first copies. The batch's quotients, at most
    2 ** quotient_bits small numbers, go into the scan as a partition filter, so only the shards that they name are read;
    choose the bits so that a shard is what one task reads at ease. Re-inserting a batch under its ``batch`` name replaces
    its entries, so a retried batch leaves the store as one run does.
    """

    def __init__(self, spark: SparkSession, path: str, quotient_bits: int = 6):
        self.spark, self.path, self.bits = spark, path, quotient_bits

    def shards(self, quotients: list[int], without: str | None = None) -> DataFrame | None:
        """The entries of the named shards but for those of one batch; None if there is no store yet."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return None
        entries = self.spark.read.schema("r0 long, r1 long, r2 long, r3 long, kept long, batch string, quotient int").parquet(self.path).where(F.col("quotient").isin(quotients))
        return entries if without is None else entries.where(F.col("batch") != without)

    def insert(self, rows: DataFrame, batch: str, id_col: str, time_col: str, seq_col: str) -> DataFrame:
        """The seqs (as ``seq_col``, long) of the batch's rows that hold an identifier for the first time."""
        new = materialize(quotient_table(rows, id_col, time_col, seq_col, self.bits).select(*KEY, "kept"), "quotient-batch")
        named = sorted(r.quotient for r in new.select("quotient").distinct().collect())
        old = self.shards(named, batch)
        if old is not None:
            same = reduce(lambda x, y: x & y, [new[c] == old[c] for c in KEY])
            new = materialize(new.join(old, same, "left_anti"), "quotient-new")
        entries = new.select(*REMAINDER, "kept", F.lit(batch).alias("batch"), "quotient")
        entries.repartition("quotient").write.partitionBy("batch", "quotient").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        return new.select(F.col("kept").alias(seq_col))
