"""Has this key been seen before? Exact first-or-repeat from disk-backed keyed stream state.

Records come in micro-batches. A streaming query groups each one by key; its state store (RocksDB: keys live on executors'
disks, snapshots and change logs go to the query's checkpoint in the shared folder) holds one entry per key, the place
(batch, id) of the key's first record. There is no watermark, so no entry ever expires and no answer is ever wrong. The
aggregation is partial before the shuffle, so a key that makes up a third of all records reaches the state as one row per
map task. In update mode the state emits the entries of the keys that the micro-batch touched, and no others; a record of
the micro-batch is its key's first if one of those entries names it. That join is on the record's own id, which can't be
skewed. So a verdict costs what the micro-batch holds, however long the history, and never changes later.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.operators.quotient import hex_id
from lookout.session import fresh_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
RECORDS = "stream string, record_id long, key binary"
VERDICTS = "stream string, record_id long, seen boolean"
#: A place packs (batch, record id) into one decimal(38,0), which stays in Tungsten's hash aggregation.
_SPAN, _HALF = Decimal(1 << 64), Decimal(1 << 63)


@contextmanager
def _state_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(records: DataFrame, stream: str, record_id: str, key: Column) -> DataFrame:
    """stream, record_id, key (binary) of the records that have a key and an id."""
    rows = records.select(F.lit(stream).alias("stream"), F.col(record_id).cast("long").alias("record_id"), key.cast("binary").alias("key"))
    return rows.where("key is not null and record_id is not null")


def certificates(messages: DataFrame) -> DataFrame:
    """Key: the fingerprint as written or, if null or empty, sha256 (empty is none)."""
    nothing = F.lit("")
    key = F.coalesce(F.nullif(F.col("data.leaf_cert.fingerprint"), nothing), F.nullif(F.col("data.leaf_cert.sha256"), nothing))
    return keyed(messages, "certificate", "msg_id", key)


def events(log: DataFrame) -> DataFrame:
    """Key: the 32 bytes of event_id, white space around it and letter case disregarded; other ids are none."""
    return keyed(log, "event", "delivery_id", F.unhex(hex_id(F.col("event_id"))))


def _place(batch: Column, record_id: Column) -> Column:
    return (batch.cast("decimal(19,0)") * F.lit(_SPAN) + (record_id.cast("decimal(20,0)") + F.lit(_HALF))).cast("decimal(38,0)")


class SeenKeys:
    """The operator. ``location`` holds what came in, checkpoint, state and verdicts; keep it to go on later.

    Micro-batches arrive in the order of their numbers, the records of one in the order of their ids. A record is seen
    if its key occurred in an earlier micro-batch, or in the same one with a smaller id; records that repeat an id of
    their stream are one record. A restart goes on from the checkpoint. A repeated micro-batch replaces what it left.
    """

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark, self.location = spark, location or fresh_path(spark, "seen-keys")

    def judge(self, records: DataFrame, batch: int) -> None:
        """Take in a micro-batch (stream, record_id, key) and write its verdicts."""
        records = records.select("stream", "record_id", "key")
        coming = f"{self.location}/in/batch={batch}"
        records.write.mode("overwrite").parquet(coming)
        verdicts = f"{self.location}/verdicts/batch={batch}"

        def decide(touched: DataFrame, _: int) -> None:
            # A micro-batch of the state is one or more of ours: more than one only after a crash between the two writes.
            number = F.floor(F.col("first") / F.lit(_SPAN)).cast("long")
            first = touched.where(number == batch).select(F.col("stream").alias("_stream"), (F.pmod("first", F.lit(_SPAN)) - F.lit(_HALF)).cast("long").alias("_first"))
            mine = touched.sparkSession.read.schema(RECORDS).parquet(coming).select("stream", "record_id").distinct()
            judged = mine.join(first, (F.col("stream") == F.col("_stream")) & (F.col("record_id") == F.col("_first")), "left")
            judged.select("stream", "record_id", F.col("_first").isNull().alias("seen")).write.mode("overwrite").parquet(verdicts)

        arrived = self.spark.readStream.schema(f"{RECORDS}, batch long").parquet(f"{self.location}/in")
        state = arrived.groupBy("stream", "key").agg(F.min(_place(F.col("batch"), F.col("record_id"))).alias("first"))
        with _state_conf(self.spark):
            query = state.writeStream.outputMode("update").foreachBatch(decide).option("checkpointLocation", f"{self.location}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()

    def run(self, stream: DataFrame) -> None:
        """Take in all that the streaming frame (stream, record_id, key) offers now, micro-batch by micro-batch."""
        query = stream.writeStream.foreachBatch(self.judge).option("checkpointLocation", f"{self.location}/source").trigger(availableNow=True).start()
        query.awaitTermination()

    def run_batches(self, batches: Iterable[DataFrame]) -> None:
        """The same for micro-batches that the caller cuts, in their order."""
        for number, records in enumerate(batches):
            self.judge(records, number)

    def verdicts(self) -> DataFrame:
        """stream, record_id, seen: of every record so far whether its key occurred before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/verdicts")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], VERDICTS)
        return self.spark.read.schema(VERDICTS).parquet(f"{self.location}/verdicts").select("stream", "record_id", "seen")

    def repeats(self) -> DataFrame:
        """stream, record_id of the records whose key occurred before."""
        return self.verdicts().where("seen").select("stream", "record_id")


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern, as a file source takes a plain path for a folder, and a table may be a single file.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
