"""Streaming operators over certificate messages: parsing, duplicates, counters, gaps and skipped entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lookout.operators import budget, latest

MESSAGE = (
    "message_type string, data struct<update_type:string,leaf_cert:struct<all_domains:array<string>,fingerprint:string,sha256:string,issuer:struct<C:string,CN:string,O:string>,"
    "not_before:double,not_after:double,serial_number:string>,cert_index:bigint,seen:double,source:struct<name:string,url:string>>"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, a folder or one file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may stand for a single file, a plain path may not


def parsed(raw: DataFrame, value: str = "value", most_names: int = 500) -> DataFrame:
    """Adds ``message`` (MESSAGE) and ``malformed``; names that aren't strings go, the rest is capped. Nothing raises."""
    schema = MESSAGE + ", _bad string"
    m = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.withColumn("_m", m)
    bad = F.col(value).isNotNull() & (F.col("_m").isNull() | F.col("_m._bad").isNotNull() | F.col("_m.message_type").isNull())
    capped = F.slice(F.filter("_m.data.leaf_cert.all_domains", lambda d: d.isNotNull()), 1, most_names)
    fixed = F.when(F.col("_m.data.leaf_cert").isNull(), F.col("_m.data")).otherwise(F.col("_m.data").withField("leaf_cert.all_domains", capped))
    return rows.withColumn("malformed", F.coalesce(bad, F.lit(False))).withColumn("message", F.when(~F.col("malformed"), F.struct(F.col("_m.message_type").alias("message_type"), fixed.alias("data")))).drop("_m")


def without_recent_repeats(stream: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """The first message of each key within a span of event time: bounded state, so repeats after it pass (the llm subpackage has the exact form)."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, time: str = "received_at", lateness: str = "10 minutes") -> DataFrame:
    """Counters of every hour; an hour comes out once, when the watermark has passed it."""
    names = F.coalesce(F.size("data.leaf_cert.all_domains"), F.lit(0))
    update = F.col("message_type") == "certificate_update"
    per = stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(update).alias("updates"),
        F.count_if(F.col("message_type") == "heartbeat").alias("heartbeats"),
        F.count_if(update & F.col("data.leaf_cert").isNull()).alias("malformed"),
        F.sum(F.when(names > 0, names).otherwise(0)).alias("names"),
    )
    return per.select(F.col("window.start").alias("hour_start"), "messages", "updates", "heartbeats", "malformed", "names")


def certificate_hosts(stream: DataFrame) -> DataFrame:
    """One row per name of a certificate, each once per message, without a leading wildcard, in lower case."""
    host = lambda d: F.regexp_replace(F.regexp_replace(F.lower(d), r"\A\*\.", ""), r"\.+\z", "")
    names = F.array_distinct(F.transform("data.leaf_cert.all_domains", host))
    return stream.where("data is not null").select("msg_id", "received_at", F.explode(names).alias("host")).where("host <> ''")


class _Gaps(StatefulProcessor):
    """Per log the time of its last message and its largest index; emits what lies between consecutive ones."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_us bigint, top bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, top = self.last.get() if self.last.exists() else (None, None)
        out = []
        every = pd.concat(list(rows)).sort_values(["at_us", "msg_id"])
        for now, number, index in every[["at_us", "msg_id", "cert_index"]].itertuples(index=False, name=None):
            if at is not None and now - at > self.seconds * 1e6:
                out.append((key[0], "gap", int(number), (now - at) / 1e6))
            if top is not None and index == index and index - top > 1:
                out.append((key[0], "skipped", int(number), float(index - top - 1)))
            at = now if at is None else max(at, now)
            if index == index:
                top = int(index) if top is None else max(top, int(index))
        self.last.update((int(at), top))
        yield pd.DataFrame(out, columns=["log", "kind", "msg_id", "amount"])

    def close(self) -> None:
        pass


def gaps_and_skips(stream: DataFrame, seconds: float = 60) -> DataFrame:
    """log, kind (gap: seconds without a message; skipped: entries between indexes), msg_id, amount. State survives restarts.

    For live feeds, whose rate bounds what a log sends in a micro-batch: a log is one key and one task's work. To catch up
    on a backlog, :func:`gaps_to_end` spreads a log over ranges. Needs the RocksDB provider.
    """
    rows = stream.where("data.source.name is not null and received_at is not null").select(F.col("data.source.name").alias("log"), "msg_id", F.unix_micros("received_at").alias("at_us"), F.col("data.cert_index").cast("double").alias("cert_index"))
    return rows.groupBy("log").transformWithStateInPandas(_Gaps(seconds), "log string, kind string, msg_id bigint, amount double", "Append", "None")


def gaps_to_end(stream: DataFrame, location: str, seconds: float = 60) -> DataFrame:
    """The same for any backlog: every micro-batch goes through the batch operators, which cut a log into ranges of time
    and of message numbers, with one carried row per log (its last time and largest index so far).

    A repeated micro-batch reads the carry of the batch before it and overwrites its own folders.
    """
    spark = stream.sparkSession
    rows = stream.where("data.source.name is not null and received_at is not null").select(F.col("data.source.name").alias("log"), "msg_id", F.col("received_at").alias("at"), F.col("data.cert_index").alias("cert_index"))

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        every = batch.withColumn("_carried", F.lit(False))
        if number:
            carried = spark.read.schema("log string, at timestamp, top long").parquet(f"{location}/carry/batch={number - 1}")
            every = every.unionByName(carried.select("log", F.lit(-1).cast("long").alias("msg_id"), "at", F.col("top").alias("cert_index"), F.lit(True).alias("_carried")))
        gaps = budget.gaps(every, ["log"], "at", "msg_id", seconds, keep_seq=True)
        run = latest.running_max_before(every.where("cert_index is not null"), ["log"], "msg_id", "cert_index", "_top")
        skips = run.where("not _carried and cert_index - _top > 1").select("log", F.lit("skipped").alias("kind"), "msg_id", (F.col("cert_index") - F.col("_top") - 1).cast("double").alias("amount"))
        out = gaps.select("log", F.lit("gap").alias("kind"), "msg_id", F.col("seconds").alias("amount")).unionByName(skips)
        out.write.mode("overwrite").parquet(f"{location}/table/batch={number}")
        every.groupBy("log").agg(F.max("at").alias("at"), F.max("cert_index").alias("top")).write.mode("overwrite").parquet(f"{location}/carry/batch={number}")
        batch.unpersist()

    rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{location}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("log string, kind string, msg_id long, amount double, batch int").parquet(f"{location}/table").drop("batch")


def run_to_end(df: DataFrame, location: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a table below ``location``, with its checkpoint beside it; read the table.

    A repeated micro-batch overwrites its own folder, so the table holds every batch once.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/table/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{location}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{location}/table").drop("batch")
