"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.llm import seen
from lookout.sources.tables import table


PARTS = (("cert_messages", seen.certificates), ("discovery_log", seen.events))
#: Micro-batches that p3_verdicts cuts each table into, by ranges of its ids, which are its order of arrival.
ARRIVALS = 4


def p3_found(spark, d):
    """Records whose key occurs in an earlier row of the same table.

    The files of a table are in no order of arrival, so each table comes as one micro-batch.
    """
    stream = None
    for name, key in PARTS:
        s = key(seen.file_stream(spark, f"{d}/{name}.parquet"))
        stream = s if stream is None else stream.unionByName(s)
    op = seen.SeenKeys(spark)
    op.run(stream)
    return op.repeats()


def p3_verdicts(spark, d):
    """First or repeat of every record with a key, as the records arrive in several micro-batches of increasing ids."""
    tables = [key(table(spark, d, name)) for name, key in PARTS]
    ends = [t.agg(F.min("record_id"), F.max("record_id")).first() for t in tables]

    def arrivals():
        for i in range(ARRIVALS):
            now = None
            for t, (low, high) in zip(tables, ends):
                cut = lambda j: 0 if low is None else low + (high + 1 - low) * j // ARRIVALS  # noqa: E731, B023
                part = t.where((F.col("record_id") >= cut(i)) & (F.col("record_id") < cut(i + 1)))
                now = part if now is None else now.unionByName(part)
            yield now

    op = seen.SeenKeys(spark)
    op.run_batches(arrivals())
    return op.verdicts()


def p3_wrong_answers(spark, d):
    """Per hour: certificates, exact duplicates, those the bounded-memory counters recorded, and the rate of wrong answers."""
    messages = table(spark, d, "cert_messages")
    op = seen.SeenKeys(spark)
    op.run(seen.certificates(seen.file_stream(spark, f"{d}/cert_messages.parquet")))
    verdicts = op.verdicts().select(F.col("record_id").alias("msg_id"), "seen")
    timed = messages.select("msg_id", F.date_trunc("hour", "received_at").alias("hour_start")).join(verdicts, "msg_id")
    hours = timed.groupBy("hour_start").agg(F.count(F.lit(1)).alias("keyed"), F.count_if("seen").alias("duplicates"))
    recorded = table(spark, d, "hourly_counters").select("hour_start", F.col("duplicate_certificates").alias("recorded"))
    return hours.join(recorded, "hour_start", "left").withColumn("wrong_rate", F.abs(F.col("duplicates") - F.coalesce("recorded", F.lit(0))) / F.col("keyed"))


QUERIES = {f.__name__: f for f in (p3_found, p3_verdicts, p3_wrong_answers)}

_KEYED = """
WITH bare AS (SELECT delivery_id, lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')) AS id FROM discovery_log),
keyed AS (
  SELECT 'certificate' AS stream, msg_id AS record_id, coalesce(nullif(data.leaf_cert.fingerprint, ''), nullif(data.leaf_cert.sha256, '')) AS k FROM cert_messages
  UNION ALL SELECT 'event', delivery_id, id FROM bare WHERE regexp_full_match(id, '[0-9a-f]{64}')),
judged AS (SELECT stream, record_id, record_id > min(record_id) OVER (PARTITION BY stream, k) AS seen FROM keyed WHERE k IS NOT NULL)
"""

ORACLE = {
    "p3_found": _KEYED + "SELECT stream, record_id FROM judged WHERE seen",
    "p3_verdicts": _KEYED + "SELECT stream, record_id, seen FROM judged",
    "p3_wrong_answers": _KEYED
    + """, hours AS (SELECT date_trunc('hour', received_at) AS hour_start, count(*) AS keyed, count(*) FILTER (WHERE seen) AS duplicates
  FROM cert_messages JOIN judged ON record_id = msg_id AND stream = 'certificate' GROUP BY 1)
SELECT h.hour_start, keyed, duplicates, duplicate_certificates AS recorded, abs(duplicates - coalesce(duplicate_certificates, 0)) / keyed AS wrong_rate
FROM hours h LEFT JOIN hourly_counters c ON c.hour_start = h.hour_start""",
}
