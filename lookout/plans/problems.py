"""Queries of the general training-data operators (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.operators import groups, quotient
from lookout.session import fresh_path
from lookout.sources.tables import table

_DELIVERY = ("event_id", "observed_at", "delivery_id")


def p1_found(spark, d):
    """Every delivery with an identifier that is not the kept copy."""
    return quotient.repeated_copies(table(spark, d, "discovery_log"), *_DELIVERY)


def p1_kept(spark, d):
    """Exactly one whole row per event."""
    return quotient.first_copies(table(spark, d, "discovery_log"), *_DELIVERY)


def p1_batches(spark, d):
    """First copies as the store keeps them while the log comes in four batches by order of arrival: the batch and the delivery that first held each event.

    Within a batch the earliest observed_at counts, as in p1_found; an event of an earlier batch isn't new in a later one.
    """
    log = table(spark, d, "discovery_log").select("delivery_id", "event_id", "observed_at")
    low, high = log.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    store, out = quotient.QuotientStore(spark, fresh_path(spark, "quotient-store")), None
    for i, (a, b) in enumerate(_quarters(low, high)):
        new = store.insert(log.where((F.col("delivery_id") >= a) & (F.col("delivery_id") < b)), f"{i}", "event_id", "observed_at", "delivery_id").select(F.lit(i).alias("batch"), "delivery_id")
        out = new if out is None else out.unionByName(new)
    return out


def _quarters(low: int | None, high: int | None) -> list[tuple[int, int]]:
    """Four ranges [a, b) from low to high; for an empty table one empty range."""
    if low is None:
        return [(0, 0)]
    cuts = [low + (high + 1 - low) * i // 4 for i in range(5)]
    return list(zip(cuts, cuts[1:]))


def p1_replay_stats(spark, d):
    return quotient.replay_stats(table(spark, d, "discovery_log"), "segment", *_DELIVERY)


def p4_found(spark, d):
    """Pairs of stage and group with at least a hundredth of all rows."""
    return groups.heavy_groups(table(spark, d, "job_rows"))


def p4_groups(spark, d):
    return groups.group_profile(table(spark, d, "job_rows"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_batches, p1_replay_stats, p4_found, p4_groups)}

_RANKED = """
WITH bare AS (SELECT *, lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')) AS id FROM discovery_log),
ranked AS (
  SELECT *, regexp_full_match(coalesce(id, ''), '[0-9a-f]{64}') AS ok,
    row_number() OVER (PARTITION BY id ORDER BY observed_at ASC NULLS LAST, delivery_id) AS place
  FROM bare)
"""

_KEYED = """
WITH named AS (
  SELECT *, coalesce(nullif(group_key, ''), nullif(json_extract_string(payload_json, '$.registrable_domain'), ''),
    nullif(json_extract_string(payload_json, '$.name'), '')) AS raw_key FROM job_rows),
keyed AS (SELECT * EXCLUDE (group_key), regexp_replace(lower(raw_key), '\\.$', '') AS group_key FROM named)
"""

ORACLE = {
    "p1_found": _RANKED + "SELECT delivery_id FROM ranked WHERE ok AND place > 1",
    "p1_kept": _RANKED + "SELECT * EXCLUDE (id, ok, place) FROM ranked WHERE ok AND place = 1",
    "p1_batches": """WITH bare AS (SELECT delivery_id, observed_at, lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')) AS id, min(delivery_id) OVER () AS lo, max(delivery_id) OVER () AS hi FROM discovery_log),
parts AS (SELECT delivery_id, observed_at, id, CAST((SELECT max(i) FROM range(4) r(i) WHERE delivery_id >= lo + (hi + 1 - lo) * i // 4) AS INTEGER) AS batch FROM bare WHERE regexp_full_match(id, '[0-9a-f]{64}')),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch, observed_at ASC NULLS LAST, delivery_id) AS place FROM parts)
SELECT batch, delivery_id FROM placed WHERE place = 1""",
    "p1_replay_stats": _RANKED
    + """SELECT segment, count(*) AS records, count(*) FILTER (WHERE ok AND place = 1) AS ingested,
    count(*) FILTER (WHERE ok AND place > 1) AS duplicates, count(*) FILTER (WHERE NOT ok) AS invalid FROM ranked GROUP BY segment""",
    "p4_found": _KEYED + "SELECT stage, group_key FROM keyed WHERE group_key IS NOT NULL GROUP BY stage, group_key HAVING count(*) >= 0.01 * (SELECT count(*) FROM job_rows)",
    "p4_groups": _KEYED
    + """, timed AS (SELECT *, epoch_us(updated_at) - epoch_us(created_at) AS waited FROM keyed)
SELECT stage, group_key, count(*) AS jobs, CAST(sum(attempts) AS BIGINT) AS attempts, min(created_at) AS first_at, max(updated_at) AS last_at,
  quantile_disc(waited, 0.5) AS waited_p50, quantile_disc(waited, 0.9) AS waited_p90, quantile_disc(waited, 0.99) AS waited_p99
FROM timed GROUP BY stage, group_key""",
}
