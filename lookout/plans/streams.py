"""Streaming queries, run over all that the tables hold, and queries of the matcher and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import names
from lookout.operators.matching import match_names
from lookout.session import fresh_path
from lookout.sources import registry, sinks
from lookout.sources.tables import table
from lookout.streaming import feeds, queue


def stream_hourly(spark, d):
    """Hourly counters of the certificate stream. The watermark never passes the last hour, so a late end mark closes it."""
    # Complete mode keeps every hour in state; the state is one row per hour.
    s = feeds.table_stream(spark, f"{d}/cert_messages.parquet")
    names_ = F.coalesce(F.size("data.leaf_cert.all_domains"), F.lit(0))
    update = F.col("message_type") == "certificate_update"
    per = s.groupBy(F.window("received_at", "1 hour")).agg(F.count(F.lit(1)).alias("messages"), F.count_if(update).alias("updates"), F.count_if(F.col("message_type") == "heartbeat").alias("heartbeats"), F.count_if(update & F.col("data.leaf_cert").isNull()).alias("malformed"), F.sum(F.when(names_ > 0, names_).otherwise(0)).alias("names"))
    out = feeds.run_to_end(per.select(F.col("window.start").alias("hour_start"), "messages", "updates", "heartbeats", "malformed", "names"), fresh_path(spark, "hourly"), "complete")
    return out.groupBy("hour_start").agg(*[F.max(c).alias(c) for c in ("messages", "updates", "heartbeats", "malformed", "names")])


def stream_host_counts(spark, d):
    """Names of certificates exploded in the stream, each host once per message, counted by last label."""
    s = feeds.certificate_hosts(feeds.table_stream(spark, f"{d}/cert_messages.parquet"))
    out = feeds.run_to_end(s, fresh_path(spark, "hosts"))
    return out.groupBy(F.element_at(F.split("host", r"\."), -1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def stream_gaps(spark, d):
    """Gaps over 60 s and skipped entries of every log, in the stream."""
    return feeds.gaps_to_end(feeds.table_stream(spark, f"{d}/cert_messages.parquet"), fresh_path(spark, "gaps"), 60)


def queue_folded(spark, d):
    """States of all jobs from the fold of their events, counted."""
    return queue.folded(queue.job_events(table(spark, d, "job_rows")), 4e9).groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def name_forms(spark, d):
    """Canonical host, skeleton and registrable domain of every observed name."""
    rows = names.with_forms(table(spark, d, "discovery_log").select("delivery_id", "name"), "name")
    return rows.select("delivery_id", *[F.col(f"forms.{c}").alias(c) for c in ("host", "unicode_host", "skeleton", "registrable_domain", "wildcard", "idn", "idn_invalid")])


def ascii_hosts(spark, d):
    """The canonical host of ASCII names without Python."""
    return table(spark, d, "discovery_log").where("name is not null").select("delivery_id", names.ascii_host(F.col("name")).alias("host"))


def name_matches(spark, d):
    """Names that match the registry of brand terms: strength, kinds of hits and notes."""
    terms = registry.from_terms(table(spark, d, "brand_terms"))
    rows = match_names(table(spark, d, "discovery_log").select("delivery_id", "name"), "name", terms)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("match.hits", lambda h: F.concat_ws(":", h["type"], h["keyword"])))), ",")
    return rows.where("match.candidate").select("delivery_id", "match.host", "match.strength", kinds.alias("hits"), F.array_join("match.notes", ",").alias("notes"))


def rendered_sites(spark, d):
    """A few facts of every site as lines within 20 tokens; a dropped line drops all later ones."""
    docs = table(spark, d, "documents").where("site is not null")
    facts = docs.groupBy("site").agg(F.count(F.lit(1)).alias("documents"), F.min("lang").alias("first_lang"), F.max("source").alias("last_source"), F.sum("n_chars").alias("chars"), F.max("case_id").alias("last_case"))
    return sinks.within_budget(facts, "site", ["documents", "chars", "first_lang", "last_source", "last_case"], 15)


QUERIES = {f.__name__: f for f in (stream_hourly, stream_host_counts, stream_gaps, queue_folded, name_forms, ascii_hosts, name_matches, rendered_sites)}

_HOURS = """SELECT date_trunc('hour', received_at) AS hour_start, count(*) AS messages, count(*) FILTER (WHERE message_type = 'certificate_update') AS updates,
  count(*) FILTER (WHERE message_type = 'heartbeat') AS heartbeats, count(*) FILTER (WHERE message_type = 'certificate_update' AND data.leaf_cert IS NULL) AS malformed,
  CAST(sum(coalesce(len(data.leaf_cert.all_domains), 0)) AS BIGINT) AS names FROM cert_messages GROUP BY 1"""
_HOST = "regexp_replace(regexp_replace(lower(name), '^\\*\\.', ''), '\\.+$', '')"

ORACLE = {
    "ascii_hosts": r"""WITH b AS (SELECT delivery_id, regexp_replace(regexp_replace(lower(trim(name)), '\.+$', ''), '^\*\.', '') AS h FROM discovery_log WHERE name IS NOT NULL)
SELECT delivery_id, CASE WHEN regexp_full_match(h, '[a-z0-9_-]{1,63}(\.[a-z0-9_-]{1,63})*') AND length(h) <= 253 AND NOT regexp_full_match(h, '[0-9]+(\.[0-9]+){3}') THEN h END AS host FROM b""",
    # Every claim but the last fails; the last ends by the row's status. A lease of 600 s has run out by the end of time.
    "queue_folded": """WITH j AS (SELECT id, max_by({'s': status, 'a': attempts}, {'u': updated_at, 's': status}) AS x FROM job_rows WHERE id IS NOT NULL AND created_at IS NOT NULL GROUP BY id),
f AS (SELECT x.s AS last, least(x.a, 3) AS attempts, x.a AS claims FROM j)
SELECT CASE WHEN attempts = 0 THEN 'pending' WHEN attempts = 3 AND claims > 3 THEN 'failed' WHEN last = 'done' THEN 'done' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS status, attempts, count(*) AS n FROM f GROUP BY ALL""",
    "stream_hourly": _HOURS,
    "stream_host_counts": f"""WITH x AS (SELECT msg_id, unnest(data.leaf_cert.all_domains) AS name FROM cert_messages WHERE data IS NOT NULL),
h AS (SELECT DISTINCT msg_id, {_HOST} AS host FROM x WHERE name IS NOT NULL)
SELECT regexp_extract(host, '([^.]*)$', 1) AS suffix, count(*) AS n FROM h WHERE host <> '' GROUP BY 1""",
    "stream_gaps": """WITH up AS (SELECT msg_id, received_at, data.source.name AS log, data.cert_index AS i FROM cert_messages WHERE data.source.name IS NOT NULL AND received_at IS NOT NULL),
g AS (SELECT log, msg_id, (epoch_us(received_at) - epoch_us(lag(received_at) OVER (PARTITION BY log ORDER BY received_at, msg_id))) / 1e6 AS amount FROM up),
s AS (SELECT log, msg_id, CAST(i - max(i) OVER (PARTITION BY log ORDER BY received_at, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS DOUBLE) AS amount FROM up)
SELECT log, 'gap' AS kind, msg_id, amount FROM g WHERE amount > 60 UNION ALL SELECT log, 'skipped', msg_id, amount FROM s WHERE amount > 0""",
    "rendered_sites": """WITH f AS (SELECT site, count(*) AS documents, min(lang) AS first_lang, max(source) AS last_source, CAST(sum(n_chars) AS BIGINT) AS chars, max(case_id) AS last_case FROM documents WHERE site IS NOT NULL GROUP BY site),
l AS (SELECT site, 0 AS i, 'documents: ' || documents AS line FROM f UNION ALL SELECT site, 1, 'chars: ' || chars FROM f UNION ALL SELECT site, 2, 'first_lang: ' || first_lang FROM f
  UNION ALL SELECT site, 3, 'last_source: ' || last_source FROM f UNION ALL SELECT site, 4, 'last_case: ' || last_case FROM f),
s AS (SELECT *, sum(ceil(length(line) / 4)) OVER (PARTITION BY site ORDER BY i ROWS UNBOUNDED PRECEDING) AS spent FROM l WHERE line IS NOT NULL)
SELECT site, string_agg(line, chr(10) ORDER BY i) AS rendered FROM s WHERE spent <= 15 GROUP BY site""",
}
