"""Queries over discovery events, certificate messages, replays and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lookout.operators import budget, latest, merge, quotient
from lookout.session import materialize
from lookout.sources.tables import table


def _host():
    """The observed name in lower case, without a leading wildcard and dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower("name"), r"\A\*\.", ""), r"\.+\z", "")


def _events(spark, d):
    """One row per event, with its host."""
    log = quotient.first_copies(table(spark, d, "discovery_log"), "event_id", "observed_at", "delivery_id")
    return log.withColumn("host", _host())


def candidate_rollup(spark, d):
    """Per host first and last sighting, number of events, and strong if any is manual or from a sweep."""
    ev = _events(spark, d).where("host is not null")
    return merge.sightings(ev, ["host"], "observed_at", F.col("source").isin("manual", "dnstwist"))


def source_rollup(spark, d):
    ev = _events(spark, d).where("host is not null")
    return ev.groupBy("host", "source").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("observations"))


def candidates_by_source(spark, d):
    return _events(spark, d).where("host is not null").groupBy("source").agg(F.countDistinct("host").alias("hosts"), F.count(F.lit(1)).alias("events"))


def sources_of_host(spark, d):
    """Hosts of several sources, with the ordered list of them."""
    ev = _events(spark, d).where("host is not null and source is not null")
    per = ev.groupBy("host").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return per.where(F.size("s") > 1).select("host", F.array_join("s", ",").alias("sources"))


def hosts_seen_by_sweep(spark, d):
    """Hosts from certificates that a sweep also found: a semi-join, as flags of one pass."""
    return _by_sources(spark, d).where("certstream and dnstwist").select("host")


def _by_sources(spark, d):
    """Hosts with a flag for every source that saw them: one pass instead of a join of the log with itself."""
    ev = _events(spark, d).where("host is not null")
    return ev.groupBy("host").agg(*[F.coalesce(F.bool_or(F.col("source") == s), F.lit(False)).alias(s) for s in ("certstream", "dnstwist", "manual")])


def hosts_not_swept(spark, d):
    """Hosts named by hand that no sweep found: an anti-join."""
    return _by_sources(spark, d).where("manual and not dnstwist").select("host")


def recent_events(spark, d):
    """The three newest events per host, newest first, ties by event id."""
    ev = _events(spark, d).where("host is not null").withColumn("event", quotient.hex_id(F.col("event_id")))
    top = latest.top_per_key(ev, ["host"], [F.col("observed_at").desc_nulls_last(), F.col("event")], 3, "place")
    return top.select("host", "place", "event", "observed_at")


def replay_idempotent(spark, d):
    """Rollups of two overlapping batches merged as one rollup of all: the merge is order-insensitive."""
    ev = materialize(_events(spark, d).where("host is not null").select("host", "source", "observed_at", "delivery_id"), "events")
    strong = F.col("source").isin("manual", "dnstwist")
    cut = F.pmod("delivery_id", F.lit(2)) == 0
    parts = [merge.sightings(ev.where(c), ["host"], "observed_at", strong) for c in (cut, ~cut)]
    return merge.merged_sightings(parts, ["host"])


def sweep_change(spark, d):
    """Per target and run of the sweeps the hosts that are new or gone against the run before; none for a first run."""
    ev = _events(spark, d).where("source = 'dnstwist' and host is not null")
    ev = ev.select(F.get_json_object("context_json", "$.target").alias("target"), F.get_json_object("context_json", "$.run_id").cast("long").alias("run_id"), "host").where("target is not null and run_id is not null")
    runs = ev.groupBy("target", "run_id").agg(F.collect_set("host").alias("hosts"))
    changed = merge.set_change(runs, ["target"], [F.col("run_id")], "hosts")
    return changed.select("target", "run_id", F.size("hosts").alias("hosts"), F.array_join("added", ",").alias("added"), F.size("removed").alias("removed"))


def context_by_source(spark, d):
    """JSON fields by source: which contexts lack theirs or aren't JSON."""
    log = table(spark, d, "discovery_log")
    kind = F.get_json_object("context_json", "$.kind")
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(kind.isNull()).alias("without_kind"), F.count_if(kind.eqNullSafe(F.col("source"))).alias("agree"))


def log_lateness(spark, d):
    """Rows by how late they were logged, in hours."""
    late = F.floor((F.unix_micros("logged_at") - F.unix_micros("observed_at")) / 3_600_000_000).cast("long")
    return table(spark, d, "discovery_log").where("observed_at is not null and logged_at is not null").groupBy(late.alias("hours")).agg(F.count(F.lit(1)).alias("n"))


def segments_since(spark, d):
    """Segments of an hour or later by the period in their name: pruning by name, then counts."""
    log = table(spark, d, "discovery_log").where(F.substring("segment", 1, 11) >= "20230101T01")
    return log.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def latest_run_per_segment(spark, d):
    runs = table(spark, d, "replay_runs").where("records is not null")
    return latest.latest_by(runs, ["segment"], [F.col("started_at").desc(), F.col("run_id").desc()]).select("segment", "run_id", "records", "duplicates")


def unreplayed_segments(spark, d):
    """Segments without a complete run, and what their log holds."""
    done = table(spark, d, "replay_runs").where("records is not null").select("segment").distinct()
    return table(spark, d, "discovery_log").join(done, "segment", "left_anti").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def abandoned_runs(spark, d):
    """Runs by state: those without counts that a later run of the segment made up for, or not."""
    runs = table(spark, d, "replay_runs")
    good = runs.where("records is not null").groupBy("segment").agg(F.max("started_at").alias("_good"))
    joined = runs.join(good, "segment", "left")
    state = F.when(F.col("records").isNotNull(), "ok").when(F.col("_good") > F.col("started_at"), "made up").otherwise("abandoned")
    return joined.select("run_id", "segment", state.alias("state"))


def _updates(spark, d):
    m = table(spark, d, "cert_messages").where("message_type = 'certificate_update' and data is not null")
    return m.select("msg_id", "received_at", F.col("data.leaf_cert.all_domains").alias("names"), F.col("data.source.name").alias("log"), F.col("data.cert_index").alias("cert_index"), F.coalesce(F.nullif(F.col("data.leaf_cert.fingerprint"), F.lit("")), F.nullif(F.col("data.leaf_cert.sha256"), F.lit(""))).alias("key"), F.col("data.leaf_cert.serial_number").alias("serial"), F.col("data.leaf_cert.not_before").alias("not_before"))


def feed_gaps(spark, d):
    """Times without any message for more than 15 seconds."""
    return budget.gaps(table(spark, d, "cert_messages"), [], "received_at", "msg_id", 15)


def log_gaps(spark, d):
    """The same for every certificate log, over 60 seconds."""
    return budget.gaps(_updates(spark, d).where("log is not null"), ["log"], "received_at", "msg_id", 60)


def gap_seconds(spark, d):
    """Seconds without messages (gaps over 15 s) within half an hour."""
    spans = feed_gaps(spark, d)
    return budget.clipped_seconds(spans, "gap_start", "gap_end", F.lit("2023-01-01 00:30:00").cast("timestamp"), F.lit("2023-01-01 01:00:00").cast("timestamp"))


def index_jumps(spark, d):
    """Entries of a log that were skipped: index minus the largest index before, minus one."""
    rows = _updates(spark, d).where("log is not null and cert_index is not null")
    run = latest.running_max_before(rows, ["log"], "msg_id", "cert_index", "last_index")
    return run.withColumn("skipped", F.col("cert_index") - F.col("last_index") - 1).where("skipped > 0").select("msg_id", "log", "cert_index", "skipped")


def hourly_counters(spark, d):
    """Messages of every hour by kind."""
    m = table(spark, d, "cert_messages")
    ok = F.col("message_type") == "certificate_update"
    names = F.coalesce(F.size("data.leaf_cert.all_domains"), F.lit(0))
    return m.groupBy(F.date_trunc("hour", "received_at").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(ok).alias("updates"),
        F.count_if(F.col("message_type") == "heartbeat").alias("heartbeats"),
        F.count_if(ok & F.col("data.leaf_cert").isNull()).alias("malformed"),
        F.sum(F.when(names > 0, names).otherwise(0)).alias("names"),
    )


def certificate_identity(spark, d):
    """Messages by the kind of identity they have: key, derived from serial, start and names, or none."""
    m = _updates(spark, d)
    derived = F.when(F.col("serial").isNotNull() & F.col("names").isNotNull(), F.concat(F.lit("derived:"), F.sha2(F.concat_ws("\u001f", "serial", F.coalesce(F.col("not_before").cast("long").cast("string"), F.lit("")), F.array_join("names", ",")), 256)))
    return m.select("msg_id", F.coalesce("key", derived).alias("identity"))


def certificate_hosts(spark, d):
    """Hosts of certificates, each once per certificate, at the certificate's first message; and whether it is the first host."""
    m = _updates(spark, d).where("key is not null and names is not null")
    rows = m.select("key", "msg_id", F.explode("names").alias("name")).withColumn("host", _host()).where("host is not null")
    first = rows.groupBy("key", "host").agg(F.min("msg_id").alias("msg_id"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("msg_id", "host"))
    return first.withColumn("keeps_names", place == 1)


def wide_certificates(spark, d):
    """Certificates with most different names, names capped to the first 5 in order."""
    m = _updates(spark, d).where("key is not null and names is not null")
    n = latest.latest_by(m, ["key"], [F.col("msg_id")]).withColumn("n", F.size(F.array_distinct("names")))
    return n.select("key", "n", F.array_join(F.slice("names", 1, 5), " ").alias("names")).orderBy(F.col("n").desc(), "key").limit(25)


def counters_checked(spark, d):
    """Recorded counters against the messages of the hour."""
    real = hourly_counters(spark, d)
    kept = table(spark, d, "hourly_counters").select("hour_start", "certificates", F.col("malformed").alias("recorded_malformed"))
    return real.join(kept, "hour_start", "full").select("hour_start", "updates", "certificates", (F.coalesce("updates", F.lit(0)) - F.coalesce("certificates", F.lit(0))).alias("missing"))


def as_of_replay(spark, d):
    """For every delivery the latest replay run of its segment that started before it was logged."""
    runs = table(spark, d, "replay_runs").select("segment", "started_at", "run_id")
    log = table(spark, d, "discovery_log").select("delivery_id", "segment", (F.col("logged_at") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return latest.as_of(log, runs, ["segment"], "at", "started_at", ["run_id"], bucket_seconds=600).select("delivery_id", "run_id")


def segment_retention(spark, d):
    """Segments beyond a size of 1,000 rows, oldest first to go."""
    sizes = table(spark, d, "discovery_log").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return merge.oldest_beyond(sizes, "n", [F.col("segment").desc()], 1000)


QUERIES = {
    f.__name__: f
    for f in (
        candidate_rollup, source_rollup, candidates_by_source, sources_of_host, hosts_seen_by_sweep, hosts_not_swept, recent_events, replay_idempotent, sweep_change,
        context_by_source, log_lateness, segments_since, latest_run_per_segment, unreplayed_segments, abandoned_runs, feed_gaps, log_gaps, gap_seconds, index_jumps,
        hourly_counters, certificate_identity, certificate_hosts, wide_certificates, counters_checked, as_of_replay, segment_retention,
    )
}

_HOST = "regexp_replace(regexp_replace(lower(name), '^\\*\\.', ''), '\\.+$', '')"
_EV = f"""WITH bare AS (SELECT *, lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')) AS event FROM discovery_log),
placed AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY observed_at ASC NULLS LAST, delivery_id) AS rn FROM bare WHERE regexp_full_match(coalesce(event, ''), '[0-9a-f]{{64}}')),
ev AS (SELECT *, {_HOST} AS host FROM placed WHERE rn = 1)
"""
_UP = """WITH up AS (SELECT msg_id, received_at, data.leaf_cert.all_domains AS names, data.source.name AS log, data.cert_index AS cert_index,
  coalesce(nullif(data.leaf_cert.fingerprint, ''), nullif(data.leaf_cert.sha256, '')) AS key, data.leaf_cert.serial_number AS serial, data.leaf_cert.not_before AS not_before
  FROM cert_messages WHERE message_type = 'certificate_update' AND data IS NOT NULL)
"""
_ROLL = "min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS observations"
_GAP = """, gap AS (SELECT {keys} lag(received_at) OVER (PARTITION BY {part} ORDER BY received_at, msg_id) AS gap_start, received_at AS gap_end FROM {rows}),
g AS (SELECT *, (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 AS seconds FROM gap)
"""
_STRONG = "CASE WHEN max(CASE WHEN source IN ('manual', 'dnstwist') THEN 1 ELSE 0 END) = 1 THEN 'strong' ELSE 'weak' END AS strength"
_HOURS = """SELECT date_trunc('hour', received_at) AS hour_start, count(*) AS messages, count(*) FILTER (WHERE message_type = 'certificate_update') AS updates,
  count(*) FILTER (WHERE message_type = 'heartbeat') AS heartbeats, count(*) FILTER (WHERE message_type = 'certificate_update' AND data.leaf_cert IS NULL) AS malformed,
  CAST(sum(coalesce(len(data.leaf_cert.all_domains), 0)) AS BIGINT) AS names FROM cert_messages GROUP BY 1"""
_FEED = "WITH x AS (SELECT 1)" + _GAP.format(keys="", part="1", rows="cert_messages")

ORACLE = {
    "candidate_rollup": _EV + f"SELECT host, {_ROLL}, {_STRONG} FROM ev WHERE host IS NOT NULL GROUP BY host",
    "source_rollup": _EV + f"SELECT host, source, {_ROLL} FROM ev WHERE host IS NOT NULL GROUP BY host, source",
    "candidates_by_source": _EV + "SELECT source, count(DISTINCT host) AS hosts, count(*) AS events FROM ev WHERE host IS NOT NULL GROUP BY source",
    "sources_of_host": _EV + "SELECT host, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ev WHERE host IS NOT NULL AND source IS NOT NULL GROUP BY host HAVING count(DISTINCT source) > 1",
    "hosts_seen_by_sweep": _EV + "SELECT DISTINCT host FROM ev WHERE source = 'certstream' AND host IN (SELECT host FROM ev WHERE source = 'dnstwist')",
    "hosts_not_swept": _EV + "SELECT DISTINCT host FROM ev WHERE source = 'manual' AND host IS NOT NULL AND host NOT IN (SELECT host FROM ev WHERE source = 'dnstwist' AND host IS NOT NULL)",
    "recent_events": _EV + "SELECT host, place, event, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY observed_at DESC NULLS LAST, event) AS place FROM ev WHERE host IS NOT NULL) WHERE place <= 3",
    "replay_idempotent": _EV + f"SELECT host, {_ROLL}, {_STRONG} FROM ev WHERE host IS NOT NULL GROUP BY host",
    "sweep_change": _EV
    + """, sw AS (SELECT DISTINCT json_extract_string(context_json, '$.target') AS target, CAST(json_extract_string(context_json, '$.run_id') AS BIGINT) AS run_id, host FROM ev WHERE source = 'dnstwist' AND host IS NOT NULL),
r AS (SELECT target, run_id, count(*) AS hosts, lag(run_id) OVER (PARTITION BY target ORDER BY run_id) AS before FROM sw WHERE target IS NOT NULL AND run_id IS NOT NULL GROUP BY target, run_id),
a AS (SELECT r.target, r.run_id, string_agg(s.host, ',' ORDER BY s.host) AS added FROM r JOIN sw s ON s.target = r.target AND s.run_id = r.run_id
  WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sw b WHERE b.target = r.target AND b.run_id = r.before AND b.host = s.host) GROUP BY 1, 2),
g AS (SELECT r.target, r.run_id, count(*) AS removed FROM r JOIN sw b ON b.target = r.target AND b.run_id = r.before
  WHERE NOT EXISTS (SELECT 1 FROM sw s WHERE s.target = r.target AND s.run_id = r.run_id AND s.host = b.host) GROUP BY 1, 2)
SELECT r.target, r.run_id, r.hosts, coalesce(added, '') AS added, coalesce(removed, 0) AS removed FROM r LEFT JOIN a ON a.target = r.target AND a.run_id = r.run_id LEFT JOIN g ON g.target = r.target AND g.run_id = r.run_id""",
    "context_by_source": """WITH c AS (SELECT source, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.kind') END AS kind FROM discovery_log)
SELECT source, count(*) AS n, count(*) FILTER (WHERE kind IS NULL) AS without_kind, count(*) FILTER (WHERE kind IS NOT DISTINCT FROM source) AS agree FROM c GROUP BY source""",
    "log_lateness": "SELECT CAST(floor((epoch_us(logged_at) - epoch_us(observed_at)) / 3600000000) AS BIGINT) AS hours, count(*) AS n FROM discovery_log WHERE observed_at IS NOT NULL AND logged_at IS NOT NULL GROUP BY 1",
    "segments_since": "SELECT segment, count(*) AS n FROM discovery_log WHERE substr(segment, 1, 11) >= '20230101T01' GROUP BY segment",
    "latest_run_per_segment": "SELECT segment, run_id, records, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY started_at DESC, run_id DESC) AS rn FROM replay_runs WHERE records IS NOT NULL) WHERE rn = 1",
    "unreplayed_segments": "SELECT segment, count(*) AS n FROM discovery_log WHERE segment NOT IN (SELECT segment FROM replay_runs WHERE records IS NOT NULL) GROUP BY segment",
    "abandoned_runs": """SELECT r.run_id, r.segment, CASE WHEN r.records IS NOT NULL THEN 'ok' WHEN g.good > r.started_at THEN 'made up' ELSE 'abandoned' END AS state
FROM replay_runs r LEFT JOIN (SELECT segment, max(started_at) AS good FROM replay_runs WHERE records IS NOT NULL GROUP BY segment) g ON g.segment = r.segment""",
    "feed_gaps": _FEED + "SELECT * FROM g WHERE seconds > 15",
    "log_gaps": _UP + _GAP.format(keys="log,", part="log", rows="(SELECT * FROM up WHERE log IS NOT NULL)") + "SELECT * FROM g WHERE seconds > 60",
    "gap_seconds": _FEED
    + """, c AS (SELECT greatest(epoch_us(gap_start), epoch_us(TIMESTAMPTZ '2023-01-01 00:30:00+00')) AS a, least(epoch_us(gap_end), epoch_us(TIMESTAMPTZ '2023-01-01 01:00:00+00')) AS b FROM g WHERE seconds > 15)
SELECT coalesce(sum(greatest(b - a, 0)), 0) / 1e6 AS seconds FROM c""",
    "index_jumps": _UP
    + """, m AS (SELECT msg_id, log, cert_index, cert_index - max(cert_index) OVER (PARTITION BY log ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS skipped FROM up WHERE log IS NOT NULL AND cert_index IS NOT NULL)
SELECT * FROM m WHERE skipped > 0""",
    "hourly_counters": _HOURS,
    "certificate_identity": _UP
    + """SELECT msg_id, coalesce(key, CASE WHEN serial IS NOT NULL AND names IS NOT NULL THEN 'derived:' || sha256(serial || chr(31) || coalesce(CAST(CAST(not_before AS BIGINT) AS VARCHAR), '') || chr(31) || array_to_string(names, ',')) END) AS identity FROM up""",
    "certificate_hosts": _UP
    + f""", x AS (SELECT key, msg_id, unnest(names) AS name FROM up WHERE key IS NOT NULL AND names IS NOT NULL),
f AS (SELECT key, {_HOST} AS host, min(msg_id) AS msg_id FROM x WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY key ORDER BY msg_id, host) = 1 AS keeps_names FROM f""",
    "wide_certificates": _UP
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY msg_id) AS rn FROM up WHERE key IS NOT NULL AND names IS NOT NULL)
SELECT key, CAST(len(list_distinct(names)) AS INTEGER) AS n, array_to_string(names[1:5], ' ') AS names FROM f WHERE rn = 1 ORDER BY n DESC, key LIMIT 25""",
    "counters_checked": f"WITH h AS ({_HOURS}) SELECT coalesce(h.hour_start, c.hour_start) AS hour_start, updates, certificates, coalesce(updates, 0) - coalesce(certificates, 0) AS missing FROM h FULL JOIN hourly_counters c ON c.hour_start = h.hour_start",
    "as_of_replay": """SELECT delivery_id, (SELECT max_by(run_id, struct_pack(a := started_at, b := run_id)) FROM replay_runs r WHERE r.segment = l.segment AND r.started_at <= l.logged_at + INTERVAL 30 MINUTE) AS run_id FROM discovery_log l""",
    "segment_retention": "SELECT segment, n FROM (SELECT segment, n, sum(n) OVER (ORDER BY segment DESC ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT segment, count(*) AS n FROM discovery_log GROUP BY segment)) WHERE t > 1000",
}
