"""Queries over cases: list and filters, score history, deferred work, rechecks, ingest decisions, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import names
from lookout.operators import cases, latest
from lookout.operators.quotient import hex_id
from lookout.plans.queue import NOW, _jobs
from lookout.sources.tables import table


def _of_cases(spark, d):
    return cases.job_cases(_jobs(spark, d))


def _sightings(spark, d):
    """What was captured of a case counts as its sightings: the discovery log names no cases."""
    return table(spark, d, "documents").select("case_id", "source", F.col("captured_at").alias("observed_at"))


def _cases(spark, d):
    return cases.case_rows(_of_cases(spark, d), _sightings(spark, d))


_LISTED = ("case_id", "host", "domain", "strength", "status", "priority", "score", "round", "labels", "created_at", "scored_at", "first_seen", "last_seen", "sources")


def case_list(spark, d):
    """All cases with candidate, sources and latest score, in the order of a list."""
    rows = _cases(spark, d)
    return rows.orderBy(*cases.in_list_order(rows)).select(*_LISTED)


def case_filter(spark, d):
    """Closed strong cases of high priority with a page text, whose latest round fetched, from 00:30 on."""
    criteria = {"priority": ("P1", "P2", "P3"), "strength": "strong", "status": "closed", "source": "page_text", "label": "fetch", "since": "2023-01-01 00:30:00", "case_id": None}
    return cases.filtered(_cases(spark, d), criteria).select("case_id", "host", "priority", "score", "sources")


def case_top(spark, d):
    """The twenty cases at the head of the list: a top-k report."""
    rows = _cases(spark, d)
    return rows.orderBy(*cases.in_list_order(rows)).limit(20).select("case_id", "priority", "score")


def score_history(spark, d):
    """Every round of every case with the score before and whether the priority rose."""
    return cases.score_history(cases.round_scores(_of_cases(spark, d))).select("case_id", "round", "score", "priority", "before", "priority_before", "rose")


def _deferred(spark, d):
    """Deferred work; cases that an analyst noted something about are escalated."""
    return cases.deferred_jobs(_of_cases(spark, d), _sightings(spark, d).where("source = 'analyst_note'"))


def deferred_order(spark, d):
    """The deferred row of every group that moves first."""
    return latest.top_per_key(_deferred(spark, d), ["stage", "k"], cases.deferred_order(), 1).select("stage", "k", "id", "escalated", "not_before")


def promotion(spark, d):
    """Due deferred rows that move within the allowances of their groups, escalated ones in any case, at most 100 in a batch."""
    live = _of_cases(spark, d).where("status = 'running' or (status = 'pending' and round = 0)")
    live = live.groupBy("stage", F.coalesce(cases.effective_group(F.col("group_key"), F.col("payload_json")), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return cases.promoted(_deferred(spark, d), live, F.lit(NOW).cast("timestamp"), 100, strong=2, weak=1)


def rechecks_needed(spark, d):
    """Rechecks after one and seven days that cases still need in the fetch stage."""
    return cases.rechecks(_of_cases(spark, d), "fetch")


def escalated_groups(spark, d):
    """Groups with escalated deferred rows, or with room for their best class, and how many wait."""
    d_ = _deferred(spark, d)
    return d_.groupBy("stage", "k").agg(F.count(F.lit(1)).alias("waiting"), F.max(F.col("escalated")).alias("escalated"), F.min("not_before").alias("since")).where("escalated or waiting >= 2")


def stale_cases(spark, d):
    """Cases whose latest capture came after all their jobs."""
    jobs = _of_cases(spark, d).groupBy("case_id").agg(F.max("updated_at").alias("worked_at"))
    docs = table(spark, d, "documents").where("case_id is not null").groupBy("case_id").agg(F.max("captured_at").alias("captured_at"))
    return jobs.join(docs, "case_id").where("captured_at > worked_at")


def day_of_decisions(spark, d):
    """Per case the jobs finished within the 24 hours up to its last one, and the failed among them."""
    jobs = _of_cases(spark, d).where("status in ('done', 'failed') and updated_at is not null").select("case_id", "status", "updated_at")
    last = jobs.groupBy(F.col("case_id").alias("_c")).agg(F.max("updated_at").alias("_last"))
    near = jobs.join(last, F.col("case_id") == F.col("_c")).where(F.col("updated_at") > F.col("_last") - F.expr("interval 24 hours"))
    return near.groupBy("case_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))


def next_sweeps(spark, d):
    """Per sweep target its runs and when the next is due: a day after the first event of the latest run."""
    log = table(spark, d, "discovery_log").where("source = 'dnstwist' and logged_at is not null")
    runs = log.select(F.get_json_object("context_json", "$.target").alias("target"), F.get_json_object("context_json", "$.run_id").cast("long").alias("run_id"), "logged_at").where("target is not null and run_id is not null")
    per = runs.groupBy("target", "run_id").agg(F.min("logged_at").alias("began"))
    return per.groupBy("target").agg(F.count(F.lit(1)).alias("runs"), (F.max_by("began", "run_id") + F.expr("interval 1 day")).alias("due_at"))


def _host_events(spark, d):
    log = table(spark, d, "discovery_log").where(hex_id(F.col("event_id")).isNotNull())
    return log.select("delivery_id", "source", "observed_at", names.ascii_host(F.col("name")).alias("host"))


def ingest_decisions(spark, d):
    """What ingesting does with every delivery: a new candidate, a new source of one, a repeat, or none."""
    return cases.ingest_decisions(_host_events(spark, d), ["host"], "source", "observed_at", "delivery_id").select("delivery_id", "decision")


def opened_cases(spark, d):
    """Per host the cases that its sightings open when one that was quiet for ten minutes isn't reused."""
    rows = _host_events(spark, d).where("host is not null and observed_at is not null")
    return cases.opened(rows, ["host"], "observed_at", "delivery_id", 600).groupBy("host").agg(F.max("case_no").alias("cases"), F.count(F.lit(1)).alias("sightings"))


def job_outcomes(spark, d):
    """Jobs by stage and class of their last error."""
    return table(spark, d, "job_rows").groupBy("stage", cases.outcome(F.col("last_error")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def round_offsets(spark, d):
    """Per case and round the seconds from the case's first job to the round's first."""
    per = _of_cases(spark, d).where("created_at is not null").groupBy("case_id", "round").agg(F.min("created_at").alias("_at"))
    first = per.groupBy(F.col("case_id").alias("_c")).agg(F.min("_at").alias("_first"))
    return per.join(first, F.col("case_id") == F.col("_c")).select("case_id", "round", ((F.unix_micros("_at") - F.unix_micros("_first")) / 1e6).alias("offset_seconds"))


def json_truth(spark, d):
    """Jobs by whether fields of their payload are true in the sense of JSON."""
    rows = table(spark, d, "job_rows").select(*[cases.json_true(F.get_json_object("payload_json", f"$.{f}")).alias(f"has_{f}") for f in ("case_id", "registrable_domain", "round")])
    return rows.groupBy("has_case_id", "has_registrable_domain", "has_round").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        case_list, case_filter, case_top, score_history, deferred_order, promotion, rechecks_needed, escalated_groups, stale_cases, day_of_decisions, next_sweeps,
        ingest_decisions, opened_cases, job_outcomes, round_offsets, json_truth,
    )
}

_HOST = r"regexp_replace(regexp_replace(lower(trim(name)), '\.+$', ''), '^\*\.', '')"
_ASCII = rf"CASE WHEN regexp_full_match({_HOST}, '[a-z0-9_-]{{1,63}}(\.[a-z0-9_-]{{1,63}})*') AND length({_HOST}) <= 253 AND NOT regexp_full_match({_HOST}, '[0-9]+(\.[0-9]+){{3}}') THEN {_HOST} END"
_KEY = r"regexp_replace(lower(coalesce(nullif(group_key, ''), nullif(json_extract_string(payload_json, '$.registrable_domain'), ''), nullif(json_extract_string(payload_json, '$.name'), ''))), '\.$', '')"
_J = f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status ASC NULLS LAST, attempts DESC NULLS LAST) AS rn FROM job_rows),
j AS (SELECT *, TRY_CAST(json_extract_string(payload_json, '$.case_id') AS BIGINT) AS case_id, coalesce(TRY_CAST(json_extract_string(payload_json, '$.round') AS INTEGER), 0) AS round,
  nullif(lower(json_extract_string(payload_json, '$.name')), '') AS host, nullif(lower(json_extract_string(payload_json, '$.registrable_domain')), '') AS domain, coalesce({_KEY}, '') AS k
  FROM placed WHERE rn = 1 AND TRY_CAST(json_extract_string(payload_json, '$.case_id') AS BIGINT) IS NOT NULL),
sc AS (SELECT case_id, round, CAST(sum(coalesce(attempts, 0) + CASE WHEN status = 'failed' THEN 5 ELSE 0 END) AS BIGINT) AS score, max(updated_at) AS scored_at,
  '[' || string_agg(DISTINCT '"' || stage || '"', ',' ORDER BY '"' || stage || '"') || ']' AS labels FROM j GROUP BY case_id, round),
s AS (SELECT *, CASE WHEN score >= 15 THEN 'P1' WHEN score >= 8 THEN 'P2' WHEN score >= 3 THEN 'P3' ELSE 'P4' END AS priority FROM sc),
per AS (SELECT case_id, arg_max(host, (updated_at, id)) FILTER (WHERE host IS NOT NULL AND updated_at IS NOT NULL) AS host, arg_max(domain, (updated_at, id)) FILTER (WHERE domain IS NOT NULL AND updated_at IS NOT NULL) AS domain,
  min(CASE WHEN queue_class = 'strong' THEN 'strong' ELSE 'weak' END) AS strength, max(CASE WHEN status IN ('pending', 'running') THEN 'open' ELSE 'closed' END) AS status, min(created_at) AS created_at FROM j GROUP BY case_id),
seen AS (SELECT case_id AS h, min(captured_at) AS first_seen, max(captured_at) AS last_seen, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM documents WHERE case_id IS NOT NULL GROUP BY 1),
c AS (SELECT per.*, s.round, s.score, s.priority, s.scored_at, s.labels, first_seen, last_seen, sources FROM per
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round DESC) AS n FROM s) s ON s.case_id = per.case_id AND s.n = 1 LEFT JOIN seen ON seen.h = per.case_id)
"""
_D = (
    _J
    + """, manual AS (SELECT DISTINCT case_id AS h FROM documents WHERE source = 'analyst_note'),
d AS (SELECT id, stage, k, queue_class, created_at, available_at AS not_before, h IS NOT NULL AS escalated FROM j LEFT JOIN manual ON j.case_id = h WHERE status = 'pending' AND round > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY stage, k ORDER BY escalated DESC, CASE WHEN queue_class = 'strong' THEN 0 ELSE 1 END, not_before, created_at, id) AS p FROM d)
"""
)
_EVENTS = f"WITH e AS (SELECT delivery_id, source, observed_at, {_ASCII} AS host FROM discovery_log WHERE regexp_full_match(lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')), '[0-9a-f]{{64}}'))\n"
_N = f"TIMESTAMPTZ '{NOW}+00'"

ORACLE = {
    "case_list": _J + f"SELECT {', '.join(_LISTED)} FROM c ORDER BY priority NULLS LAST, score DESC NULLS LAST, case_id",
    "case_filter": _J
    + "SELECT case_id, host, priority, score, sources FROM c WHERE priority IN ('P1', 'P2', 'P3') AND strength = 'strong' AND status = 'closed' AND list_contains(string_split(sources, ','), 'page_text') AND contains(labels, '\"fetch\"') AND created_at >= TIMESTAMPTZ '2023-01-01 00:30:00+00'",
    "case_top": _J + "SELECT case_id, priority, score FROM c ORDER BY priority NULLS LAST, score DESC NULLS LAST, case_id LIMIT 20",
    "score_history": _J + "SELECT case_id, round, score, priority, lag(score) OVER w AS before, lag(priority) OVER w AS priority_before, coalesce(priority < lag(priority) OVER w, false) AS rose FROM s WINDOW w AS (PARTITION BY case_id ORDER BY round)",
    "deferred_order": _D + "SELECT stage, k, id, escalated, not_before FROM o WHERE p = 1",
    "promotion": _D
    + f""", live AS (SELECT stage, k, count(*) AS n FROM j WHERE status = 'running' OR (status = 'pending' AND round = 0) GROUP BY ALL),
due AS (SELECT id, stage, k, queue_class, escalated, not_before, row_number() OVER (PARTITION BY stage, k ORDER BY escalated DESC, CASE WHEN queue_class = 'strong' THEN 0 ELSE 1 END, not_before, created_at, id) AS p,
  max(escalated) OVER g AS top, min(not_before) OVER g AS since FROM d WHERE not_before <= {_N} WINDOW g AS (PARTITION BY stage, k)),
room AS (SELECT due.*, escalated OR coalesce(n, 0) + p - 1 < CASE WHEN queue_class = 'strong' THEN 2 ELSE 1 END AS fits FROM due LEFT JOIN live USING (stage, k)),
open AS (SELECT *, bool_and(fits) OVER (PARTITION BY stage, k ORDER BY p) AS ok FROM room)
SELECT row_number() OVER (ORDER BY top DESC, since, stage, k, p) AS place, id, stage, k, queue_class, escalated, not_before FROM open WHERE ok ORDER BY place LIMIT 100""",
    "rechecks_needed": _J
    + """, b AS (SELECT case_id, min(updated_at) AS began FROM j WHERE stage = 'fetch' AND round = 0 AND status = 'done' GROUP BY case_id),
w AS (SELECT case_id, 1 AS round, began + INTERVAL 1 DAY AS not_before FROM b UNION ALL SELECT case_id, 2, began + INTERVAL 7 DAY FROM b)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.stage = 'fetch' AND j.case_id = w.case_id AND j.round = w.round)""",
    "escalated_groups": _D + "SELECT stage, k, count(*) AS waiting, bool_or(escalated) AS escalated, min(not_before) AS since FROM d GROUP BY stage, k HAVING bool_or(escalated) OR count(*) >= 2",
    "stale_cases": _J
    + """, w AS (SELECT case_id, max(updated_at) AS worked_at FROM j GROUP BY case_id), dc AS (SELECT case_id, max(captured_at) AS captured_at FROM documents WHERE case_id IS NOT NULL GROUP BY case_id)
SELECT w.case_id, worked_at, captured_at FROM w JOIN dc USING (case_id) WHERE captured_at > worked_at""",
    "day_of_decisions": _J
    + """, f AS (SELECT case_id, status, updated_at, max(updated_at) OVER (PARTITION BY case_id) AS last FROM j WHERE status IN ('done', 'failed') AND updated_at IS NOT NULL)
SELECT case_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed FROM f WHERE updated_at > last - INTERVAL 24 HOUR GROUP BY case_id""",
    "next_sweeps": """WITH r AS (SELECT json_extract_string(context_json, '$.target') AS target, CAST(json_extract_string(context_json, '$.run_id') AS BIGINT) AS run_id, min(logged_at) AS began
  FROM discovery_log WHERE source = 'dnstwist' AND logged_at IS NOT NULL GROUP BY ALL)
SELECT target, count(*) AS runs, arg_max(began, run_id) + INTERVAL 1 DAY AS due_at FROM r WHERE target IS NOT NULL AND run_id IS NOT NULL GROUP BY target""",
    "ingest_decisions": _EVENTS
    + """SELECT delivery_id, CASE WHEN host IS NULL OR observed_at IS NULL THEN 'none' WHEN row_number() OVER (PARTITION BY host ORDER BY observed_at ASC NULLS LAST, delivery_id) = 1 THEN 'new'
  WHEN row_number() OVER (PARTITION BY host, source ORDER BY observed_at ASC NULLS LAST, delivery_id) = 1 THEN 'new_source' ELSE 'repeat' END AS decision FROM e""",
    "opened_cases": _EVENTS
    + """, g AS (SELECT host, observed_at - lag(observed_at) OVER (PARTITION BY host ORDER BY observed_at, delivery_id) AS gap FROM e WHERE host IS NOT NULL AND observed_at IS NOT NULL)
SELECT host, count(*) FILTER (WHERE gap IS NULL OR gap > INTERVAL 10 MINUTE) AS cases, count(*) AS sightings FROM g GROUP BY host""",
    "job_outcomes": """SELECT stage, CASE WHEN coalesce(trim(last_error), '') = '' THEN 'ok' WHEN regexp_matches(lower(last_error), 'timeout|timed out') THEN 'timeout' WHEN contains(last_error, 'refused') THEN 'refused'
  WHEN contains(last_error, 'reset') THEN 'reset' WHEN contains(last_error, 'lease') THEN 'lease' ELSE 'other' END AS outcome, count(*) AS n FROM job_rows GROUP BY ALL""",
    "round_offsets": _J + ", r AS (SELECT case_id, round, min(created_at) AS began FROM j WHERE created_at IS NOT NULL GROUP BY ALL) SELECT case_id, round, (epoch_us(began) - epoch_us(min(began) OVER (PARTITION BY case_id))) / 1e6 AS offset_seconds FROM r",
    "json_truth": """SELECT coalesce(CAST(json_extract_string(payload_json, '$.case_id') AS BIGINT) <> 0, false) AS has_case_id, coalesce(json_extract_string(payload_json, '$.registrable_domain') <> '', false) AS has_registrable_domain,
  coalesce(CAST(json_extract_string(payload_json, '$.round') AS BIGINT) <> 0, false) AS has_round, count(*) AS n FROM job_rows GROUP BY ALL""",
}
