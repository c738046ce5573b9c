"""Queries over the job queue: depths, fairness, admission, leases, latest and previous rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.operators import budget, latest, merge
from lookout.operators.groups import effective_group
from lookout.sources.tables import table

#: The moment that the time-dependent queries take as now.
NOW = "2023-01-01 01:30:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _jobs(spark, d):
    """Job rows, the later version of those written twice."""
    rows = table(spark, d, "job_rows")
    order = [F.col("updated_at").desc_nulls_last(), F.col("status").asc_nulls_last(), F.col("attempts").desc_nulls_last(), F.to_json(F.struct("lease_token", "group_key", "payload_json", "last_error")).asc_nulls_last()]
    return latest.latest_by(rows, ["id"], order)


def queue_depths(spark, d):
    """Rows by stage, status and class."""
    return table(spark, d, "job_rows").groupBy("stage", "status", "queue_class").agg(F.count(F.lit(1)).alias("n")).orderBy("stage", "status", "queue_class")


def stage_outcomes(spark, d):
    return table(spark, d, "job_rows").groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("jobs"))


def deferred_due(spark, d):
    """Waiting rows and how many are due."""
    waiting = table(spark, d, "job_rows").where("status = 'pending'")
    return waiting.agg(F.count(F.lit(1)).alias("waiting"), F.count_if(F.col("available_at") <= _now()).alias("due"))


def top_groups(spark, d):
    """The five groups with most rows that wait."""
    waiting = table(spark, d, "job_rows").where("status = 'pending'").withColumn("k", effective_group(F.col("group_key"), F.col("payload_json"))).where("k is not null")
    return waiting.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "k").limit(5)


def groups_with_room(spark, d, allowance_strong=16, allowance_weak=4):
    """Groups with waiting rows whose running rows are fewer than the allowance of their best class."""
    rows = table(spark, d, "job_rows").select("stage", effective_group(F.col("group_key"), F.col("payload_json")).alias("k"), "status", "queue_class").where("k is not null")
    per = rows.groupBy("stage", "k").agg(
        F.count_if(F.col("status") == "pending").alias("waiting"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.min(F.when(F.col("status") == "pending", F.when(F.col("queue_class") == "strong", 0).otherwise(1))).alias("best"),
    )
    return per.where((F.col("waiting") > 0) & (F.col("running") < F.when(F.col("best") == 0, allowance_strong).otherwise(allowance_weak))).select("stage", "k", "waiting", "running")


def idle_snapshot(spark, d):
    """Counts of every status at once, and a map of waiting rows by stage."""
    rows = table(spark, d, "job_rows")
    by_stage = rows.groupBy("stage").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "failed")])
    waiting = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "pending"))))
    out = by_stage.agg(*[F.sum(s).alias(s) for s in ("running", "done", "failed")], F.to_json(waiting).alias("waiting_by_stage"))
    return out


def claim_order(spark, d, running_cap=2):
    """Due rows in the order in which they would be claimed, under a cap of running rows per group: class, the group served least lately, time, id."""
    rows = _jobs(spark, d).withColumn("k", F.coalesce(effective_group(F.col("group_key"), F.col("payload_json")), F.lit("")))
    rank = F.when(F.col("queue_class") == "strong", 0).otherwise(1)
    due = rows.where((F.col("status") == "pending") & (F.col("available_at") <= _now())).withColumn("rank", rank)
    # At most the cap of a group can be claimed: the top rows are cut before the shuffle, whatever the group holds.
    due = latest.top_per_key(due, ["stage", "k"], [F.col("rank"), F.col("available_at"), F.col("id")], running_cap, "place")
    served = F.max(F.when(F.col("status") != "pending", F.col("updated_at"))).alias("served")
    groups = rows.groupBy(F.col("stage").alias("_stage"), F.col("k").alias("_k")).agg(served, F.count_if(F.col("status") == "running").alias("running"))
    due = due.join(groups, (F.col("stage") == F.col("_stage")) & (F.col("k") == F.col("_k"))).where(F.col("place") <= F.lit(running_cap) - F.col("running"))
    return due.select("stage", "k", "id", "rank", "served").orderBy("rank", F.col("served").asc_nulls_first(), "available_at", "id")


def backlog_admission(spark, d):
    """Per group and class the waiting rows within the allowance, in order, with how many more wait.

    Only a group's first rows reach the ranking; the others are counted.
    """
    rows = _jobs(spark, d).where("status = 'pending'").withColumn("k", effective_group(F.col("group_key"), F.col("payload_json"))).where("k is not null")
    allow = F.when(F.col("queue_class") == "strong", 16).otherwise(4)
    group = ["stage", "k", "queue_class"]
    first = latest.top_per_key(rows, group, [F.col("created_at"), F.col("id")], 16, "place").where(F.col("place") <= allow)
    counted = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.col("stage").eqNullSafe(F.col("_stage")) & F.col("k").eqNullSafe(F.col("_k")) & F.col("queue_class").eqNullSafe(F.col("_queue_class"))
    return first.join(counted, same).select("id", *group, "place", F.greatest(F.col("_n") - allow, F.lit(0)).alias("left_over"))


def latest_job_per_key(spark, d):
    """The latest row per dedupe_key by id."""
    rows = table(spark, d, "job_rows").where("dedupe_key is not null").select("dedupe_key", "id", "created_at").distinct()
    return latest.latest_by(rows, ["dedupe_key"], [F.col("id").desc(), F.col("created_at").desc()])


def prefer_failed(spark, d):
    """Per case the latest failed job, else its latest job."""
    rows = _jobs(spark, d).withColumn("case_id", F.get_json_object("payload_json", "$.case_id").cast("long")).where("case_id is not null")
    return latest.preferring(rows.select("case_id", "id", "status", "stage"), ["case_id"], F.col("status") == "failed", [F.col("id").desc()])


def last_two_failed(spark, d):
    """Stage and group whose last two rows that aren't running both failed."""
    rows = _jobs(spark, d).where("status <> 'running'").withColumn("k", effective_group(F.col("group_key"), F.col("payload_json"))).where("k is not null")
    return latest.last_all(rows, ["stage", "k"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()], 2, F.col("status") == "failed")


def recent_failures(spark, d):
    return _jobs(spark, d).where("status = 'failed'").select("id", "stage", "updated_at", "last_error").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(20)


def live_keys(spark, d):
    """The first row of each dedupe_key among live ones: what an insert under a partial unique index keeps."""
    live = _jobs(spark, d).where("dedupe_key is not null and status in ('pending', 'running')").select("dedupe_key", "id")
    return latest.latest_by(live, ["dedupe_key"], [F.col("id").asc()])


def new_keys(spark, d):
    """Rows after noon whose dedupe_key no row before noon had: insert if absent."""
    rows = table(spark, d, "job_rows").where("dedupe_key is not null").select("dedupe_key", "id", "created_at").distinct()
    cut = F.col("created_at") < F.lit("2023-01-01 01:00:00").cast("timestamp")
    return merge.insert_new(rows.where(cut), rows.where(~cut), ["dedupe_key"], [F.col("created_at"), F.col("id")]).select("dedupe_key", "id")


def expired_leases(spark, d):
    """Running rows whose lease has run out, and what becomes of them."""
    rows = _jobs(spark, d).where((F.col("status") == "running") & (F.col("lease_expires_at") < _now()))
    return rows.select("id", "stage", "attempts", F.when(F.col("attempts") < F.col("max_attempts"), "pending").otherwise("failed").alias("becomes"))


def attempts_changed(spark, d):
    """Per case and stage the rounds at which attempts changed against the round before: append on change."""
    rows = _jobs(spark, d).select(F.get_json_object("payload_json", "$.case_id").cast("long").alias("case_id"), "stage", F.get_json_object("payload_json", "$.round").cast("int").alias("round"), "id", "attempts").where("case_id is not null and round is not null")
    return merge.changes_only(rows, ["case_id", "stage"], [F.col("round"), F.col("id")], F.col("attempts"), F.col("round"))


def previous_error(spark, d):
    """Failed rows with the last known error of an earlier row of the same stage and case."""
    rows = _jobs(spark, d).withColumn("case_id", F.get_json_object("payload_json", "$.case_id").cast("long")).where("case_id is not null")
    return latest.previous_known(rows, ["stage", "case_id"], [F.col("id")], "last_error", "before", F.floor(F.col("id") / 100_000)).where("status = 'failed'").select("id", "stage", "case_id", "last_error", "before")


def json_filter(spark, d):
    """Rows of round 1 with a registrable domain, by JSON path."""
    rows = table(spark, d, "job_rows").select("id", F.get_json_object("payload_json", "$.case_id").cast("long").alias("case_id"), F.get_json_object("payload_json", "$.round").cast("int").alias("round"), F.get_json_object("payload_json", "$.registrable_domain").alias("domain"))
    return rows.where("round = 1 and domain <> ''").select("id", "case_id", "domain").distinct()


def trailing_day_jobs(spark, d):
    """Per stage the rows created within the 24 hours up to the last creation: late updates come days after it."""
    rows = table(spark, d, "job_rows").select("stage", F.unix_micros("created_at").alias("at"))
    end = rows.agg(F.max("at")).first()[0]  # one value; null for an empty table
    return rows.where(F.col("at") > F.lit(end) - 24 * 3600 * 1_000_000).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def open_attempt_budget(spark, d):
    """Jobs of each stage in order of creation until their attempts add up to 500: a budget that stops."""
    rows = _jobs(spark, d).select("stage", "id", "created_at", "attempts")
    return budget.until_spent(rows, ["stage"], [F.col("created_at"), F.col("id")], "attempts", 500, F.date_trunc("minute", "created_at")).select("stage", "id")


QUERIES = {
    f.__name__: f
    for f in (
        queue_depths, stage_outcomes, deferred_due, top_groups, groups_with_room, idle_snapshot, claim_order, backlog_admission, latest_job_per_key, prefer_failed,
        last_two_failed, recent_failures, live_keys, new_keys, expired_leases, attempts_changed, previous_error, json_filter, trailing_day_jobs, open_attempt_budget,
    )
}

_KEY = "regexp_replace(lower(coalesce(nullif(group_key, ''), nullif(json_extract_string(payload_json, '$.registrable_domain'), ''), nullif(json_extract_string(payload_json, '$.name'), ''))), '\\.$', '')"
_K = f"WITH k AS (SELECT *, {_KEY} AS k FROM job_rows)\n"
_ONE = f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status ASC NULLS LAST, attempts DESC NULLS LAST) AS rn FROM job_rows),
j AS (SELECT *, {_KEY} AS k, CAST(json_extract_string(payload_json, '$.case_id') AS BIGINT) AS case_id, CAST(json_extract_string(payload_json, '$.round') AS INTEGER) AS round FROM placed WHERE rn = 1)
"""
_N = f"TIMESTAMPTZ '{NOW}+00'"

ORACLE = {
    "queue_depths": "SELECT stage, status, queue_class, count(*) AS n FROM job_rows GROUP BY ALL ORDER BY 1, 2, 3",
    "stage_outcomes": "SELECT stage, status, count(*) AS n, count(DISTINCT id) AS jobs FROM job_rows GROUP BY ALL",
    "deferred_due": f"SELECT count(*) AS waiting, count(*) FILTER (WHERE available_at <= {_N}) AS due FROM job_rows WHERE status = 'pending'",
    "top_groups": _K + "SELECT k, count(*) AS n FROM k WHERE status = 'pending' AND k IS NOT NULL GROUP BY k ORDER BY n DESC, k LIMIT 5",
    "groups_with_room": _K
    + """, per AS (SELECT stage, k, count(*) FILTER (WHERE status = 'pending') AS waiting, count(*) FILTER (WHERE status = 'running') AS running,
  min(CASE WHEN status = 'pending' THEN CASE WHEN queue_class = 'strong' THEN 0 ELSE 1 END END) AS best FROM k WHERE k IS NOT NULL GROUP BY stage, k)
SELECT stage, k, waiting, running FROM per WHERE waiting > 0 AND running < CASE WHEN best = 0 THEN 16 ELSE 4 END""",
    "idle_snapshot": """WITH s AS (SELECT stage, count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status = 'running') AS r,
  count(*) FILTER (WHERE status = 'done') AS d, count(*) FILTER (WHERE status = 'failed') AS f FROM job_rows GROUP BY stage)
SELECT CAST(sum(r) AS BIGINT) AS running, CAST(sum(d) AS BIGINT) AS done, CAST(sum(f) AS BIGINT) AS failed,
  '{' || string_agg('"' || stage || '":' || p, ',' ORDER BY stage) || '}' AS waiting_by_stage FROM s""",
    "claim_order": _ONE
    + f""", g AS (SELECT *, coalesce(k, '') AS kk FROM j),
m AS (SELECT *, max(CASE WHEN status <> 'pending' THEN updated_at END) OVER (PARTITION BY stage, kk) AS served,
  count(CASE WHEN status = 'running' THEN 1 END) OVER (PARTITION BY stage, kk) AS running, CASE WHEN queue_class = 'strong' THEN 0 ELSE 1 END AS rank FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY stage, kk ORDER BY rank, available_at, id) AS place FROM m WHERE status = 'pending' AND available_at <= {_N})
SELECT stage, kk AS k, id, rank, served FROM p WHERE place <= 2 - running ORDER BY rank, served ASC NULLS FIRST, available_at, id""",
    "backlog_admission": _ONE
    + """, p AS (SELECT id, stage, k, queue_class, row_number() OVER (PARTITION BY stage, k, queue_class ORDER BY created_at, id) AS place FROM j WHERE status = 'pending' AND k IS NOT NULL)
SELECT *, (SELECT greatest(count(*) - CASE WHEN p.queue_class = 'strong' THEN 16 ELSE 4 END, 0) FROM p o WHERE o.stage = p.stage AND o.k = p.k AND o.queue_class = p.queue_class) AS left_over
FROM p WHERE place <= CASE WHEN queue_class = 'strong' THEN 16 ELSE 4 END""",
    "latest_job_per_key": "SELECT dedupe_key, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id DESC, created_at DESC) AS rn FROM (SELECT DISTINCT dedupe_key, id, created_at FROM job_rows WHERE dedupe_key IS NOT NULL)) WHERE rn = 1",
    "prefer_failed": _ONE
    + "SELECT case_id, id, status, stage FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (status = 'failed') DESC, id DESC) AS place FROM j WHERE case_id IS NOT NULL) WHERE place = 1",
    "last_two_failed": _ONE
    + """, p AS (SELECT stage, k, status, row_number() OVER (PARTITION BY stage, k ORDER BY updated_at DESC NULLS LAST, id DESC) AS place FROM j WHERE status <> 'running' AND k IS NOT NULL)
SELECT stage, k FROM p WHERE place <= 2 GROUP BY stage, k HAVING count(*) = 2 AND count(*) FILTER (WHERE status = 'failed') = 2""",
    "recent_failures": _ONE + "SELECT id, stage, updated_at, last_error FROM j WHERE status = 'failed' ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 20",
    "live_keys": _ONE + "SELECT dedupe_key, min(id) AS id FROM j WHERE dedupe_key IS NOT NULL AND status IN ('pending', 'running') GROUP BY dedupe_key",
    "new_keys": """WITH r AS (SELECT DISTINCT dedupe_key, id, created_at FROM job_rows WHERE dedupe_key IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at, id) AS place FROM r WHERE NOT created_at < TIMESTAMPTZ '2023-01-01 01:00:00+00')
SELECT dedupe_key, id FROM p WHERE place = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM r WHERE created_at < TIMESTAMPTZ '2023-01-01 01:00:00+00')""",
    "expired_leases": _ONE + f"SELECT id, stage, attempts, CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS becomes FROM j WHERE status = 'running' AND lease_expires_at < {_N}",
    "attempts_changed": _ONE
    + """, o AS (SELECT case_id, stage, round, id, attempts, lag(attempts) OVER w AS b, row_number() OVER w AS place FROM j WHERE case_id IS NOT NULL AND round IS NOT NULL WINDOW w AS (PARTITION BY case_id, stage ORDER BY round, id))
SELECT case_id, stage, round, id, attempts FROM o WHERE place = 1 OR attempts IS DISTINCT FROM b""",
    "previous_error": _ONE
    + """, o AS (SELECT id, stage, case_id, last_error, status, last_value(last_error IGNORE NULLS) OVER (PARTITION BY stage, case_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j WHERE case_id IS NOT NULL)
SELECT id, stage, case_id, last_error, before FROM o WHERE status = 'failed'""",
    "json_filter": "SELECT DISTINCT id, CAST(json_extract_string(payload_json, '$.case_id') AS BIGINT) AS case_id, json_extract_string(payload_json, '$.registrable_domain') AS domain FROM job_rows WHERE CAST(json_extract_string(payload_json, '$.round') AS INTEGER) = 1 AND json_extract_string(payload_json, '$.registrable_domain') <> ''",
    "trailing_day_jobs": "SELECT stage, count(*) AS n FROM job_rows WHERE created_at > (SELECT max(created_at) FROM job_rows) - INTERVAL 24 HOUR GROUP BY stage",
    "open_attempt_budget": _ONE
    + "SELECT stage, id FROM (SELECT stage, id, sum(attempts) OVER (PARTITION BY stage ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS spent FROM j) WHERE spent <= 500",
}
