"""Cases: one row per case from its jobs and sightings, dynamic filters, order, score history, deferred work and rechecks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators import budget, latest
from lookout.operators.groups import effective_group

#: Priorities in the order of a list; a case without one comes last.
PRIORITIES = ("P1", "P2", "P3", "P4")


def job_cases(jobs: DataFrame) -> DataFrame:
    """The job rows of cases with their payload's fields: case_id, round, host, domain; rows without a case are left out."""
    field = lambda f, kind: F.get_json_object("payload_json", f"$.{f}").try_cast(kind)
    rows = jobs.withColumns({"case_id": field("case_id", "bigint"), "round": F.coalesce(field("round", "int"), F.lit(0)), "host": F.nullif(F.lower(field("name", "string")), F.lit("")), "domain": F.nullif(F.lower(field("registrable_domain", "string")), F.lit(""))})
    return rows.where("case_id is not null")


def round_scores(jobs: DataFrame) -> DataFrame:
    """case_id, round, score, priority, scored_at, labels (JSON list): what the jobs of a round add up to.

    A round counts an attempt as 1 and a failed job as 5 more; 15 and more is P1, 8 P2, 3 P3, else P4.
    """
    per = jobs.groupBy("case_id", "round").agg(
        F.sum(F.coalesce("attempts", F.lit(0)) + F.when(F.col("status") == "failed", 5).otherwise(0)).alias("score"),
        F.max("updated_at").alias("scored_at"),
        F.to_json(F.array_sort(F.collect_set("stage"))).alias("labels"),
    )
    rank = F.when(F.col("score") >= 15, "P1").when(F.col("score") >= 8, "P2").when(F.col("score") >= 3, "P3").otherwise("P4")
    return per.withColumn("priority", rank)


def score_history(scores: DataFrame) -> DataFrame:
    """Adds the score and priority of the round before (``before``, ``priority_before``) and whether the priority rose.

    A case has few rounds, and rounds of a case are one row each, so no window holds more.
    """
    w = Window.partitionBy("case_id").orderBy("round")
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return scores.withColumn("before", F.lag("score").over(w)).withColumn("priority_before", F.lag("priority").over(w)).withColumn("rose", F.coalesce(order < F.lag(order).over(w), F.lit(False)))


def case_rows(jobs: DataFrame, sightings: DataFrame) -> DataFrame:
    """One row per case: case_id, host, domain, strength, status, created_at, round, score, priority, scored_at, labels, first_seen, last_seen, sources.

    jobs: of :func:`job_cases`. sightings: case_id, source, observed_at. A case's host and domain are those of its latest job
    that names them; it is open while a job waits or runs. A case without sightings has null for them, and no sources.
    """
    at = F.struct("updated_at", "id")
    per = jobs.groupBy("case_id").agg(
        F.max_by("host", F.when(F.col("host").isNotNull(), at)).alias("host"),
        F.max_by("domain", F.when(F.col("domain").isNotNull(), at)).alias("domain"),
        F.min(F.when(F.col("queue_class") == "strong", "strong").otherwise("weak")).alias("strength"),
        F.max(F.when(F.col("status").isin("pending", "running"), "open").otherwise("closed")).alias("status"),
        F.min("created_at").alias("created_at"),
    )
    last = latest.latest_by(round_scores(jobs), ["case_id"], [F.col("round").desc()])
    seen = sightings.where("case_id is not null").groupBy(F.col("case_id").alias("_case")).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return per.join(last, "case_id", "left").join(seen, F.col("case_id") == F.col("_case"), "left").drop("_case")


def filtered(cases: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Cases that meet every criterion given; a criterion that is None or empty asks for nothing.

    priority: any of these; strength, status: equal; since: created at or after; source: one of the case's sources; label:
    a member of the JSON list ``labels``; case_id: this one. An unknown criterion is an error.
    """
    among = lambda value: [value] if isinstance(value, str) else list(value)
    makers = {
        "priority": lambda v: F.col("priority").isin(*among(v)),
        "strength": lambda v: F.col("strength") == v,
        "status": lambda v: F.col("status") == v,
        "since": lambda v: F.col("created_at") >= F.lit(v).cast("timestamp"),
        "source": lambda v: F.array_contains(F.split("sources", ","), v),
        "label": lambda v: json_has(F.col("labels"), v),
        "case_id": lambda v: F.col("case_id") == v,
    }
    unknown = set(criteria) - set(makers)
    if unknown:
        raise ValueError(f"unknown criteria {sorted(unknown)}")
    conditions = [makers[k](v) for k, v in criteria.items() if v not in (None, "", ())]
    return reduce(lambda df, c: df.where(c), conditions, cases)


def json_has(json_list: Column, value: str) -> Column:
    """Whether a JSON list of strings has the member; false for null and for what is no list."""
    return F.coalesce(F.array_contains(F.from_json(json_list, "array<string>"), value), F.lit(False))


def json_true(value: Column) -> Column:
    """JSON truth: false for null, false, 0, the empty string, list and object, and missing values."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def in_list_order(cases: DataFrame) -> list[Column]:
    """The order of a case list: priority, score from the highest, id."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return [F.when(F.coalesce(place, F.lit(0)) == 0, len(PRIORITIES) + 1).otherwise(place), F.col("score").desc_nulls_last(), F.col("case_id")]


def deferred_order(escalated: str = "escalated", due: str = "not_before", tie: Sequence[str] = ("created_at", "id")) -> list[Column]:
    """The order in which deferred rows of a group move: escalated ones, strong ones, those due longest."""
    return [F.col(escalated).cast("int").desc(), F.when(F.col("queue_class") == "strong", 0).otherwise(1), F.col(due), *[F.col(c) for c in tie]]


def promoted(deferred: DataFrame, live: DataFrame, now: Column, batch: int, strong: int = 16, weak: int = 4) -> DataFrame:
    """Deferred rows that move into the queue now, with ``place`` in the order of moving.

    deferred: id, stage, k, queue_class, not_before, created_at, escalated. live: stage, k and n, the rows of the group in
    the queue. A group's due rows move in :func:`deferred_order` while the group has fewer live rows than the row's class
    allows; escalated ones move in any case. Groups take turns by their most urgent row, and at most ``batch`` rows move.

    No group has more than its allowance of rows that aren't escalated, or ``batch`` rows in all, in the ranking.
    """
    due = deferred.where(F.col("not_before") <= now)
    ranked = latest.top_per_key(due, ["stage", "k"], deferred_order(), batch, "_place")
    counts = live.select(F.col("stage").alias("_s"), F.col("k").alias("_k"), "n")
    joined = ranked.join(counts, (F.col("stage") == F.col("_s")) & (F.col("k") == F.col("_k")), "left")
    room = F.coalesce("n", F.lit(0)) + F.col("_place") - 1 < F.when(F.col("queue_class") == "strong", strong).otherwise(weak)
    # The first row without room ends a group's turn: rows after it, none of which is escalated, stay too.
    w = Window.partitionBy("stage", "k").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moving = joined.withColumn("_open", F.min((F.col("escalated") | room).cast("int")).over(w)).where("_open = 1")
    groups = due.groupBy(F.col("stage").alias("_s2"), F.col("k").alias("_k2")).agg(F.max(F.col("escalated").cast("int")).alias("_top"), F.min("not_before").alias("_since"))
    turns = moving.join(groups, (F.col("stage") == F.col("_s2")) & (F.col("k") == F.col("_k2")))
    order = [F.col("_top").desc(), F.col("_since"), F.col("stage"), F.col("k"), F.col("_place")]
    first = turns.orderBy(*order).limit(batch)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "id", "stage", "k", "queue_class", "escalated", "not_before")


def deferred_jobs(jobs: DataFrame, escalated: DataFrame) -> DataFrame:
    """The waiting rows of later rounds as deferred work, due when available; escalated if the case is in ``escalated`` (case_id)."""
    waiting = jobs.where("status = 'pending' and round > 0").withColumn("k", F.coalesce(effective_group(F.col("group_key"), F.col("payload_json")), F.lit("")))
    marked = escalated.where("case_id is not null").select(F.col("case_id").alias("_c")).distinct()
    flagged = waiting.join(marked, F.col("case_id") == F.col("_c"), "left")
    return flagged.select("id", "case_id", "stage", "k", "queue_class", "created_at", F.col("available_at").alias("not_before"), F.col("_c").isNotNull().alias("escalated"))


def rechecks(jobs: DataFrame, stage: str, days: Sequence[int] = (1, 7)) -> DataFrame:
    """case_id, round, not_before: the rechecks that a case still needs after its first finished round of a stage.

    Round n is due days[n - 1] after the first finished job of round 0; rounds that have a job already aren't needed.
    """
    mine = jobs.where(F.col("stage") == stage)
    base = mine.where("round = 0 and status = 'done'").groupBy("case_id").agg(F.min("updated_at").alias("_at"))
    wanted = base.select("case_id", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("round"), (F.col("_at") + F.expr(f"interval {d} days")).alias("not_before")) for i, d in enumerate(days)])).alias("w"))
    have = mine.select(F.col("case_id").alias("_c"), F.col("round").alias("_r")).distinct()
    return wanted.select("case_id", "w.round", "w.not_before").join(have, (F.col("case_id") == F.col("_c")) & (F.col("round") == F.col("_r")), "left_anti")


def opened(events: DataFrame, keys: Sequence[str], time: str, seq: str, quiet_seconds: float) -> DataFrame:
    """Adds ``case_no`` and ``opens``: an event reuses its key's case unless the key has been quiet for longer; then it opens the next one.

    Events without a time are left out by the caller. Windows cover an hour of a key, so one that holds most rows is spread.
    """
    bucket = F.date_trunc("hour", time)
    marked = latest.lagged(events, keys, [F.col(time), F.col(seq)], {"_was": F.col(time)}, bucket)
    gap = (F.unix_micros(time) - F.unix_micros("_was")) / 1e6
    flagged = marked.withColumn("opens", F.col("_first") | gap.isNull() | (gap > quiet_seconds)).withColumn("_one", F.col("opens").cast("int"))
    numbered = budget.running_sum(flagged, keys, [F.col(time), F.col(seq)], "_one", "case_no", bucket)
    return numbered.select(*events.columns, "opens", "case_no")


def ingest_decisions(events: DataFrame, keys: Sequence[str], source: str, time: str, seq: str) -> DataFrame:
    """Adds ``decision``: new (the key's first event), new_source (its first of a source), repeat, or none without a key or time. seq is unique."""
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    # Firsts are found with mergeable aggregates and joined back by the unique seq, so no key is one task's work.
    place = F.struct(F.col(time), F.col(seq))
    of_source = events.where(usable).groupBy(*keys, source).agg(F.min(place).alias("_p"))
    lead = of_source.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_p").alias("_lead"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    firsts = of_source.join(lead, same).select(F.col("_p")[seq].alias("_seq"), (F.col("_p") == F.col("_lead")).alias("_new"))
    marked = events.join(firsts, F.col(seq) == F.col("_seq"), "left")
    decision = F.when(~usable, "none").when(F.col("_new"), "new").when(F.col("_seq").isNotNull(), "new_source").otherwise("repeat")
    return marked.select(*events.columns, decision.alias("decision"))


#: What a job's error text says of its outcome; the first pattern that occurs counts.
OUTCOMES = (("timeout", r"timeout|timed out"), ("refused", r"refused"), ("reset", r"reset"), ("dns", r"nxdomain|name resolution|no such host"), ("tls", r"certificate|tls|ssl"), ("lease", r"lease"))


def outcome(error: Column) -> Column:
    """The class of an error text; ok for null or empty, other for what no pattern names."""
    out = F.when(F.coalesce(F.trim(error), F.lit("")) == "", "ok")
    for name, pattern in OUTCOMES:
        out = out.when(F.lower(error).rlike(pattern), name)
    return out.otherwise("other")
