"""The job queue as a fold of its events: enqueue, claim, renew, complete, fail, and leases that run out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: job_id, at (epoch seconds), event, token (of the lease), lease_seconds.
STATE = "job_id bigint, at double, status string, attempts int, token string, expires double"
MOST_ATTEMPTS = 3


def step(state: tuple | None, at: float, event: str, token: str | None, lease: float, most: int = MOST_ATTEMPTS) -> tuple | None:
    """(status, attempts, token, expires) after an event; events that don't fit the state change nothing."""
    status, attempts, held, expires = state or (None, 0, None, None)
    if status == "running" and expires is not None and expires <= at:  # the lease ran out before this event
        status, held, expires = ("pending" if attempts < most else "failed"), None, None
    if event == "enqueue" and status is None:
        return "pending", 0, None, None
    if event == "claim" and status == "pending":
        return "running", attempts + 1, token, at + lease
    if status == "running" and held == token:
        if event == "renew":
            return status, attempts, held, at + lease
        if event == "complete":
            return "done", attempts, None, None
        if event == "fail":
            return ("pending" if attempts < most else "failed"), attempts, None, None
    return None if status is None else (status, attempts, held, expires)


class _Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, token string, expires double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = (self.state.get() if self.state.exists() else None), []
        for at, event, token, lease in pd.concat(list(rows)).sort_values(["at", "event"])[["at", "event", "token", "lease_seconds"]].itertuples(index=False, name=None):
            after = step(state, at, event, None if pd.isna(token) else token, 0.0 if pd.isna(lease) else lease)
            if after is not None and after != state:
                out.append((key[0], at, *after))
                state = after
        if state is not None:
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def transitions(events: DataFrame) -> DataFrame:
    """STATE rows of a stream of queue events, one for every change of a job."""
    return events.groupBy("job_id").transformWithStateInPandas(_Queue(), STATE, "Append", "None")


def folded(events: DataFrame, now: float) -> DataFrame:
    """The state of every job at ``now`` from all its events, in batch: the same fold, streamed over sorted partitions."""
    ordered = events.where("job_id is not null and at is not null").repartition("job_id").sortWithinPartitions("job_id", "at", "event")

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state, last, out = None, None, 0.0, []

        def done():
            ended = step(state, now, "", None, 0.0)
            if job is not None and ended is not None:
                out.append((job, last, *ended))

        for b in it:
            for j, at, event, token, lease in b[["job_id", "at", "event", "token", "lease_seconds"]].itertuples(index=False, name=None):
                if j != job:
                    done()
                    job, state = j, None
                state = step(state, at, event, None if pd.isna(token) else token, 0.0 if pd.isna(lease) else lease)
                last = at
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])
                out = []
        done()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return ordered.mapInPandas(fold, STATE)


def job_events(jobs: DataFrame) -> DataFrame:
    """Queue events that lead to the rows of a job table: enqueue, then claims and their ends by status."""
    base = jobs.where("id is not null and created_at is not null").groupBy(F.col("id").alias("job_id")).agg(F.max_by(F.struct("created_at", "updated_at", "status", "attempts", "lease_token"), F.struct("updated_at", "status")).alias("j")).select("job_id", "j.*")
    start = F.unix_micros("created_at") / 1e6
    ev = lambda at, name, token: F.struct(at.alias("at"), F.lit(name).alias("event"), token.alias("token"), F.lit(600.0).alias("lease_seconds"))
    token = F.coalesce("lease_token", F.concat(F.lit("t"), F.col("job_id").cast("string")))
    claims = F.when(F.col("attempts") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.col("attempts")), lambda i: F.array(ev(start + i * 2 - 1, "claim", token), ev(start + i * 2, "fail", token))))).otherwise(F.array().cast("array<struct<at:double,event:string,token:string,lease_seconds:double>>"))
    last = F.when(F.col("status") == "done", "complete").when(F.col("status") == "running", "renew").otherwise("fail")
    ended = F.transform(claims, lambda x, i: F.when((i == F.size(claims) - 1), x.withField("event", last)).otherwise(x))
    return base.select("job_id", F.explode(F.concat(F.array(ev(start, "enqueue", F.lit(None).cast("string"))), ended)).alias("e")).select("job_id", "e.*")


def latest_state(changes: DataFrame) -> DataFrame:
    """The last row of each job among transitions."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("at").desc(), F.col("attempts").desc()))
    return changes.withColumn("_p", place).where("_p = 1").drop("_p")
