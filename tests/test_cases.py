"""Cases: filters, order, promotion and reuse on small tables."""

from datetime import datetime, timedelta

import pytest
from lookout.operators import cases
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_filters_and_order(spark):
    rows = [(1, "P1", 5, "strong", "open", "a,b", '["x","y"]', at(0)), (2, None, None, "weak", "closed", None, None, None), (3, "P2", 9, "strong", "open", "ab", '"x"', at(50)), (4, "P1", 7, "weak", "open", "b", "[broken", at(9))]
    df = spark.createDataFrame(rows, "case_id long, priority string, score int, strength string, status string, sources string, labels string, created_at timestamp")
    ids = lambda **c: sorted(r.case_id for r in cases.filtered(df, c).collect())
    assert ids() == ids(priority=None, label="") == [1, 2, 3, 4]
    assert ids(priority=("P1", "P2"), status="open") == [1, 3, 4] and ids(priority="P1", strength="weak") == [4]
    assert ids(source="b") == [1, 4] and ids(label="x") == [1] and ids(since=at(9)) == [3, 4] and ids(case_id=2) == [2]
    with pytest.raises(ValueError):
        cases.filtered(df, {"colour": 1})
    assert [r.case_id for r in df.orderBy(*cases.in_list_order(df)).collect()] == [4, 1, 3, 2]
    assert cases.filtered(df.limit(0), {"label": "x"}).count() == 0


def test_promotion_keeps_allowances_and_batch(spark):
    rows = [(i, "fetch", "hot", "weak", at(i), at(i), i == 7) for i in range(10)] + [(20, "fetch", "b", "strong", at(0), at(3), False), (21, "fetch", "b", "weak", at(0), at(1), False), (22, "fetch", "late", "strong", at(0), at(900), False), (23, "fetch", "full", "weak", at(0), at(0), False)]
    deferred = spark.createDataFrame(rows, "id int, stage string, k string, queue_class string, created_at timestamp, not_before timestamp, escalated boolean")
    live = spark.createDataFrame([("fetch", "full", 9), ("fetch", "b", 1)], "stage string, k string, n long")
    got = [(r.place, r.id) for r in cases.promoted(deferred, live, F.lit(at(100)), 50, strong=3, weak=2).orderBy("place").collect()]
    # hot: the escalated row, then one more within two; b: strong with room for three, weak has none left at two.
    assert got == [(1, 7), (2, 0), (3, 20)]
    assert [r.id for r in cases.promoted(deferred, live, F.lit(at(100)), 1, strong=3, weak=2).collect()] == [7]


def test_reuse_decisions_rechecks_and_outcomes(spark):
    e = spark.createDataFrame([(1, "a", "x", at(0)), (2, "a", "y", at(5)), (3, "a", "x", at(500)), (4, "b", "x", None), (5, None, "x", at(1)), (6, "a", "y", at(505))], "seq int, k string, source string, t timestamp")
    assert {r.seq: (r.case_no, r.opens) for r in cases.opened(e.where("k = 'a'"), ["k"], "t", "seq", 100).collect()} == {1: (1, True), 2: (1, False), 3: (2, True), 6: (2, False)}
    assert {r.seq: r.decision for r in cases.ingest_decisions(e, ["k"], "source", "t", "seq").collect()} == {1: "new", 2: "new_source", 3: "repeat", 4: "none", 5: "none", 6: "repeat"}
    jobs = spark.createDataFrame([(1, "fetch", 0, "done", at(0)), (1, "fetch", 1, "pending", at(9)), (2, "fetch", 0, "failed", at(0)), (3, "fetch", 0, "done", at(60))], "case_id long, stage string, round int, status string, updated_at timestamp")
    got = {(r.case_id, r.round): r.not_before for r in cases.rechecks(jobs, "fetch").collect()}
    assert got == {(1, 2): at(7 * 86400), (3, 1): at(60 + 86400), (3, 2): at(60 + 7 * 86400)}
    texts = {"": "ok", None: "ok", "Connection REFUSED": "refused", "timed out": "timeout", "odd": "other"}
    assert {r.t: r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", cases.outcome(F.col("t")).alias("o")).collect()} == texts
    truth = {"0": False, "false": False, "[]": False, None: False, "": False, "x": True, "[0]": True, "1": True}
    assert {r.t: r.o for r in spark.createDataFrame([(t,) for t in truth], "t string").select("t", cases.json_true(F.col("t")).alias("o")).collect()} == truth


def test_history(spark):
    jobs = spark.createDataFrame([(1, 0, 1, "done", at(0), "a"), (1, 1, 9, "failed", at(5), "a"), (1, 1, None, "done", at(6), "b"), (2, 0, 0, "done", at(0), "a")], "case_id long, round int, attempts int, status string, updated_at timestamp, stage string")
    got = {(r.case_id, r.round): (r.score, r.priority, r.before, r.rose, r.labels) for r in cases.score_history(cases.round_scores(jobs)).collect()}
    assert got == {(1, 0): (1, "P4", None, False, '["a"]'), (1, 1): (14, "P2", 1, True, '["a","b"]'), (2, 0): (0, "P4", None, False, '["a"]')}
