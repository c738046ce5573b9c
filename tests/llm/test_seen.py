import random

from lookout.llm import q3_seen, seen
from pyspark.sql import functions as F

ID = "{:064x}".format


def write(spark, path, rows, schema, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def brute(rows):
    """(id, key) in any order -> ids whose key has a smaller id."""
    least = {}
    for i, k in rows:
        least[k] = min(i, least.get(k, i))
    return {i for i, k in rows if i > least[k]}


def test_table_against_brute_force(spark, sf):
    certs = [(r.msg_id, r.k) for r in spark.read.parquet(f"{sf}/cert_messages.parquet").select("msg_id", F.expr("coalesce(nullif(data.leaf_cert.fingerprint, ''), nullif(data.leaf_cert.sha256, ''))").alias("k")).collect() if r.k]
    events = [(r.delivery_id, r.event_id.strip().lower()) for r in spark.read.parquet(f"{sf}/discovery_log.parquet").collect() if r.event_id and len(r.event_id.strip()) == 64 and not set(r.event_id.strip().lower()) - set("0123456789abcdef")]
    got = {(r.stream, r.record_id) for r in q3_seen.p3_found(spark, sf).collect()}
    assert got == {("certificate", i) for i in brute(certs)} | {("event", i) for i in brute(events)}


def by_arrival(batches):
    """Batches of (id, key), each in the order of ids -> {id: seen}."""
    known, out = set(), {}
    for rows in batches:
        for i, k in sorted(set(rows)):
            out[i] = k in known
            known.add(k)
    return out


def test_batches_restarts_and_late_ids(spark, tmp_path):
    rng, path, every = random.Random(1), f"{tmp_path}/log.parquet", []
    ids = rng.sample(range(10_000), 300)  # so later batches also bring smaller ids
    schema = "delivery_id long, event_id string, stream string, key int"
    op, earlier = seen.SeenKeys(spark, f"file://{tmp_path}/state"), {}
    for part in range(3):
        rows = [(i, ID(rng.randrange(60)) if rng.random() < 0.9 else rng.choice([None, "", "x"]), "s", 1) for i in ids[part * 100 : part * 100 + 100]]
        rows += [(None, ID(1), "s", 1), rows[0]]
        every.append([(i, e) for i, e, *_ in rows if i is not None and e and len(e) == 64])
        write(spark, path, rows, schema, part)
        if part == 2:
            op = seen.SeenKeys(spark, f"file://{tmp_path}/state")  # goes on from its checkpoint
        op.run(seen.events(seen.file_stream(spark, path, files_per_batch=1)))
        got = {r.record_id: r.seen for r in op.verdicts().collect()}
        assert got == by_arrival(every)
        assert earlier.items() <= got.items()  # no verdict changes later
        earlier = got
    assert {r.record_id for r in op.repeats().collect()} == {i for i, s in earlier.items() if s}


def test_repeated_micro_batch_and_cost(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame([("s", i, k.encode()) for i, k in rows], seen.RECORDS)
    op = seen.SeenKeys(spark, f"file://{tmp_path}/state")
    op.judge(batch(*[(i, f"k{i}") for i in range(500)]), 0)
    op.judge(batch((900, "k3"), (901, "new"), (902, "new")), 1)
    op.judge(batch((900, "k3"), (901, "new"), (902, "new")), 1)  # retried
    got = {r.record_id: r.seen for r in op.verdicts().collect()}
    assert got == {i: False for i in range(500)} | {900: True, 901: False, 902: True}
    # What the state emits for a micro-batch are its own keys, not the history's.
    assert spark.read.parquet(f"file://{tmp_path}/state/verdicts/batch=1").count() == 3


def test_hot_key_and_empty_table(spark, tmp_path):
    path = write(spark, f"{tmp_path}/hot.parquet", [(i, f" {ID(7).upper()} " if i % 3 == 0 else ID(i + 100), None, 1) for i in range(600)], "delivery_id long, event_id string, stream string, key int", 0)
    op = seen.SeenKeys(spark, f"file://{tmp_path}/hot")
    op.run(seen.events(seen.file_stream(spark, path)))
    assert {r.record_id for r in op.repeats().collect()} == {i for i in range(3, 600, 3)}
    empty = write(spark, f"{tmp_path}/none.parquet", [], "delivery_id long, event_id string", 0)
    op = seen.SeenKeys(spark, f"file://{tmp_path}/none")
    op.run(seen.events(seen.file_stream(spark, empty)))
    assert op.repeats().count() == 0


def test_rate_of_wrong_answers(spark, sf):
    for r in q3_seen.p3_wrong_answers(spark, sf).collect():
        assert r.wrong_rate == abs(r.duplicates - (r.recorded or 0)) / r.keyed
