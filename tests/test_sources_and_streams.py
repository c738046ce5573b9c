import gzip
import json
from datetime import datetime, timedelta

from lookout.sources import blobs, messages, rawlog, registry, sinks
from lookout.streaming import feeds, queue
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1, 5)


def test_rawlog_round_trip_and_cut_segments(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = spark.createDataFrame([(i, f"n{i}é", T0 + timedelta(hours=i * 10)) for i in range(6)], "id long, name string, at timestamp")
    rawlog.write(rows, path, "at")
    back = rawlog.read(spark, path, "id long, name string, at timestamp")
    assert sorted((r.id, r.name) for r in back.collect()) == [(i, f"n{i}é") for i in range(6)]
    assert sorted(r.id for r in rawlog.read(spark, path, "id long, name string, at timestamp", since_day="20230102").collect()) == [2, 3, 4, 5]
    body = gzip.compress(b"".join(json.dumps({"id": i, "name": "x" * 50}).encode() + b"\n" for i in range(2000)))
    whole = list(rawlog.lines_of(body + gzip.compress(b'{"id": 1}\nlast')))
    assert len(whole) == 2002 and whole[-1] == (2001, "last")
    cut = list(rawlog.lines_of(body[: len(body) // 2]))
    assert 0 < len(cut) < 2000 and all(json.loads(line)["id"] == n for n, line in cut)
    assert list(rawlog.lines_of(b"")) == [] and list(rawlog.lines_of(b"nonsense")) == []


def test_message_source(spark, tmp_path):
    spark.dataSource.register(messages.MessageSource)
    path = f"{tmp_path}/feed.jsonl"
    good = {"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": ["a.com", None, "*.B.com"], "fingerprint": "f"}, "cert_index": 3, "source": {"name": "log"}}}
    lines = [json.dumps(good), "{broken", "[]", json.dumps({"message_type": "heartbeat"}), json.dumps(good)]
    with open(path, "w") as f:
        f.write("".join(x + "\n" for x in lines) + '{"unfinished')
    raw = spark.read.format("certmessages").option("path", path).option("splits", 3).load()
    assert [r.value for r in raw.orderBy("line").collect()] == [*lines, '{"unfinished']
    p = feeds.parsed(raw).orderBy("line").collect()
    assert [r.malformed for r in p] == [False, True, True, False, False, True]
    assert p[0].message.data.leaf_cert.all_domains == ["a.com", "*.B.com"]
    stream = spark.readStream.format("certmessages").option("path", path).load()
    got = feeds.run_to_end(feeds.parsed(stream).select("line", "malformed"), f"{tmp_path}/run")
    assert sorted(r.malformed for r in got.collect()) == [False, False, False, True, True]


def _messages(spark, tmp_path):
    rows, at, index = [], T0, {"a": 10, "b": 100}
    for i in range(200):
        at += timedelta(seconds=400 if i % 37 == 36 else 20)
        log = "a" if i % 3 else "b"
        index[log] += 5 if i % 50 == 7 else 1
        rows.append((i, at, "certificate_update", (None, (["x.com", "*.x.com", f"h{i}.com"], f"f{i % 150}", None, None, None, None, None), index[log], None, (log, None))))
    rows.append((900, at, "heartbeat", None))
    df = spark.createDataFrame(rows, "msg_id long, received_at timestamp, " + feeds.MESSAGE)
    for i in range(4):
        df.where(f"msg_id div 50 = {i} or ({i} = 3 and msg_id >= 200)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m.parquet")
    return df, f"{tmp_path}/m.parquet"


def test_streams_agree_with_batch(spark, tmp_path):
    df, path = _messages(spark, tmp_path)
    rows = sorted((r.data.source.name, r.received_at, r.msg_id, r.data.cert_index) for r in df.where("data is not null").collect())
    want = [(log, "gap", m, (t - u).total_seconds()) for (k, u, _, _), (log, t, m, _) in zip(rows, rows[1:]) if k == log and (t - u).total_seconds() > 60]
    want += [(log, "skipped", m, float(i - j - 1)) for (k, _, _, j), (log, _, m, i) in zip(rows, rows[1:]) if k == log and i - j > 1]
    for whole in (None, 1):  # all files at once; file by file in order of arrival
        got = feeds.gaps_to_end(feeds.table_stream(spark, path, whole), f"{tmp_path}/g{whole}", 60)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    state = feeds.run_to_end(feeds.gaps_and_skips(feeds.table_stream(spark, path, 1), 60), f"{tmp_path}/tws")
    assert sorted(tuple(r)[:4] for r in state.select("log", "kind", "msg_id", "amount").collect()) == sorted(want)
    hosts = feeds.run_to_end(feeds.certificate_hosts(feeds.table_stream(spark, path)), f"{tmp_path}/h")
    assert hosts.count() == 400


def test_watermarked_streams(spark, tmp_path):
    df, path = _messages(spark, tmp_path)
    once = feeds.run_to_end(feeds.without_recent_repeats(feeds.table_stream(spark, path, 1).withColumn("key", F.col("data.leaf_cert.fingerprint")).where("key is not null").select("key", "received_at", "msg_id"), "key", "received_at", "5 hours"), f"{tmp_path}/d")
    assert sorted(r.key for r in once.collect()) == sorted(f"f{i}" for i in range(150))
    hours = feeds.run_to_end(feeds.hourly(feeds.table_stream(spark, path, 1)), f"{tmp_path}/c")
    batch = {r.h: r.n for r in df.groupBy(F.date_trunc("hour", "received_at").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.hour_start: r.messages for r in hours.collect()}
    assert got and all(batch[h] == n for h, n in got.items())


def test_queue_fold_batch_and_stream(spark, tmp_path):
    ev = [
        (1, 1.0, "enqueue", None, None), (1, 2.0, "claim", "t", 10.0), (1, 5.0, "renew", "t", 10.0), (1, 6.0, "complete", "t", None),
        (2, 1.0, "enqueue", None, None), (2, 2.0, "claim", "t", 1.0), (2, 9.0, "complete", "t", None),  # too late: the lease ran out
        (3, 1.0, "enqueue", None, None), (3, 2.0, "claim", "t", 5.0), (3, 3.0, "fail", "t", None), (3, 4.0, "claim", "u", 5.0), (3, 5.0, "fail", "u", None), (3, 6.0, "claim", "v", 5.0), (3, 7.0, "fail", "v", None),
        (4, 1.0, "claim", "t", 5.0), (5, 1.0, "enqueue", None, None), (5, 2.0, "claim", "t", 5.0), (5, 3.0, "complete", "other", None),
    ]
    df = spark.createDataFrame(ev, "job_id long, at double, event string, token string, lease_seconds double")
    got = {r.job_id: (r.status, r.attempts) for r in queue.folded(df, 6.5).collect()}
    assert got == {1: ("done", 1), 2: ("pending", 1), 3: ("failed", 3), 5: ("running", 1)}
    df.coalesce(1).write.parquet(f"{tmp_path}/ev.parquet")
    changes = feeds.run_to_end(queue.transitions(feeds.table_stream(spark, f"{tmp_path}/ev.parquet")), f"{tmp_path}/q")
    last = {r.job_id: (r.status, r.attempts) for r in queue.latest_state(changes).collect()}
    assert last == {1: ("done", 1), 2: ("pending", 1), 3: ("failed", 3), 5: ("running", 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x\ny", None), (2, 'q"u,o', "z")], "b int, a string, c string")
    sinks.write_csv(df, f"{tmp_path}/csv", ["b", "a", "c"], single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes() == b"b,a,c\r\n1,'=x y,\r\n2,\"q\"\"u,o\",z\r\n"
    sinks.json_lines(df.coalesce(1), f"{tmp_path}/json")
    (part,) = (tmp_path / "json").glob("part-*.json")
    assert part.read_text().splitlines()[0] == '{"a":"=x\\ny","b":1,"c":null}'
    shown = {r.b: r.rendered for r in sinks.within_budget(df, "b", ["c", "a", "b"], 3).collect()}
    assert shown == {1: "a: =x\ny\nb: 1", 2: "c: z\na: q\"u,o"}


def test_blobs(spark, tmp_path):
    for n, body in {"a": b"xx", "b": b"xx", "c": b"yyy"}.items():
        (tmp_path / n).write_bytes(body)
    files = blobs.read_files(spark, str(tmp_path))
    first = blobs.stored(files)
    assert sorted(r.size for r in first.collect()) == [2, 3]
    assert blobs.stored(files, first.where("size = 2")).count() == 1
    links = spark.createDataFrame([(1, "s", 60, 1), (1, "s", 60, 2), (1, "t", 50, 3), (1, "u", 40, 4), (2, "s", 60, 1)], "case_id int, sha256 string, size int, at int")
    assert {(r.case_id, r.sha256): r.accepted for r in blobs.accepted_links(links, 100).collect()} == {(1, "s"): True, (1, "t"): False, (1, "u"): True, (2, "s"): True}
    use = blobs.usage(links, spark.createDataFrame([(1, "d"), (2, "d")], "case_id int, domain string")).first()
    assert (use.links, use.bodies, use["bytes"]) == (5, 3, 150)


def test_registry_yaml(spark, tmp_path):
    base, over = tmp_path / "r.yaml", tmp_path / "o.yaml"
    base.write_text("version: 1\nbrands:\n  - {id: oak, name: Oak, status: confirmed, keywords: [{term: oak, tier: low, status: confirmed, provenance: [{source: 'a:1', recorded_by: me, recorded_at: 2026-01-02}]}]}\n")
    over.write_text("domains:\n  - {name: oak.org, brand: oak, status: candidate}\n")
    r = registry.load(str(base), str(over))
    assert r.frame(spark, "domains").first().kind == "official"
    assert {(x.list, x.n) for x in registry.counts(spark, r).collect()} == {("brands", 1), ("keywords", 1), ("domains", 1)}
    legacy = spark.createDataFrame([("keyword", "oak", "a:1"), ("keyword", "oak", "b:2"), ("keyword", "elm", "a:1")], "kind string, value string, source string")
    assert {(x.value, x.source) for x in registry.uncovered(legacy, r.frame(spark, "keywords"), "term").collect()} == {("oak", "b:2"), ("elm", "a:1")}


def test_long_raw_log_lines(spark, tmp_path):
    import gzip
    import json as _json

    folder = tmp_path / "raw" / "day=20230101" / "hour=00"
    folder.mkdir(parents=True)
    long = {"id": 1, "name": "x" * (2 << 20)}
    (folder / "a.json.gz").write_bytes(gzip.compress((_json.dumps(long) + "\n" + _json.dumps({"id": 2, "name": "y"})).encode()))
    got = {r.id: (len(r.name), r.malformed) for r in rawlog.read(spark, f"{tmp_path}/raw", "id long, name string").collect()}
    assert got == {1: (2 << 20, False), 2: (1, False)}
