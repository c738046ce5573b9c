import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lookout.functions import text
from lookout.operators import budget, groups, joins, latest, merge, quantiles, quotient
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1)
HEX = "0123456789abcdef" * 4


def ids(n):
    return f"{n:064x}"


# Exactly one copy of each message ------------------------------------------------------------------------------------


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "", "zz", ids(1), ids(2), f" {ids(1).upper()}\t", ids(3)]), st.sampled_from([None, 0, 1, 2])), max_size=25))
def test_copies_against_brute_force(spark, rows):
    data = [(i, e, None if t is None else T0 + timedelta(seconds=t), "x") for i, (e, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, eid string, at timestamp, kept string")
    by = {}
    for i, e, t, _ in data:
        k = (e or "").strip().lower()
        if len(k) == 64:
            by.setdefault(k, []).append((t is None, t or T0, i))
    keep = {min(v)[2] for v in by.values()}
    every = {x[2] for v in by.values() for x in v}
    assert {r.seq for r in quotient.repeated_copies(df, "eid", "at", "seq").collect()} == every - keep
    assert sorted(r.seq for r in quotient.first_copies(df, "eid", "at", "seq").collect()) == sorted(keep)
    stats = quotient.replay_stats(df, "kept", "eid", "at", "seq").collect()
    assert [(r.records, r.ingested, r.duplicates, r.invalid) for r in stats] == ([(len(data), len(keep), len(every - keep), len(data) - len(every))] if data else [])


def test_permutation_is_exact_and_even(spark):
    rng = random.Random(1)
    values = [ids(i) for i in range(3000)] + [f"{rng.getrandbits(256):064x}" for _ in range(1000)] + ["f" * 64, HEX]
    df = spark.createDataFrame([(v,) for v in values], "id string").select("id", *quotient.permuted(F.col("id")))
    rows = df.withColumn("back", quotient.restored()).collect()
    assert all(r.id == r.back for r in rows)
    shards = [r.quotient >> 8 for r in rows[:3000]]  # consecutive ids spread over 16 shards
    assert min(map(shards.count, range(16))) > 120


def test_store_of_batches(spark, tmp_path):
    store = quotient.QuotientStore(spark, f"file://{tmp_path}/store")
    batch = lambda *rows: spark.createDataFrame([(i, ids(k), T0) for i, k in rows], "seq long, eid string, at timestamp")
    put = lambda df, name: sorted(r.seq for r in store.insert(df, name, "eid", "at", "seq").collect())
    assert put(batch((1, 1), (2, 2), (3, 1)), "a") == [1, 2]
    assert put(batch((4, 2), (5, 3), (6, 3)), "b") == [5]
    assert put(batch((4, 2), (5, 3), (6, 3)), "b") == [5]  # retried
    assert put(batch((7, 1), (8, 3)), "c") == []
    plan = store.shards([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quotient" in plan  # other shards aren't read


# Exact quantiles -----------------------------------------------------------------------------------------------------


def brute_quantile(values, p):
    import math

    v = sorted(values)
    return v[max(1, math.ceil(len(v) * p)) - 1]


@pytest.mark.parametrize("small_broadcast", [True, False])
def test_quantiles_of_hot_and_cold_keys(spark, monkeypatch, small_broadcast):
    if not small_broadcast:
        monkeypatch.setattr(quantiles, "broadcast_if_small", lambda df: (df, False))
    monkeypatch.setattr(quantiles, "LINEAR_BINS", 8)
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.randrange(10**12), 10**11 + rng.randrange(50)])) for _ in range(4000)]
    rows += [(f"k{rng.randrange(200)}", rng.randrange(-1000, 1000)) for _ in range(1500)] + [(None, 5), (None, 7), ("none", None), ("same", 3), ("same", 3), ("edge", 2**63 - 1), ("edge", -(2**63)), ("edge", 2**63 - 2)]
    df = spark.createDataFrame(rows, "k string, v long")
    probs = (0.0, 0.25, 0.5, 0.99, 1.0)
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    got = {(r.k, r.p): r.quantile for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert got == {(k, p): brute_quantile(v, p) for k, v in by.items() for p in probs}
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", probs).count() == 0


def test_effective_groups(spark):
    rows = [("A.Test.", None), ("", '{"registrable_domain":"B.test","name":"x"}'), (None, '{"registrable_domain":"","name":"N.test."}'), (None, "{}"), (None, "no json"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string, p string").select(groups.effective_group(F.col("g"), F.col("p"))).collect()]
    assert got == ["a.test", "b.test", "n.test", None, None, None]


def test_heavy_groups_count_repeats(spark):
    rows = [(i, "s", "big", "{}", 1, T0, T0) for i in range(50)] + [(i, "s", f"k{i}", "{}", 1, T0, T0) for i in range(150)] + [(7, None, None, None, None, None, None)]
    jobs = spark.createDataFrame(rows, "id long, stage string, group_key string, payload_json string, attempts int, created_at timestamp, updated_at timestamp")
    assert [tuple(r) for r in groups.heavy_groups(jobs).collect()] == [("s", "big")]
    assert groups.heavy_groups(jobs.limit(0)).count() == 0
    profile = {(r.stage, r.group_key): r for r in groups.group_profile(jobs).collect()}
    assert profile["s", "big"].jobs == 50 and profile["s", "big"].waited_p50 == 0 and profile[None, None].waited_p50 is None


def test_heavy_groups_by_refined_ranks(spark, monkeypatch):
    """Pairs at the share exactly and one row below it, among many of one row; the ranks go through several rounds."""
    rounds, locate = [], quantiles._locate
    monkeypatch.setattr(quantiles, "_locate", lambda *a: rounds.append(1) or locate(*a))
    monkeypatch.setattr(quantiles, "LINEAR_BINS", 8)
    keys = [("s", "at")] * 49 + [("t", "at")] * 48 + [(None, "at")] * 49 + [("s", None)] * 60 + [("s", f"k{i}") for i in range(494)]
    rows = [(i, s, k, "{}", 1, T0, T0) for i, (s, k) in enumerate(keys)]
    jobs = spark.createDataFrame(rows, "id long, stage string, group_key string, payload_json string, attempts int, created_at timestamp, updated_at timestamp")
    assert len(rows) == 700 and 0.07 * 700 > 49
    assert {tuple(r) for r in groups.heavy_groups(jobs, 0.07).collect()} == {("s", "at"), (None, "at")} and len(rounds) > 1
    assert {tuple(r) for r in groups.heavy_groups(jobs, 0.0005).collect()} == set(keys) - {("s", None)}
    assert groups.heavy_groups(jobs.where("group_key is null")).count() == 0


def test_heavy_groups_of_equal_hashes(spark, monkeypatch):
    """Pairs whose hashes are equal are counted apart."""
    monkeypatch.setattr(groups.F, "xxhash64", lambda *cols: F.lit(5).cast("long"))
    jobs = spark.createDataFrame([(i, "s", "ab"[i % 10 > 0], "{}", 1, T0, T0) for i in range(100)], "id long, stage string, group_key string, payload_json string, attempts int, created_at timestamp, updated_at timestamp")
    assert [tuple(r) for r in groups.heavy_groups(jobs, 0.5).collect()] == [("s", "b")]


# Joins ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [True, False])
def test_suffix_join(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "broadcast_if_small", lambda df, **_: (df, False))
    left = spark.createDataFrame([(1, "a.b.c.com"), (2, "c.com"), (3, "xc.com"), (4, None), (5, "z.only.org"), (6, "only.org")], "id int, host string")
    right = spark.createDataFrame([("c.com", "c", False), ("b.c.com", "b", False), ("only.org", "o", True)], "domain string, id string, exact boolean")
    got = {r.id: r.right.id for r in joins.suffix_join(left, "host", right, "domain", F.col("exact")).collect()}
    assert got == {1: "b", 2: "c", 6: "o"}
    got = {r.id: r.right.id for r in joins.suffix_join(left, "host", right, "domain", proper=True).collect()}
    assert got == {1: "b", 5: "o"}
    twice = joins.suffix_join(left.unionByName(left), "host", right, "domain")
    assert twice.count() == 8 and joins.suffix_join(left, "host", right.limit(0), "domain").count() == 0
    if broadcast:
        assert "Exchange hashpartitioning" not in twice._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("automaton", [True, False])
def test_contains_join(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(joins, "ahocorasick", None)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "b" * 3000]
    terms = ["a", "ab", "abc", "cabc", "", "bbb", None, "aaaaaaaaaaaaaaaaaa"]
    left, right = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, term string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r.id, r.right.term) for r in joins.contains_join(left, "term", right, "term").collect())
    assert got == sorted((i, x) for i, t in enumerate(texts) for x in terms if t and x and x in t)


def test_fuzzy_join(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    got = sorted((r.w, r.right.w, r.distance) for r in joins.fuzzy_join(df, "w", df, "w").collect())
    assert got == sorted((a, b, dist(a, b)) for a in words for b in words if dist(a, b) <= 2)


def test_intervals_members_and_endpoints(spark):
    spans = spark.createDataFrame([("k", 1, 3), ("k", 4, 9), ("q", 1, 3)], "k string, a int, b int")
    covers = spark.createDataFrame([("k", 0, 3)], "k string, c int, d int")
    assert sorted(tuple(r) for r in joins.not_inside(spans, ["k"], "a", "b", covers, "c", "d").collect()) == [("k", 4, 9), ("q", 1, 3)]
    left = spark.createDataFrame([(1, [5, 6, 5]), (2, []), (3, None)], "id int, refs array<int>")
    assert [(r.id, r.right.n) for r in joins.member_join(left, "refs", spark.createDataFrame([(5, "n")], "key int, n string"), "key").collect()] == [(1, "n")]
    edges = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", None)], "x string, y string")
    assert sorted((r.k, r.right.x, r.right.y) for r in joins.either_join(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k", edges, "x", "y").collect()) == [("a", "a", "a"), ("a", "a", "b"), ("b", "a", "b")]


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("k", 7, 3), (None, 5, 4), ("k", None, 5), ("z", 5, 6)], "k string, t int, v int")
    right = spark.createDataFrame([("k", 5, 50), ("k", 3, 30), ("k", 5, 51), (None, 1, 1), ("k", None, 9)], "k string, at int, w int")
    assert {r.v: r.w for r in latest.as_of(left, right, ["k"], "t", "at", ["w"]).collect()} == {1: 51, 2: None, 3: 51, 4: None, 5: None, 6: None}
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c)))
    for width in (1, 3, 1000):
        for strict, k5 in ((False, 51), (True, 30)):
            got = latest.as_of(stamp(left, "t"), stamp(right, "at"), ["k"], "t", "at", ["w"], strict, width)
            assert {r.v: r.w for r in got.collect()} == {1: k5, 2: None, 3: 51, 4: None, 5: None, 6: None}
    assert {r.v: r.w for r in latest.as_of(left, right, ["k"], "t", "at", ["w"], strict=True).collect()} == {1: 30, 2: None, 3: 51, 4: None, 5: None, 6: None}


# Order, budgets, merges ----------------------------------------------------------------------------------------------


def test_running_maximum_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.randrange(1000)) for i in range(300)]
    got = {r.i: r.m for r in latest.running_max_before(spark.createDataFrame(rows, "i long, k string, v int"), ["k"], "i", "v", "m", bucket=17).collect()}
    assert got == {i: max((v for j, q, v in rows if q == k and j < i), default=None) for i, k, _ in rows}


def test_gaps_over_buckets(spark):
    rng = random.Random(7)
    times = sorted(rng.randrange(100_000) for _ in range(200))
    df = spark.createDataFrame([(T0 + timedelta(seconds=t), i, "k") for i, t in enumerate(times)] + [(None, 999, "k")], "t timestamp, i int, k string")
    got = sorted(r.seconds for r in budget.gaps(df, ["k"], "t", "i", 700, bucket_seconds=3000).collect())
    assert got == sorted(float(b - a) for a, b in zip(times, times[1:]) if b - a > 700)


def test_running_sum_over_buckets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 30])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k string, s int")
    want = {i: sum(s or 0 for j, q, s in rows if q == k and j <= i) for i, k, _ in rows}
    for bucket in (None, F.floor(F.col("i") / 7)):
        assert {r.i: r.t for r in budget.running_sum(df, ["k"], [F.col("i")], "s", "t", bucket).collect()} == want


def test_skipping_budget(spark):
    rows = [("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("a", 4, 1), ("b", 1, 101), ("b", 2, 100), ("b", 3, None), (None, 1, 5)]
    got = {(r.k, r.o): r.accepted for r in budget.skipping(spark.createDataFrame(rows, "k string, o int, s int"), ["k"], ["o"], "s", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): False, ("b", 2): True, ("b", 3): True, (None, 1): True}
    stop = {(r.k, r.o) for r in budget.until_spent(spark.createDataFrame(rows, "k string, o int, s int"), ["k"], [F.col("o")], "s", 100).collect()}
    assert stop == {("a", 1), (None, 1)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9), st.sampled_from([True, False, None])), min_size=1, max_size=20), st.integers(0, 20))
def test_merging_rollups_is_order_insensitive(spark, rows, cut):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, t int, s boolean")
    whole = merge.sightings(df, ["k"], "t", F.col("s"))
    parts = merge.merged_sightings([merge.sightings(df.where(f"i {op} {cut}"), ["k"], "t", F.col("s")) for op in (">=", "<")], ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_history(spark):
    h = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("k", 3, None), ("k", 4, None), ("k", 5, 5)], "k string, i int, v int")
    assert [r.i for r in merge.changes_only(h, ["k"], [F.col("i")], F.col("v")).orderBy("i").collect()] == [1, 3, 5]
    runs = spark.createDataFrame([("t", 1, ["a"]), ("t", 2, ["b", "a"]), ("t", 3, [])], "t string, r int, m array<string>")
    assert [(r.added, r.removed) for r in merge.set_change(runs, ["t"], [F.col("r")], "m").orderBy("r").collect()] == [([], []), (["b"], []), ([], ["a", "b"])]
    new = merge.insert_new(h, spark.createDataFrame([("k", 9, 1), ("q", 2, 1), ("q", 1, 7)], "k string, i int, v int"), ["k"], [F.col("i")])
    assert [tuple(r) for r in new.collect()] == [("q", 1, 7)]


# Text ----------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    rows = [("=1+1\tx‮​", "https://User:p@ÜB_x.Example:8080/p?q", 0, "10.1.2.3"), ("  -x", "no url", 1_700_000_000, "8.8.8.8"), (None, None, None, "1.2.3.400")]
    df = spark.createDataFrame(rows, "t string, u string, e long, ip string")
    got = df.select(text.sanitize(F.col("t")), text.neutralize_csv(F.col("t")), text.host_of(F.col("u")), text.iso_seconds(F.col("e")), text.ipv4_class(F.col("ip"))).collect()
    assert [tuple(r) for r in got] == [("=1+1 x", "'=1+1\tx‮​", "üb_x.example", None, "private"), ("  -x", "'  -x", None, "2023-11-14T22:13:20+00:00", "public"), (None, "", None, None, None)]
    starts = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("a", "abc"), (None, "a")], "t string, s string").select(joins.find_all(F.col("t"), F.col("s")).alias("x")).collect()
    assert [r.x or [] for r in starts] == [[0, 1, 2], [], [], []]
    assert spark.range(1).select(text.hamming(F.lit("ffffffffffffffff"), F.lit("0"))).first()[0] == 64


# Session and extractors ----------------------------------------------------------------------------------------------


def test_working_tables_and_small_sides(spark):
    from lookout import session

    rows = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    with session.working_tables(spark):
        small, fits = session.broadcast_if_small(rows)  # has an exchange: written first
        (path,) = {f.rsplit("/", 1)[0] for f in small.inputFiles()}
        assert fits and small.count() == 7 and not session.broadcast_if_small(small, max_rows=6)[1]
    local = path.removeprefix("file://").removeprefix("file:")
    import os

    assert not os.path.exists(local)


def test_extractors(spark):
    from lookout.operators.extractors import Extractors, of_texts

    known = Extractors()
    known.register("size", "1")(lambda c: F.length("text") * c.get("times", 1))
    known.register("big", "2", applies=lambda c: F.length("text") > 3)(lambda c: F.upper("text"))
    known.register("broken", "1")(lambda c: F.col("nowhere"))
    known.register("raises", "1")(lambda c: c["missing"])
    with pytest.raises(ValueError):
        known.register("size", "3")(lambda c: F.lit(1))
    rows, errors = known.apply(spark.createDataFrame([("abcd",), ("x",), (None,)], "text string"), {"times": 2})
    assert {r.text: (r.facts.size, r.facts.big) for r in rows.collect()} == {"abcd": (8, "ABCD"), "x": (2, None), None: (None, None)}
    assert set(errors) == {"broken", "raises"} and known.versions() == {"size": "1", "big": "2", "broken": "1", "raises": "1"}
    facts, errors = of_texts().apply(spark.createDataFrame([("buy now ab@bank",)], "text string"))
    assert not errors and facts.first().facts.payments.vpas == ["ab@bank"]


@pytest.mark.parametrize("known", [False, True])
def test_lagged_in_buckets(spark, known):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i, rng.choice([None, rng.randrange(5)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    plain = latest.lagged(df, ["k"], [F.col("i")], {"was": F.col("v")}, known=known)
    cut = latest.lagged(df, ["k"], [F.col("i")], {"was": F.col("v")}, F.floor(F.col("i") / 7), known=known)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    want, last = {}, {}
    for k, i, v in rows:
        want[i] = (last.get(k, (None,))[0], k not in last)
        last[k] = (v if not known or v is not None else last.get(k, (None,))[0],)
    assert {r.i: (r.was, r._first) for r in plain.collect()} == want
