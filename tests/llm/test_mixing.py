import duckdb
import pytest

from lookout.llm import bpe, mixing, q7_mixing


def test_shares_caps_and_order(spark, sf):
    rows = q7_mixing.p7_mix(spark, sf).collect()
    assert [(r.mix, r.position) for r in rows] == sorted((r.mix, r.position) for r in rows)
    con = duckdb.connect()
    asked = {(m, s): (t, c) for m, s, t, c in con.execute(f"SELECT * FROM read_parquet('{sf}/mix_targets.parquet')").fetchall()}
    texts = {i: (s, len(bpe.encoder().ids(t))) for i, t, s in con.execute(f"SELECT doc_id, text, source FROM read_parquet('{sf}/documents.parquet')").fetchall()}
    longest = max(n for _, n in texts.values())
    for mix in {m for m, _ in asked}:
        mine = [r for r in rows if r.mix == mix]
        have = {s for s, _ in texts.values()}
        good = {s: t for (m, s), (t, _) in asked.items() if m == mix and t and t == t and s in have}
        uses, whole = {}, sum(good.values())
        assert {r.source for r in mine} == set(good)
        for r in mine:
            assert texts[r.doc_id] == (r.source, r.n_tokens)
            uses[r.doc_id, r.source] = uses.get((r.doc_id, r.source), 0) + 1
            assert 0 <= r.position <= 1
        assert all(n <= asked[mix, s][1] for (_, s), n in uses.items())
        most = {s: asked[mix, s][1] * sum(n for x, n in texts.values() if x == s) for s in good}
        # T by trying: the largest at which the sources miss at most a tenth of the mix.
        low, high = 0.0, 10.0 * sum(most.values()) / min(good.values())
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(max(0, t / whole - most[s] / mid) for s, t in good.items()) <= 0.1 else (low, mid)
        even = 1 / len(good)
        room = min([1.0, *(x / whole / abs(x / whole - even) for x in good.values() if abs(x / whole - even) > 1e-12)])
        for s, t in good.items():
            got, demand = sum(r.n_tokens for r in mine if r.source == s), min(low * t / whole, most[s])
            assert -1e-3 <= got - demand <= longest
            # The schedule: by position t, a source has supplied its integrated weight.
            share, slope = t / whole, (t / whole - even) * room
            early = sum(r.n_tokens for r in mine if r.source == s and r.position < 0.5)
            assert abs(early - demand * (share * 0.5 + slope * (0.25 - 0.5)) / share) <= longest


def test_size_and_schedule(spark):
    counts = spark.createDataFrame([(i, "ab"[i % 2], 5 + i % 7) for i in range(2000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    knots = {"a": [(0.2, 0.0), (0.6, 4.0), (0.6, 1.0), (1.0, 0.0)], "b": [(0.0, float("nan")), (-1.0, 3.0)]}
    schedule = spark.createDataFrame([("m", s, t, w) for s, v in knots.items() for t, w in v] + [(None, "a", 0.1, 9.0), ("m", "a", None, 9.0)], "mix string, source string, at double, weight double")
    rows = mixing.selection(counts, targets, total=12_000, schedule=schedule).collect()
    assert abs(sum(r.n_tokens for r in rows) - 12_000) <= 2 * 12
    weight = lambda t: 0 if t < 0.2 else 10 * (t - 0.2) if t < 0.6 else 10 * (1 - t)
    grid = [i / 10_000 for i in range(10_000)]
    whole = sum(map(weight, grid))
    for until in (0.1, 0.3, 0.5, 0.8, 0.95):
        part = sum(weight(t) for t in grid if t < until) / whole
        assert abs(sum(r.n_tokens for r in rows if r.source == "a" and r.position < until) - 6000 * part) <= 20
        assert abs(sum(r.n_tokens for r in rows if r.source == "b" and r.position < until) - 6000 * until) <= 20
    # More than there is: both sources at their caps, and the shares say so.
    rows = mixing.selection(counts, targets, total=10**9).collect()
    assert sum(r.n_tokens for r in rows) == 2 * sum(5 + i % 7 for i in range(2000))


def test_report(spark, sf):
    rows = {(r.mix, r.source): r for r in q7_mixing.p7_shares(spark, sf).collect()}
    con = duckdb.connect()
    assert set(rows) == set(con.execute(f"SELECT DISTINCT mix, source FROM read_parquet('{sf}/mix_targets.parquet')").fetchall())
    for mix in {m for m, _ in rows}:
        assert sum(r.reached_share for r in rows.values() if r.mix == mix) == pytest.approx(1)
    assert rows["balanced", "forum_post"].tokens == 0


def test_edges(spark):
    counts = spark.createDataFrame([(i, "a", 10) for i in range(10)] + [(100, "b", 7)] + [(100, "b", 7)], "doc_id long, source string, n_tokens long")
    schema = "mix string, source string, target_share double, max_repeats int"
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, None), ("m", "c", 0.3, 9), ("m", "d", float("nan"), 1), (None, "a", 0.1, 1), ("n", "a", 1.0, 3), ("n", "b", 0.0, 3), ("n", "b", None, 3)], schema)
    rows = mixing.selection(counts, targets, slack=0).collect()
    m = [r for r in rows if r.mix == "m"]
    assert sum(r.n_tokens for r in m if r.source == "b") == 14  # every b once: the scarcest source sets the size
    assert 10 <= sum(r.n_tokens for r in m if r.source == "a") <= 20
    n = [r for r in rows if r.mix == "n"]
    assert sorted(r.doc_id for r in n) == sorted(list(range(10)) * 3)
    assert mixing.selection(counts.limit(0), targets).count() == 0
    assert mixing.selection(counts, targets.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None, "a", 3), (2, "", "a", 3), (3, "hello there", "a", 3), (None, "x", "a", 3), (5, "y", None, 3)], "doc_id long, text string, source string, n_tokens long")
    assert {r.doc_id for r in mixing.mixed(docs, targets).collect() if r.mix == "n"} == {3, None}
