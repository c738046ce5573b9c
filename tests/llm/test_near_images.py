import random

import numpy as np
from pyspark.sql import functions as F

from lookout.llm import components, hamming, near_images, oph, q5_near

SCHEMA = "id long, sha256 string, phash string, dhash string, width int, height int, luma_stddev double, brand string, node long"


def alike(a, b):
    if a["sha256"] and b["sha256"] and a["sha256"].strip().lower() == b["sha256"].strip().lower():
        return True
    for x in (a, b):
        if not (x["luma_stddev"] is not None and x["luma_stddev"] >= 12 and x["width"] and x["height"] and x["width"] > 0 and x["height"] > 0 and x["phash"] and x["dhash"]):
            return False
    r, s = a["width"] / a["height"], b["width"] / b["height"]
    bits = lambda k: (int(a[k], 16) ^ int(b[k], 16)).bit_count()
    return max(r, s) <= 1.35 * min(r, s) and bits("phash") <= 10 and bits("dhash") <= 8


def brute(rows):
    rows = [r for r in rows if r["id"] is not None]
    return sorted({(min(a["id"], b["id"]), max(a["id"], b["id"])) for i, a in enumerate(rows) for b in rows[:i] if a["id"] != b["id"] and alike(a, b)})


def test_thresholds_and_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_images, "CROWDED", 5)
    monkeypatch.setattr(near_images, "COUNTED", 1)
    rng, rows = random.Random(3), []
    flip = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(64), n))
    for _ in range(25):
        p, d = rng.getrandbits(64), rng.choice([rng.getrandbits(64), 0xFFFF])
        for fp, fd in ((0, 0), (10, 8), (11, 8), (10, 9), (5, 4), (0, 0)):
            rows.append((len(rows), f"{rng.getrandbits(40):X}", f"{flip(p, fp):x}", f"{flip(d, fd):016X}", rng.choice([100, 130, 140, 0]), 100, rng.choice([11.9, 12.0, 50.0, 50.0]), "b", 1))
    rows += [(900, "AB", None, "1", 1, 1, 20.0, None, None), (901, " ab", "zz", "1", 1, 1, 20.0, None, None), (902, None, "1", "1", None, 1, None, None, None), (None, "ab", "1", "1", 1, 1, 20.0, None, None), (903, "", "1", "1", 1, 1, 20.0, None, None), (904, "", "01", "1", 1, 1, 20.0, None, None), (904, "", "01", "1", 1, 1, 20.0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [r.asDict() | ({"phash": None} if r.phash == "zz" else {}) for r in df.collect()]
    want = brute(plain)
    assert len(want) > 25
    assert sorted((r.id_a, r.id_b) for r in near_images.alike_pairs(df).collect()) == want
    groups = {r.id: r.group_id for r in near_images.alike_groups(df).collect()}
    root = {r["id"]: r["id"] for r in plain if r["id"] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert groups == {i: find(i) for i in root}
    assert near_images.alike_pairs(df.limit(0)).count() == near_images.alike_groups(df.limit(0)).count() == 0


def test_groups_of_the_table(spark):
    """Hashing against the exact pairs: recall of pairs in one group, and no group that the pairs don't connect."""
    sf = "/root/testdata/sf0.1"
    pairs = [(r.id_a, r.id_b) for r in q5_near.p5_found(spark, sf).collect()]
    groups = {r.id: r.group_id for r in q5_near.p5_groups(spark, sf).collect()}
    exact = {r.node: r.group_id for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(pairs) > 4000 and sum(groups[a] == groups[b] for a, b in pairs) > 0.99 * len(pairs)
    found = {}
    for i, g in groups.items():
        found.setdefault(g, set()).add(exact.get(i, i))
    assert all(len(v) == 1 for v in found.values()) and all(min(i for i in groups if groups[i] == g) == g for g in list(found)[:50])


def test_recall_of_star_edges(spark):
    rows = near_images.prepared(spark.read.parquet("/root/testdata/sf0.1/reference_corpus.parquet"))
    looks = near_images.looks_of(rows)
    edges = {(r.a, r.b) for r in near_images.oph_edges(looks).collect()}
    nodes = looks.select(F.col("rep").alias("node"), "p", "d").groupBy("p", "d").agg(F.min("node").alias("node"))
    reps = [r for r in looks.collect()]
    by_hash = {}
    for r in reps:
        by_hash.setdefault((r.p, r.d), []).append(r)
    at = {r.node: by_hash[r.p, r.d] for r in nodes.collect()}
    close = [(x, y) for r in near_images.node_pairs(nodes).collect() for x in at[r.a] for y in at[r.b]] + [(x, y) for v in at.values() for x in v for y in v if x.rep < y.rep]
    true = {(min(x.rep, y.rep), max(x.rep, y.rep)) for x, y in close if max(x.aspect, y.aspect) <= min(x.aspect, y.aspect) * 1.35}
    assert edges <= true and len(edges) > 0.95 * len(true)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.group_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketches_estimate_similarity():
    rng, errors = np.random.default_rng(1), []
    for _ in range(200):
        all_ = rng.integers(0, 1 << 60, 150)
        a, b = all_[:100], all_[50:]
        errors.append((oph.sketch(a) == oph.sketch(b)).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert oph.sketch(np.array([], np.int64)) is None
    assert (oph.sketch(np.array([5], np.int64)) == oph.sketch(np.array([5, 5], np.int64))).all()


def test_star_edges_bound_pairs(spark):
    buckets = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 2), (300, 2), (7, 3)], "item_id long, key long")
    got = {(r.hub, r.item_id) for r in oph.star_edges(buckets).collect()}
    (hub,) = {h for h, i in got if i < 100}
    assert {i for h, i in got if h == hub} == set(range(100)) - {hub} and len(got) == 100
    assert {frozenset(e) for e in got if max(e) >= 200} == {frozenset((200, 300))}


def test_whole_batches_sketch_as_single_sets():
    rng = np.random.default_rng(2)
    present = rng.random((50, 256)) < 0.3
    for n in range(2):
        many = oph.subset_sketches(present, 128, n)
        for row, s in zip(present, many):
            assert (oph.sketch(np.flatnonzero(row), 128, n) == s).all()
        assert (oph.band_keys(many, 8, n)[3] == oph.band_keys(many[3], 8, n)).all()


def test_buckets_find_every_pair_once_by_each_search():
    """Random and equal dhash; compared in full, by the rest of the block, and by quarters of phash; whole and split buckets."""
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(64), n))
    for base in (None, 0x5555):
        hashes = []
        for _ in range(150):
            p, d = rng.getrandbits(64), rng.getrandbits(64) if base is None else base
            hashes += [(p, d), (flip(p, rng.randint(0, 11)), flip(d, rng.randint(0, 9))), (flip(p, 10), flip(d, 8))]
        p, d = (np.array(x, np.uint64) for x in zip(*hashes))
        want = sorted((i, j) for j, (p2, d2) in enumerate(hashes) for i, (p1, d1) in enumerate(hashes[:j]) if (p1 ^ p2).bit_count() <= 10 and (d1 ^ d2).bit_count() <= 8)
        for parts, most, few in ((1, 2000, 10**6), (1, 10**6, 0), (1, 0, 0), (len(hamming.PARTS), 10**6, 0)):
            got = []
            for n, (at, width) in enumerate(hamming.PIECES):
                for m, (first, bits) in enumerate(hamming.PARTS[:parts]):
                    key = (d >> np.uint64(at) & np.uint64((1 << width) - 1)) << np.uint64(8) | (p >> np.uint64(first) & np.uint64((1 << bits) - 1)) * np.uint64(parts > 1)
                    for value, size in zip(*np.unique(key, return_counts=True)):
                        if size > 1:
                            at_ = np.flatnonzero(key == value)
                            i, j = hamming.close_pairs(p[at_].view(np.int64), d[at_].view(np.int64), n, m if parts > 1 else None, most, few if parts == 1 or size > 3 else 10**6)
                            got += [tuple(sorted(x)) for x in zip(at_[i].tolist(), at_[j].tolist())]
            assert sorted(got) == want and len(want) > 150


def test_rows_of_a_node_and_nothing_broadcast(spark, monkeypatch):
    """The search makes nine rows of a node (67 before), and asks for no broadcast, whose table the driver would hold."""
    sizes = []
    real = near_images._keys
    monkeypatch.setattr(near_images, "_keys", lambda bits, pieces: sizes.append(len(pieces)) or real(bits, pieces))
    nodes = spark.range(600).select(F.xxhash64("id").alias("p"), F.lit(7).cast("long").alias("d")).localCheckpoint()
    plan = near_images.hash_pairs(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert sizes == [9] and "broadcast" not in plan.lower()


def test_records_of_one_id_and_several_looks(spark):
    """An id twice with different hashes joins the pairs of each, not those of one to those of the other."""
    far = "ffffffffffffffff"
    rows = [(5, None, "0", "0", 1, 1, 20.0, None, None), (5, None, far, far, 1, 1, 20.0, None, None), (6, None, "0", "0", 1, 1, 20.0, None, None), (7, None, far, far, 1, 1, 20.0, None, None)]
    assert sorted(map(tuple, near_images.alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect())) == [(5, 6), (5, 7)]


def test_texts_that_are_no_sha256_stay_apart(spark):
    texts = ["0f", "f", "ab" * 32, "AB" * 32, "ab" * 31, "zz" * 32, " 0F ", "ab" * 33]
    rows = [(i, t, None, None, 1, 1, 0.0, None, None) for i, t in enumerate(texts)]
    assert sorted(map(tuple, near_images.alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect())) == [(0, 6), (2, 3)]
