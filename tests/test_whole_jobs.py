"""Queries do the whole job: cases that a smaller one would lose, on small tables, against brute force."""

import importlib

import __spark_entry__ as entry

CORE = {n: f for m in entry._CORE for n, f in importlib.import_module(m).QUERIES.items()}


def run(spark, folder, name, **tables):
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return CORE[name](spark, str(folder)).collect()


def test_closest_references(spark, tmp_path):
    import random

    r = random.Random(7)
    rows = []
    for i in range(1, 401):
        p, d = r.getrandbits(64) >> r.choice((0, 0, 9)), r.getrandbits(64)
        rows.append([i, f"b{i % 7}", f"S{i if i % 40 else 0}", f"{p:x}", f"{d:016X}", *r.choice(((32, 32), (40, 32), (90, 32), (0, 32))), r.choice((3.0, 20.0, 30.0)), r.random() < 0.8])
    rows[49][2:4] = ["S0", None]
    schema = "id long, brand string, sha256 string, phash string, dhash string, width int, height int, luma_stddev double, active boolean"
    got = run(spark, tmp_path, "closest_references", reference_corpus=spark.createDataFrame([tuple(x) for x in rows], schema))

    def distance(a, b):
        return None if None in (a[3], b[3]) else sum((int(a[c], 16) ^ int(b[c], 16)).bit_count() for c in (3, 4))

    def seen(x):
        return x[3] is not None and x[7] >= 12 and x[5] > 0 and x[6] > 0

    expected = []
    for q in rows[49::50]:
        found = []
        for e in rows:
            if e[0] == q[0] or not e[8]:
                continue
            if e[2] == q[2]:
                found.append((0, distance(q, e) is None, distance(q, e) or 0, e[0]))
            elif seen(q) and seen(e) and max(q[5] / q[6], e[5] / e[6]) <= min(q[5] / q[6], e[5] / e[6]) * 1.35:
                found.append((1, False, distance(q, e), e[0]))
        expected += [(q[0], n, e, None if none else bits) for n, (_, none, bits, e) in enumerate(sorted(found)[:5], 1)]
    assert sorted(map(tuple, got)) == expected and len(expected) > 20


def test_csv_neutralized(spark, tmp_path):
    long = "word " * 600 + "=end"
    docs = spark.createDataFrame([(1, long), (2, "=" + long), (3, "　 @" + long), (4, None), (5, "a=b")], "doc_id long, text string")
    got = dict(map(tuple, run(spark, tmp_path, "csv_neutralized", documents=docs)))
    assert got == {1: long, 2: "'=" + long, 3: "'　 @" + long, 4: "", 5: "a=b"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_phrase_fuzzy(spark, tmp_path):
    phrases = [("Quil Bank", "q"), ("quilbanks", "q"), ("quilkasorà", "k"), ("marberilo springs and kitchen house", "m"), ("zem0", "z"), ("harbor 24", "h"), (None, "n")]
    names = ["quilbamk.example", "my-quilbnk-online.test", "QUILKASORA.example", "*.quilkaşorà.test", "xmarberilospringsandkitchenhouse.test", "marberilo-springs-and-kitchen-hous.test", "azem0x.test", "zemo.test", "a-harbro24.test", "quilbank.test", "unrelated-name.test", None]
    terms = spark.createDataFrame(phrases, "phrase string, brand string")
    got = run(spark, tmp_path, "phrase_fuzzy", brand_terms=terms, discovery_log=spark.createDataFrame([(n,) for n in names], "name string"))
    words = {w for n in names if n for label in [n.lower().removeprefix("*.").split(".")[0]] for w in (label.replace("-", ""), *label.split("-")) if len(w) >= 6}
    best = {}
    for w in words:
        for p, b in phrases:
            p = p and p.lower().replace(" ", "").replace("-", "")
            if p and 0 < (n := edits(w, p)) <= 2:
                best[w, b] = min(best.get((w, b), (9, "")), (n, p))
    assert {(r.label, r.brand): (r.distance, r.phrase) for r in got} == best and len(got) == len(best) >= 8


def test_closest_brands(spark, tmp_path):
    brands = ["quil-bank", "zem-field", "lum-trust", "quil-banc", None]
    log = [("manual", "quilbank.test"), ("certstream", "*.QUIL-bänk.example"), ("dnstwist", "xn--zemfeld-abc.test"), ("certstream", "лум-trust"), (None, "a_b.test"), ("certstream", "zem-field.test"), ("certstream", "zem-field.example"), ("manual", None), ("manual", ".")]
    got = run(spark, tmp_path, "closest_brands", brand_terms=spark.createDataFrame([(b,) for b in brands], "brand string"), discovery_log=spark.createDataFrame(log, "source string, name string"))
    words = {n.lower().removeprefix("*.").split(".")[0] for _, n in log if n and n != "."}
    expected = [(w, i, b, n) for w in words for i, (n, b) in enumerate(sorted((edits(w, b), b) for b in brands if b)[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) == 18


def test_mention_totals(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Quil Bank, " * 700 + "and Zem Field"), (2, "quil bank"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("Quil Bank",), ("Zem Field",), ("Lum Trust",)], "brand_name string")
    got = run(spark, tmp_path, "mention_totals", documents=docs, brand_terms=terms)
    assert sorted(map(tuple, got)) == [("Quil Bank", 2, 701), ("Zem Field", 1, 1)]


def test_brands_without_references(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "favicon", 32), ("b", "logo", 200), ("c", "favicon", 16), ("d", "qr", None), (None, "favicon", 32)], "brand string, kind string, width int")
    got = run(spark, tmp_path, "brands_without_references", reference_corpus=corpus, brand_terms=spark.createDataFrame([(b,) for b in "aabcde"], "brand string"))
    assert [r.brand for r in got] == ["e"]


def test_trailing_day_jobs(spark, tmp_path):
    rows = [("fetch", "2023-01-03 05:00:00", "2023-01-06 00:00:00"), ("fetch", "2023-01-02 05:00:01", "2023-01-02 06:00:00"), ("fetch", "2023-01-02 05:00:00", None), ("media", "2023-01-02 20:00:00", None), ("extract", "2023-01-01 01:00:00", None), ("fetch", None, None)]
    jobs = spark.createDataFrame(rows, "stage string, c string, u string").selectExpr("stage", "timestamp(c) AS created_at", "timestamp(u) AS updated_at")
    got = run(spark, tmp_path, "trailing_day_jobs", job_rows=jobs)
    assert sorted(map(tuple, got)) == [("fetch", 2), ("media", 1)]


def test_name_matches(spark, tmp_path):
    terms = [("q", "Q Air", "qx7", "strong"), ("z", "Z", "Z-9", "weak"), ("e", "E", " - ", "strong"), ("n", "N", None, "weak")]
    log = [(1, "flyqx7now.test"), (2, "z9.example"), (3, "other.test")]
    got = run(spark, tmp_path, "name_matches", brand_terms=spark.createDataFrame(terms, "brand string, brand_name string, phrase string, strength string"), discovery_log=spark.createDataFrame(log, "delivery_id long, name string"))
    assert {r.delivery_id: r.hits for r in got} == {1: "keyword:qx7", 2: "token:z9"}
