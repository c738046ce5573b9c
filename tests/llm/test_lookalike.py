import re
import unicodedata

import duckdb
import pytest

from lookout.llm import lookalike, q2_lookalike

LOOKS = lookalike.lookalike_map()


def reads(text: str) -> str:
    """Brute force: compatibility forms, look-alikes, case, and nothing that doesn't show."""
    out = []
    for c in unicodedata.normalize("NFD", "".join(LOOKS.get(c, c) for c in text)):
        c = LOOKS.get(c, c)
        for x in unicodedata.normalize("NFKD", c):
            x = LOOKS.get(x, x)
            kind = unicodedata.category(x)
            if kind in ("Zs", "Zl", "Zp", "Cc", "Cf", "Pd", "Pc") or x in "−͏᠋᠌᠍" or 0xFE00 <= ord(x) <= 0xFE0F:
                continue
            out.append(x)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", "".join(out)).lower())


def label(host: str) -> str:
    host = host.strip()
    first = re.split(r"[.。．｡]", host[2:] if host.startswith("*.") else host)[0]
    if first[:4].lower() == "xn--":
        try:
            return first[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return first
    return first


def brute(names, terms):
    by_form: dict[str, list] = {}
    for t, phrase in terms:
        if phrase is not None and reads(phrase):
            by_form.setdefault(reads(phrase), []).append((t, phrase))
    return sorted((i, t) for i, n in names if n is not None for t, p in by_form.get(reads(label(n)), []) if not (label(n) + p).isascii())


def test_whole_table(spark, sf):
    con = duckdb.connect()
    names = con.execute(f"SELECT delivery_id, name FROM read_parquet('{sf}/discovery_log.parquet')").fetchall()
    terms = con.execute(f"SELECT term_id, phrase FROM read_parquet('{sf}/brand_terms.parquet')").fetchall()
    got = sorted(tuple(r) for r in q2_lookalike.p2_found(spark, sf).select("delivery_id", "term_id").collect())
    assert got == brute(names, terms)
    assert got


SAME = ["Dövkasor-Fund", "dövkasorfund", "ｄｏ̈ｖｋａｓｏｒ＿ｆｕｎｄ", "dövka​sor‑fund", "DÖVKASOR fund", "dӧvkаsоr−fund", "\U0001d41dö\U0001d42fkasorfund", "xn--dvkasor-fund-4ib"]


def test_same_and_different(spark):
    assert "xn--" + "dövkasor-fund".encode("punycode").decode() == SAME[-1]
    other = ["dovkasor-fund", "dövkas0r-fund", "dòvkasor-fund", "дövkasor-fund"]
    values = spark.createDataFrame([(x,) for x in [*SAME, *other, None, "", "​-"]], "raw string")
    forms = {r.raw: r.form for r in lookalike.canonical_forms(values).collect()}
    assert len({forms[x] for x in SAME}) == 1
    assert len({forms[x] for x in [SAME[0], *other]}) == 5
    assert None not in forms and "" not in forms and "​-" not in forms


@pytest.mark.parametrize("mark", ["̣́", "̣́"])
def test_order_of_marks(spark, mark):
    values = spark.createDataFrame([("o" + mark,), ("ọ́",), ("o",)], "raw string")
    forms = {r.raw: r.form for r in lookalike.canonical_forms(values).collect()}
    assert forms["o" + mark] == forms["ọ́"] != forms["o"]


def test_nulls_ties_empty_and_clashing_names(spark):
    names = spark.createDataFrame([(1, None, "x"), (None, "brаnd.test", "x"), (2, "*.brаnd.test", "x"), (2, "*.brаnd.test", "x"), (3, "." * 3, "x"), (4, "xn--é.test", "x"), (5, "a" * 100_000, "x")], "id int, name string, raw string")
    terms = spark.createDataFrame([(7, "Brand", "y"), (8, None, "y"), (9, " - ", "y")], "term_id int, phrase string, raw string")
    got = lookalike.matching_terms(names, "id", "name", terms, "term_id", "phrase").collect()
    assert sorted(got, key=str) == sorted([(2, 7), (2, 7), (None, 7)], key=str)
    assert lookalike.matching_terms(names.limit(0), "id", "name", terms, "term_id", "phrase").count() == 0
    assert lookalike.matching_terms(names, "id", "name", terms.limit(0), "term_id", "phrase").count() == 0


def test_hits_beyond_the_broadcast(spark, sf, monkeypatch):
    want = sorted(map(tuple, q2_lookalike.p2_found(spark, sf).collect()))
    monkeypatch.setattr(lookalike, "broadcast_if_small", lambda df, **_: (df, False))
    for share in (1e-3, 0.2):
        monkeypatch.setattr(lookalike, "HOT_SHARE", share)
        assert sorted(map(tuple, q2_lookalike.p2_found(spark, sf).collect())) == want and want
