"""Queries of the operators over observations: changes between captures, closest hosts, mentions, submissions, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import net, text
from lookout.operators import observations
from lookout.sources.tables import table


#: URLs of every verdict.
URLS = ("https://A.example/x", "http://0x7f.1", "ftp://a.example", "http://u@a.example", "http://a.example:8080", "http://a\\b", "http://[::1]/", "http://*.a.example", "http://a.example:x", "http://1.2.3.999", "https://a.example:443/", "", "mailto:x")


def capture_changes(spark, d):
    """What changed between consecutive captures of a case: site, source, language; a null side is unknown, not change."""
    docs = table(spark, d, "documents").where("case_id is not null and captured_at is not null").select("case_id", "doc_id", "captured_at", "site", "source", "lang")
    out = observations.material_changes(docs, ["case_id"], [F.col("captured_at"), F.col("doc_id")], ["site", "source", "lang"], F.date_trunc("hour", "captured_at")).where("changed is not null")
    return out.select("doc_id", "case_id", F.array_join("changed", ",").alias("changed"), F.array_join("unknown", ",").alias("unknown"))


def closest_brands(spark, d):
    """The three brand ids closest to every distinct first label of all deliveries by edit distance; names without one have none."""
    label = F.regexp_extract(F.lower("name"), r"\A(?:\*\.)?([^.]*)", 1)
    words = table(spark, d, "discovery_log").select(label.alias("label")).where("label <> ''")
    return observations.closest(words, "label", table(spark, d, "brand_terms"), "brand", 3)


def mention_totals(spark, d):
    """Brand names in documents: documents and occurrences by phrase, longest phrase first, in any case or look-alike letters."""
    listed = table(spark, d, "brand_terms").select("brand_name").where("brand_name is not null").distinct()
    hits = observations.mentions_of(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", listed, "brand_name")
    flat = hits.select("doc_id", F.explode("mentions").alias("m"))
    return flat.groupBy("m.phrase").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("occurrences"))


def submissions(spark, d):
    """What was submitted by hand, and the names as if submitted: outcome by line, and the host where the line is ASCII."""
    rows = table(spark, d, "discovery_log").where("source = 'manual'")
    lines = rows.select("delivery_id", F.explode(F.array(F.struct(F.lit("line").alias("kind"), F.get_json_object("context_json", "$.submitted").alias("line")), F.struct(F.lit("name").alias("kind"), F.col("name").alias("line")))).alias("l"))
    judged = net.with_submission(lines.select("delivery_id", "l.kind", "l.line"), "line", "s")
    return judged.select("delivery_id", "kind", F.coalesce("s.error", F.lit("accepted")).alias("outcome"), F.when(F.col("line").rlike(r"\A\p{ASCII}*\z"), F.col("s.host")).alias("host"))


def url_verdicts(spark, d):
    """Verdicts, host and port of the URLs that submissions and reference pages name, and of fixed odd ones."""
    found = table(spark, d, "discovery_log").where("source = 'manual'").select(F.get_json_object("context_json", "$.submitted").alias("url"))
    c = table(spark, d, "reference_corpus")
    pages = c.select(F.col("reference_page").alias("url")).unionByName(c.select(F.col("source").alias("url")))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(u) for u in URLS])).alias("url"))
    urls = found.unionByName(pages).unionByName(fixed).where(F.col("url").rlike(r"\A\p{ASCII}*\z")).distinct()
    return net.with_url_verdict(urls, "url", "v").select("url", "v.verdict", "v.host", "v.port")


def sweep_hosts(spark, d):
    """Hosts that sweeps found by target, run and kind of permutation: one event per target, run and host, the last record of which counts."""
    log = table(spark, d, "discovery_log").where("source = 'dnstwist'")
    rows = log.select(F.get_json_object("context_json", "$.target").alias("target"), F.get_json_object("context_json", "$.run_id").cast("long").alias("run_id"), F.get_json_object("context_json", "$.fuzzer").alias("fuzzer"), "name", "delivery_id").where("target is not null and run_id is not null")
    found = observations.sweep_events(rows, "target", "run_id", "delivery_id", "name", "fuzzer")
    return found.groupBy("target", "run_id", "fuzzer").agg(F.count(F.lit(1)).alias("hosts"))


def address_classes_v6(spark, d):
    """Fixed addresses of every kind by class, with the addresses that sweeps saw."""
    log = table(spark, d, "discovery_log").where("source = 'dnstwist'")
    ips = log.select(F.explode(F.from_json(F.get_json_object("context_json", "$.dns.dns_a"), "array<string>")).alias("ip")).distinct()
    fixed = spark.createDataFrame([(x,) for x in ("8.8.8.8", "10.1.2.3", "::1", "fe80::1", "2002:a00:1::", "::ffff:127.0.0.1", "2606:4700::1")], "ip string")
    return ips.unionByName(fixed).distinct().select("ip", net.address_class(F.col("ip")).alias("class"))


def document_excerpts(spark, d):
    """Text around the first number of every document."""
    # Not regexp_instr: it counts UTF-16 units, not characters.
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", (F.length(F.regexp_extract("text", r"\A([^0-9]*)", 1)) + 1).alias("at")).where("text rlike '[0-9]'")
    return t.select("doc_id", text.around(F.col("text"), F.col("at") - 1, F.col("at"), 20, 60).alias("excerpt"))


QUERIES = {f.__name__: f for f in (capture_changes, closest_brands, mention_totals, submissions, url_verdicts, sweep_hosts, address_classes_v6, document_excerpts)}


def _changed(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL AND lag({f}) OVER w IS NOT NULL AND {f} <> lag({f}) OVER w THEN '{f},' ELSE '' END"


def _unknown(f: str) -> str:
    return f"CASE WHEN {f} IS NULL OR lag({f}) OVER w IS NULL THEN '{f},' ELSE '' END"


_FIELDS = ("site", "source", "lang")
ORACLE = {
    "capture_changes": f"""SELECT doc_id, case_id, rtrim(c, ',') AS changed, rtrim(u, ',') AS unknown FROM (
  SELECT doc_id, case_id, row_number() OVER w AS rn, {' || '.join(map(_changed, _FIELDS))} AS c, {' || '.join(map(_unknown, _FIELDS))} AS u
  FROM documents WHERE case_id IS NOT NULL AND captured_at IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY captured_at, doc_id)) WHERE rn > 1""",
    "submissions": r"""WITH l AS (SELECT delivery_id, 'line' AS kind, json_extract_string(context_json, '$.submitted') AS line FROM discovery_log WHERE source = 'manual'
  UNION ALL SELECT delivery_id, 'name', name FROM discovery_log WHERE source = 'manual'),
t AS (SELECT *, regexp_replace(coalesce(line, ''), '^\s+|\s+$', '', 'g') AS t FROM l),
h AS (SELECT *, lower(regexp_replace(CASE WHEN contains(t, '://') THEN regexp_extract(t, '^[A-Za-z]+://([^/?#:]*)', 1) ELSE t END, '\.+$', '')) AS h FROM t),
o AS (SELECT *, CASE WHEN t = '' THEN 'empty or too long' WHEN regexp_matches(t, '[\x00-\x1f\x7f\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]') THEN 'control characters'
  WHEN NOT contains(t, '://') AND regexp_matches(t, '[/?#@: ]') THEN 'not a domain' WHEN starts_with(h, '*.') THEN 'wildcard'
  WHEN regexp_full_match(h, '[\x00-\x7f]*') AND NOT regexp_full_match(h, '[a-z0-9_-]{1,63}(\.[a-z0-9_-]{1,63})*') THEN 'invalid host' ELSE 'accepted' END AS outcome FROM h)
SELECT delivery_id, kind, outcome, CASE WHEN outcome = 'accepted' AND regexp_full_match(line, '[\x00-\x7f]*') THEN h END AS host FROM o""",
    "url_verdicts": r"""WITH u AS (SELECT json_extract_string(context_json, '$.submitted') AS url FROM discovery_log WHERE source = 'manual' UNION SELECT reference_page FROM reference_corpus UNION SELECT source FROM reference_corpus),
a AS (SELECT url, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '\.+$', '')) AS h FROM u WHERE regexp_full_match(url, '[\x00-\x7f]*')),
v AS (SELECT url, h, regexp_full_match(h, '[a-z0-9_-]{1,63}(\.[a-z0-9_-]{1,63})*') AS ok FROM a WHERE starts_with(url, 'http'))
SELECT url, CASE WHEN ok THEN 'ok' ELSE 'invalid_url' END AS verdict, CASE WHEN ok THEN h END AS host, CASE WHEN ok THEN CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END END AS port FROM v
UNION ALL SELECT url, 'scheme_not_allowed', NULL, NULL FROM a WHERE NOT starts_with(url, 'http')
UNION ALL VALUES ('https://A.example/x', 'ok', 'a.example', 443), ('http://0x7f.1', 'ok', '127.0.0.1', 80), ('ftp://a.example', 'scheme_not_allowed', NULL, NULL), ('http://u@a.example', 'userinfo_not_allowed', NULL, NULL),
  ('http://a.example:8080', 'port_not_allowed', NULL, 8080), ('http://a' || chr(92) || 'b', 'invalid_url', NULL, NULL), ('http://[::1]/', 'ok', '::1', 80), ('http://*.a.example', 'invalid_url', NULL, NULL),
  ('http://a.example:x', 'invalid_url', NULL, NULL), ('http://1.2.3.999', 'invalid_url', NULL, NULL), ('https://a.example:443/', 'ok', 'a.example', 443), ('', 'scheme_not_allowed', NULL, NULL), ('mailto:x', 'scheme_not_allowed', NULL, NULL)""",
    "sweep_hosts": """WITH r AS (SELECT json_extract_string(context_json, '$.target') AS target, CAST(json_extract_string(context_json, '$.run_id') AS BIGINT) AS run_id, json_extract_string(context_json, '$.fuzzer') AS fuzzer,
  delivery_id, lower(regexp_replace(regexp_replace(trim(name), '^\\*\\.', ''), '\\.+$', '')) AS host FROM discovery_log WHERE source = 'dnstwist' AND name IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY target, run_id, host ORDER BY delivery_id DESC) AS n FROM r WHERE target IS NOT NULL AND run_id IS NOT NULL AND fuzzer IS DISTINCT FROM '*original')
SELECT target, run_id, coalesce(fuzzer, '') AS fuzzer, count(*) AS hosts FROM p WHERE n = 1 GROUP BY ALL""",
    "address_classes_v6": """WITH a AS (SELECT unnest(CAST(json_extract(context_json, '$.dns.dns_a') AS VARCHAR[])) AS ip FROM discovery_log WHERE source = 'dnstwist' AND json_valid(context_json))
SELECT DISTINCT ip, 'documentation' AS class FROM a WHERE starts_with(ip, '192.0.2.') OR starts_with(ip, '198.51.100.') OR starts_with(ip, '203.0.113.')
UNION ALL VALUES ('8.8.8.8', 'public'), ('10.1.2.3', 'private'), ('::1', 'loopback'), ('fe80::1', 'link_local'), ('2002:a00:1::', '6to4:private'), ('::ffff:127.0.0.1', 'ipv4_mapped:loopback'), ('2606:4700::1', 'public')""",
    # DuckDB's levenshtein counts bytes; brand ids are ASCII, so any other character stands for one that no brand holds.
    "closest_brands": r"""WITH w AS (SELECT DISTINCT regexp_extract(lower(name), '^(\*\.)?([^.]*)', 2) AS word FROM discovery_log WHERE name IS NOT NULL),
p AS (SELECT word, brand AS other, CAST(levenshtein(regexp_replace(word, '[^\x00-\x7f]', '?', 'g'), brand) AS INTEGER) AS distance FROM w, (SELECT DISTINCT brand FROM brand_terms WHERE brand IS NOT NULL) WHERE word <> '')
SELECT word, CAST(place AS INTEGER) AS place, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, other) AS place FROM p) WHERE place <= 3""",
    "document_excerpts": """SELECT doc_id, substr(text, greatest(pos - 21, 0) + 1, least(pos + 20 - greatest(pos - 21, 0), 60)) AS excerpt
FROM (SELECT doc_id, text, length(regexp_extract(text, '^([^0-9]*)', 1)) + 1 AS pos FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[0-9]'))""",
}
