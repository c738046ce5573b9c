"""Queries that bring several tables together: status, evidence and reports of cases, attribution, replay from a checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import text
from lookout.operators import budget, cases, extractors, joins, latest
from lookout.operators.quotient import hex_id
from lookout.plans.cases import _J, _cases, _of_cases
from lookout.session import materialize
from lookout.sources.tables import table


def status(spark, d):
    """All counters of the state at once: queue by status, cases by status and priority, runs, events by source, corpus."""

    def counted(rows, part, key):
        return rows.groupBy(F.coalesce(key.cast("string"), F.lit("")).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "item", "n")

    c = _cases(spark, d)
    runs = table(spark, d, "replay_runs")
    parts = [
        counted(table(spark, d, "job_rows"), "queue", F.col("status")),
        counted(c, "cases", F.col("status")),
        counted(c, "priorities", F.col("priority")),
        counted(runs, "runs", F.when(F.col("records").isNull(), "aborted").otherwise("finished")),
        counted(table(spark, d, "discovery_log"), "events", F.col("source")),
        counted(table(spark, d, "reference_corpus"), "corpus", F.when(F.coalesce("active", F.lit(False)), "active").otherwise("retired")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_bundles(spark, d):
    """Per case one JSON document: host, domain, score, priority, its jobs by stage, its captures by source, and the brands they name.

    Everything is counted before it is put together, so a bundle holds a line for each stage, source and brand, whatever
    the case holds.
    """
    c = _cases(spark, d).select("case_id", "host", "domain", "score", "priority")
    stages = _of_cases(spark, d).groupBy("case_id", "stage").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
    docs = table(spark, d, "documents").where("case_id is not null")
    sources = docs.groupBy("case_id", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("captures"))
    brands = table(spark, d, "brand_terms").where("brand_name is not null").select("brand", "brand_name").distinct()
    named = joins.contains_join(docs.where("text is not null").select("case_id", "text"), "text", brands, "brand_name").select("case_id", F.col("right.brand").alias("brand")).groupBy("case_id", "brand").agg(F.count(F.lit(1)).alias("documents"))
    listed = lambda rows, name, *fields: rows.groupBy(F.col("case_id").alias(f"_{name}")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = c
    for rows, name, fields in ((stages, "stages", ("stage", "jobs", "failed")), (sources, "captures", ("source", "captures")), (named, "brands", ("brand", "documents"))):
        side = listed(rows, name, *fields)
        out = out.join(side, F.col("case_id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    bundle = F.to_json(F.struct("case_id", "host", "domain", "score", "priority", "stages", "captures", "brands"))
    return out.select("case_id", bundle.alias("bundle"))


def case_reports(spark, d):
    """Per case a report in lines of text: host, score, sources and the outcomes of its jobs."""
    c = _cases(spark, d)
    per = _of_cases(spark, d).groupBy("case_id", cases.outcome(F.col("last_error")).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    outcomes = per.groupBy(F.col("case_id").alias("_c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "n"))), lambda x: F.concat_ws(" ", x["o"], x["n"])), ", ").alias("outcomes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(text.sanitize(value), F.lit("-")))
    report = F.concat_ws("\n", F.concat(F.lit("case "), F.col("case_id")), line("host", F.col("host")), line("priority", F.concat_ws(" ", "priority", "score")), line("sources", F.nullif("sources", F.lit(""))), line("outcomes", F.col("outcomes")))
    return c.join(outcomes, F.col("case_id") == F.col("_c"), "left").select("case_id", report.alias("report"))


def media_status(spark, d):
    """Per case the state of its media jobs as one: failed if any failed, waiting if any waits or runs, else done."""
    jobs = _of_cases(spark, d).where("stage = 'media'")
    rolled = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status").isin("pending", "running")), "waiting").otherwise("done")
    return jobs.groupBy("case_id").agg(rolled.alias("media"), F.count(F.lit(1)).alias("jobs"))


def brand_strength(spark, d):
    """Brands with the strongest of their terms' strengths, and their different names."""
    t = table(spark, d, "brand_terms").where("brand is not null")
    return t.groupBy("brand").agg(F.max(F.when(F.col("strength") == "strong", "strong").otherwise("")).alias("_s"), F.countDistinct("brand_name").alias("names")).select("brand", F.when(F.col("_s") == "strong", "strong").otherwise("weak").alias("strength"), "names")


def dns_values(spark, d):
    """Per host that sweeps resolved its different addresses in numeric order, at most twenty, and how many there are."""
    log = table(spark, d, "discovery_log").where("source = 'dnstwist' and name is not null")
    ips = log.select(F.lower("name").alias("host"), F.explode(F.from_json(F.get_json_object("context_json", "$.dns.dns_a"), "array<string>")).alias("ip")).where("ip is not null").distinct()
    numbered = ips.select("host", "ip", F.coalesce(text.ipv4_number(F.col("ip")), F.lit(-1)).alias("number"))
    few = latest.top_per_key(numbered, ["host"], [F.col("number"), F.col("ip")], 20)
    count = ips.groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("addresses"))
    lists = few.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "ip"))), lambda x: x["ip"]), ",").alias("values"))
    return lists.join(count, F.col("host") == F.col("_h")).select("host", "values", "addresses")


#: Content-Type headers of all sorts.
CONTENT_TYPES = ("text/html; charset=UTF-8", " Text/HTML ;Charset=\"iso-8859-1\"; x=y", "image/png", "", "application/ld+json;charset='utf-8'", "nonsense", "text/plain; charset=")


def media_types(spark, d):
    """Media type and charset of fixed Content-Type headers."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CONTENT_TYPES])).alias("header"))
    kind = F.lower(F.trim(F.regexp_extract("header", r"\A([^;]*)", 1)))
    charset = F.lower(F.regexp_extract("header", r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1))
    return rows.select("header", F.when(kind.rlike(r"\A[a-z0-9.+*-]+/[a-z0-9.+*-]+\z"), kind).alias("media_type"), F.nullif(charset, F.lit("")).alias("charset"))


SLACK_SECONDS, ATTRIBUTED_SECONDS = 300, 120


def replay_since(spark, d):
    """Per segment what a replay from a checkpoint takes in again: rows logged from 300 s before the last finished run on, and the new events among them.

    The checkpoint is the start of the latest finished run that began before the log's end. An event is new if no row before the slack holds its id.
    """
    # Single values reach the driver; null, of a table without such runs, takes nothing in.
    end = table(spark, d, "discovery_log").agg(F.unix_micros(F.max("logged_at"))).first()[0]
    at = table(spark, d, "replay_runs").where(F.col("records").isNotNull() & (F.unix_micros("started_at") <= F.lit(end))).agg(F.unix_micros(F.max("started_at"))).first()[0]
    log = table(spark, d, "discovery_log").where("logged_at is not null").select("segment", "logged_at", hex_id(F.col("event_id")).alias("id"))
    marked = log.withColumn("again", F.coalesce(F.unix_micros("logged_at") >= F.lit(at) - SLACK_SECONDS * 1_000_000, F.lit(False)))
    first = marked.where("id is not null").groupBy("id").agg(F.bool_and("again").alias("_new"), F.min("segment").alias("_segment"))
    again = marked.where("again").groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))
    new = first.where("_new").groupBy("_segment").agg(F.count(F.lit(1)).alias("events"))
    return again.join(new, F.col("segment") == F.col("_segment"), "left").select("segment", "rows", F.coalesce("events", F.lit(0)).alias("new_events"))


def attributed_skips(spark, d):
    """Per log the entries skipped between indexes, and those of them within 120 s after the end of a gap of over 60 s: lost to the gap.

    Gaps and skips come from ranges of time and of message numbers; an as-of join in ranges of time finds the gap before.
    """
    m = table(spark, d, "cert_messages").where("data.source.name is not null and received_at is not null").select(F.col("data.source.name").alias("log"), "msg_id", F.col("received_at").alias("at"), F.col("data.cert_index").alias("i"))
    m = materialize(m, "feed")
    gaps = budget.gaps(m, ["log"], "at", "msg_id", 60).select("log", "gap_end", F.col("gap_end").alias("ended"))
    run = latest.running_max_before(m.where("i is not null"), ["log"], "msg_id", "i", "_top")
    skips = run.where("i - _top > 1").select("log", "at", (F.col("i") - F.col("_top") - 1).alias("skipped"))
    found = latest.as_of(skips, gaps, ["log"], "at", "gap_end", ["ended"], bucket_seconds=3600)
    near = F.coalesce(F.unix_micros("at") - F.unix_micros("ended") <= ATTRIBUTED_SECONDS * 1_000_000, F.lit(False))
    return found.groupBy("log").agg(F.sum("skipped").alias("skipped"), F.sum(F.when(near, F.col("skipped")).otherwise(0)).alias("after_gaps"))


def text_facts(spark, d):
    """Texts by what the registered extractors find: payees, prices, cues, claims."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    facts, _ = extractors.of_texts().apply(docs)
    f = F.col("facts")
    has = {"payees": F.size(f["payments"]["vpas"]) + F.size(f["payments"]["links"]) > 0, "calls": F.size(f["commerce"]["calls"]) > 0, "disclaimers": F.size(f["editorial"]["disclaimers"]) > 0, "official": F.size(f["official"]) > 0}
    return facts.select(*[c.alias(n) for n, c in has.items()]).groupBy(*has).agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (status, evidence_bundles, case_reports, media_status, brand_strength, dns_values, media_types, replay_since, attributed_skips, text_facts)}

_ID = "lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g'))"
_TEXTS = "(SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)"

ORACLE = {
    "status": _J
    + """SELECT 'queue' AS part, coalesce(status, '') AS item, count(*) AS n FROM job_rows GROUP BY 2 UNION ALL SELECT 'cases', status, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'priorities', priority, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'runs', CASE WHEN records IS NULL THEN 'aborted' ELSE 'finished' END, count(*) FROM replay_runs GROUP BY 2 UNION ALL SELECT 'events', coalesce(source, ''), count(*) FROM discovery_log GROUP BY 2
UNION ALL SELECT 'corpus', CASE WHEN coalesce(active, false) THEN 'active' ELSE 'retired' END, count(*) FROM reference_corpus GROUP BY 2""",
    "evidence_bundles": _J
    + """, st AS (SELECT case_id, string_agg('{"stage":"' || stage || '","jobs":' || jobs || ',"failed":' || failed || '}', ',' ORDER BY stage) AS l FROM (SELECT case_id, stage, count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed FROM j GROUP BY ALL) GROUP BY case_id),
so AS (SELECT case_id, string_agg('{"source":"' || source || '","captures":' || n || '}', ',' ORDER BY source) AS l FROM (SELECT case_id, coalesce(source, '') AS source, count(*) AS n FROM documents WHERE case_id IS NOT NULL GROUP BY ALL) GROUP BY case_id),
bn AS (SELECT DISTINCT brand, brand_name FROM brand_terms WHERE brand_name IS NOT NULL),
br AS (SELECT case_id, string_agg('{"brand":"' || brand || '","documents":' || n || '}', ',' ORDER BY brand) AS l FROM (SELECT case_id, brand, count(*) AS n FROM documents JOIN bn ON contains(text, brand_name) WHERE case_id IS NOT NULL GROUP BY ALL) GROUP BY case_id)
SELECT c.case_id, '{"case_id":' || c.case_id || coalesce(',"host":"' || host || '"', '') || coalesce(',"domain":"' || domain || '"', '') || ',"score":' || score || ',"priority":"' || priority || '"' ||
  coalesce(',"stages":[' || st.l || ']', '') || coalesce(',"captures":[' || so.l || ']', '') || coalesce(',"brands":[' || br.l || ']', '') || '}' AS bundle
FROM c LEFT JOIN st USING (case_id) LEFT JOIN so USING (case_id) LEFT JOIN br USING (case_id)""",
    "case_reports": _J
    + """, oc AS (SELECT case_id, CASE WHEN coalesce(trim(last_error), '') = '' THEN 'ok' WHEN regexp_matches(lower(last_error), 'timeout|timed out') THEN 'timeout' WHEN contains(last_error, 'refused') THEN 'refused'
  WHEN contains(last_error, 'reset') THEN 'reset' WHEN contains(last_error, 'lease') THEN 'lease' ELSE 'other' END AS o, count(*) AS n FROM j GROUP BY ALL),
ol AS (SELECT case_id, string_agg(o || ' ' || n, ', ' ORDER BY o) AS l FROM oc GROUP BY case_id)
SELECT c.case_id, 'case ' || c.case_id || chr(10) || 'host: ' || coalesce(host, '-') || chr(10) || 'priority: ' || priority || ' ' || score || chr(10) || 'sources: ' || coalesce(nullif(sources, ''), '-') || chr(10) || 'outcomes: ' || coalesce(l, '-') AS report FROM c LEFT JOIN ol USING (case_id)""",
    "media_status": _J
    + "SELECT case_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('pending', 'running')) THEN 'waiting' ELSE 'done' END AS media, count(*) AS jobs FROM j WHERE stage = 'media' GROUP BY case_id",
    "brand_strength": "SELECT brand, CASE WHEN bool_or(strength = 'strong') THEN 'strong' ELSE 'weak' END AS strength, count(DISTINCT brand_name) AS names FROM brand_terms WHERE brand IS NOT NULL GROUP BY brand",
    "dns_values": """WITH a AS (SELECT DISTINCT lower(name) AS host, unnest(CAST(json_extract(context_json, '$.dns.dns_a') AS VARCHAR[])) AS ip FROM discovery_log WHERE source = 'dnstwist' AND name IS NOT NULL AND json_valid(context_json)),
n AS (SELECT host, ip, list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda x, y: x * 256 + y) AS v FROM a WHERE ip IS NOT NULL)
SELECT host, array_to_string(list_slice(list(ip ORDER BY v, ip), 1, 20), ',') AS "values", count(*) AS addresses FROM n GROUP BY host""",
    "media_types": """SELECT * FROM (VALUES ('text/html; charset=UTF-8', 'text/html', 'utf-8'), (' Text/HTML ;Charset="iso-8859-1"; x=y', 'text/html', 'iso-8859-1'), ('image/png', 'image/png', NULL), ('', NULL, NULL),
  ('application/ld+json;charset=''utf-8''', 'application/ld+json', 'utf-8'), ('nonsense', NULL, NULL), ('text/plain; charset=', 'text/plain', NULL)) v(header, media_type, charset)""",
    "replay_since": f"""WITH r AS (SELECT max(started_at) AS at0 FROM replay_runs WHERE records IS NOT NULL AND started_at <= (SELECT max(logged_at) FROM discovery_log)),
l AS (SELECT segment, logged_at >= at0 - INTERVAL 300 SECOND AS again, CASE WHEN regexp_full_match({_ID}, '[0-9a-f]{{64}}') THEN {_ID} END AS id FROM discovery_log, r WHERE logged_at IS NOT NULL),
f AS (SELECT id, bool_and(again) AS fresh, min(segment) AS seg FROM l WHERE id IS NOT NULL GROUP BY id)
SELECT segment, count(*) AS rows, (SELECT count(*) FROM f WHERE fresh AND seg = l.segment) AS new_events FROM l WHERE again GROUP BY segment""",
    "text_facts": r"""WITH f AS (SELECT regexp_matches(t, '(^|[^\w.@-])([a-z0-9][a-z0-9._-]{1,255}@[a-z][a-z0-9]{1,63})($|[^\w@.-]|\.($|[^a-z0-9]))|://pay\?') AS payees,
  regexp_matches(t, '(^|[^a-z])(add\s+to\s+(cart|bag|basket)|buy\s+now|book\s+now|shop\s+now|order\s+now|pay\s+now|checkout|check\s+out|proceed\s+to\s+pay(ment)?|purchase|enroll?\s+now|register\s+now|book\s+(a|your)\s+\w+|get\s+tickets?)([^a-z]|$)') AS calls,
  regexp_matches(t, '(^|[^a-z])(not\s+(affiliated|associated|connected|endorsed|sponsored)|no\s+affiliation|unofficial|fan\s+(site|page)|independent\s+(of|from)|disclaimer)([^a-z]|$)') AS disclaimers,
  regexp_matches(t, '(^|[^a-z])official\s+(website|web\s+site|site|page|address|store|shop|portal|account)([^a-z]|$)') AS official FROM (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL))
SELECT *, count(*) AS documents FROM f GROUP BY ALL""",
    "attributed_skips": """WITH m AS (SELECT data.source.name AS log, msg_id, received_at AS at0, data.cert_index AS i FROM cert_messages WHERE data.source.name IS NOT NULL AND received_at IS NOT NULL),
g AS (SELECT log, at0 AS gap_end FROM (SELECT log, at0, at0 - lag(at0) OVER (PARTITION BY log ORDER BY at0, msg_id) AS gap FROM m) WHERE gap > INTERVAL 60 SECOND),
s AS (SELECT log, at0, i - max(i) OVER (PARTITION BY log ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS skipped FROM m WHERE i IS NOT NULL)
SELECT log, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(coalesce(sum(skipped) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.log = s.log AND g.gap_end <= s.at0 AND s.at0 - g.gap_end <= INTERVAL 120 SECOND)), 0) AS BIGINT) AS after_gaps FROM s WHERE skipped > 0 GROUP BY log""",
}
