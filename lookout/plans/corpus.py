"""Queries over documents, brand terms, the reference corpus and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import net, text
from lookout.operators import joins, latest, merge
from lookout.session import broadcast_if_small, materialize
from lookout.sources.tables import table


#: One address for every range that address_classes tells apart, and texts that are none.
ADDRESSES = (
    "0.1.2.3", "10.9.8.7", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.0.0.8", "192.0.2.1", "192.88.99.1", "192.168.1.1", "198.18.0.1", "198.51.100.2",
    "203.0.113.9", "224.0.0.1", "255.255.255.255", "240.0.0.1", "8.8.8.8", "::", "::1", "64:ff9b:1::5", "100::1", "2001::5", "2001:db8::1", "fc00::1", "fe80::1", "fec0::1", "ff02::1",
    "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::a00:1", "::ffff:0:808:808", "::a00:1", "2002:a00:1::", "2002:808:808::1", "2606:4700::1", "1.2.3", "::1::", "x",
)


def _docs(spark, d):
    return table(spark, d, "documents")


def sanitized(spark, d):
    """Whole texts made safe to store: lengths before and after and a digest of the result."""
    clean = text.sanitize(F.col("text"), None)
    return _docs(spark, d).where("text is not null").select("doc_id", F.length("text").alias("n"), F.length(clean).alias("kept"), F.md5(clean).alias("digest"))


def csv_neutralized(spark, d):
    """Whole texts as CSV cells."""
    return _docs(spark, d).select("doc_id", text.neutralize_csv(F.col("text")).alias("cell"))


def sentence_counts(spark, d):
    """Sentences and words by plain rules."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"), text.word_count(F.col("text")).alias("words"))


def numbers_found(spark, d):
    """The first five different numbers of every text in order."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.array_join(text.unique_matches(F.col("text"), r"([0-9]+)", 5, 1), ",").alias("numbers"))


def stable_ids(spark, d):
    return _docs(spark, d).select("doc_id", text.stable_id(F.col("source"), F.col("site"), F.col("doc_id")).alias("event_id"))


def stable_sample(spark, d):
    """A tenth of the documents by hash: a sampling operator."""
    return _docs(spark, d).where(text.sampled(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")), 0.1)).select("doc_id")


def recaptured(spark, d):
    """Texts that were captured more than once: digest, copies, first and last document."""
    docs = _docs(spark, d).where("text is not null and text <> ''")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("copies > 1")


def latest_capture(spark, d):
    """The latest document of every case, with its source."""
    docs = _docs(spark, d).where("case_id is not null")
    return latest.latest_by(docs, ["case_id"], [F.col("captured_at").desc_nulls_last(), F.col("doc_id").desc()]).select("case_id", "doc_id", "source")


def char_quota(spark, d):
    """Documents of every site in order of capture while their characters fit into 20,000: a budget that skips what doesn't fit."""
    from lookout.operators.budget import skipping

    docs = _docs(spark, d).where("site is not null").select("site", "doc_id", "captured_at", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return skipping(docs, ["site"], ["captured_at", "doc_id"], "chars", 20_000).where("accepted").select("site", "doc_id")


def label_pivot(spark, d):
    """Labels of documents, cleaned, one column per annotator."""
    lab = table(spark, d, "subject_labels").where("subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("s"), "annotator")
    said = lambda who: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("annotator") == who, F.col("s")))), ","), F.lit(""))
    return lab.groupBy("doc_id").agg(*[said(who).alias(who) for who in ("a1", "a2", "a3")])


def repeated_phrases(spark, d):
    """Phrases that several rows hold, letter case, blanks and hyphens aside."""
    return table(spark, d, "brand_terms").groupBy(F.regexp_replace(F.lower("phrase"), "[ -]", "").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("term_id").alias("first_term")).where("n > 1")


def brands_without_references(spark, d):
    """Brands of terms that no row of the corpus names, of whatever kind and size."""
    used = table(spark, d, "reference_corpus").where("brand is not null").select("brand").distinct()
    return table(spark, d, "brand_terms").select("brand").distinct().join(used, "brand", "left_anti")


def corpus_rollup(spark, d):
    """Entries by brand and kind: counts, active ones, bytes that are distinct."""
    return table(spark, d, "reference_corpus").groupBy("brand", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"), F.countDistinct(F.lower("sha256")).alias("images"))


def corpus_revalidated(spark, d):
    """Entries with the reason why they would be refused now; null if none."""
    brands = table(spark, d, "brand_terms").select(F.col("brand").alias("_brand")).distinct()
    brands, _ = broadcast_if_small(materialize(brands, "brands"))
    rows = table(spark, d, "reference_corpus").join(brands, F.col("brand") == F.col("_brand"), "left")
    reason = F.when(F.col("_brand").isNull(), "unknown_brand").when(F.col("sha256").isNull(), "no_digest").when(~F.coalesce("active", F.lit(False)), "retired").when((F.col("width") <= 0) | (F.col("height") <= 0), "no_size")
    return rows.select("id", reason.alias("reason"))


def corpus_retired(spark, d):
    """Entries of pages whose later collection doesn't hold the same image any more."""
    c = table(spark, d, "reference_corpus").where("reference_page is not null and collected_at is not null")
    hour = F.date_trunc("hour", "collected_at")
    marked = c.withColumn("h", hour).join(c.groupBy("reference_page").agg(F.max(hour).alias("last")), "reference_page")
    return merge.retired(marked, marked.where("h = last"), ["reference_page", "sha256"], F.col("h") < F.col("last")).select("id", "reference_page")


def closest_references(spark, d):
    """For entries whose id is divisible by 50 the five closest active ones of all brands: equal sha256 first, then fewest differing bits, then id.

    Images of other bytes compare only if both are measurable (luma_stddev, sizes, both hashes) and their aspects close, as
    in the reference; bits is null where the bytes are equal and a hash is missing.
    """
    measurable = (F.col("luma_stddev") >= 12) & ~F.isnan("luma_stddev") & (F.col("width") > 0) & (F.col("height") > 0) & F.col("p").isNotNull() & F.col("d").isNotNull()
    c = table(spark, d, "reference_corpus").where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.nullif(F.lower(F.trim("sha256")), F.lit("")).alias("sha"), text.hash_bits(F.col("phash")).alias("p"), text.hash_bits(F.col("dhash")).alias("d"), "luma_stddev", "width", "height", F.coalesce("active", F.lit(False)).alias("active"),
    )
    c = materialize(c.select("id", "sha", "p", "d", F.when(measurable, F.col("width") / F.col("height")).alias("aspect"), "active"), "references")
    q, e = c.where("id % 50 = 0"), c.where("active")
    near = joins.nearest_hashes(q.where("aspect is not null"), e.where("aspect is not null"), 5, 1.35).select(F.col("left_id").alias("query"), F.col("right_id").alias("entry"), F.lit(1).alias("other"), "bits")
    bits = F.bit_count(F.col("p").bitwiseXOR(F.col("_p"))) + F.bit_count(F.col("d").bitwiseXOR(F.col("_d")))
    same = q.join(e.select(F.col("id").alias("entry"), F.col("sha").alias("_sha"), F.col("p").alias("_p"), F.col("d").alias("_d")), (F.col("sha") == F.col("_sha")) & (F.col("id") != F.col("entry")))
    same = latest.top_per_key(same.select(F.col("id").alias("query"), "entry", F.lit(0).alias("other"), bits.cast("int").alias("bits")), ["query"], [F.col("bits").asc_nulls_last(), F.col("entry")], 5)
    # A copy may be among the nearest too: it counts once.
    pairs = latest.latest_by(same.unionByName(near), ["query", "entry"], [F.col("other")])
    return latest.top_per_key(pairs, ["query"], [F.col("other"), F.col("bits").asc_nulls_last(), F.col("entry")], 5, "place").select("query", "place", "entry", "bits")


def page_hosts(spark, d):
    """Hosts of reference pages and sources."""
    c = table(spark, d, "reference_corpus")
    urls = c.select(F.col("reference_page").alias("url")).unionByName(c.select(F.col("source").alias("url")))
    return urls.select(text.host_of(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def host_owner(spark, d):
    """Hosts of discovery events that equal or lie under a brand's own host; the longest such host wins."""
    c = table(spark, d, "reference_corpus").where("brand is not null")
    own = c.select(text.host_of(F.col("reference_page")).alias("domain"), "brand").where("domain is not null")
    own = own.groupBy(F.regexp_replace("domain", r"\Awww\.", "").alias("domain")).agg(F.min("brand").alias("brand"))
    log = table(spark, d, "discovery_log").where("name is not null").select("delivery_id", F.regexp_replace(F.regexp_replace(F.lower("name"), r"\A\*\.", ""), r"\.+\z", "").alias("host"))
    return joins.suffix_join(log, "host", own, "domain").select("delivery_id", F.col("right.brand").alias("brand"), F.col("right.domain").alias("domain"))


def phrase_contained(spark, d):
    """First labels without hyphens that contain a weak phrase of a brand, phrases of any length."""
    log = table(spark, d, "discovery_log").where("name is not null").select("delivery_id", F.regexp_replace(F.regexp_extract(F.lower("name"), r"\A(?:\*\.)?([^.]*)", 1), "-", "").alias("label"))
    terms = table(spark, d, "brand_terms").where("strength = 'weak'").select(F.lower(F.trim("phrase")).alias("phrase"), "brand").where("phrase <> ''").distinct()
    return joins.contains_join(log, "label", terms, "phrase").select("delivery_id", F.col("right.brand").alias("brand"), F.col("right.phrase").alias("phrase"))


def phrase_fuzzy(spark, d):
    """Distinct first labels without hyphens, and hyphen parts of them, one or two edits from a phrase; the best per label and brand.

    As in the reference, labels and parts count from 6 characters, in any script and of any length.
    """
    label = F.regexp_extract(F.lower("name"), r"\A(?:\*\.)?([^.]*)", 1)
    words = F.array_append(F.split(label, "-"), F.regexp_replace(label, "-", ""))
    labels = table(spark, d, "discovery_log").where("name is not null").select(label.alias("l"), words.alias("w")).distinct().select(F.explode("w").alias("label")).where("length(label) >= 6").distinct()
    terms = table(spark, d, "brand_terms").select(F.lower(F.regexp_replace("phrase", r"[ \-]", "")).alias("phrase"), "brand").where("phrase is not null").distinct()
    # Nothing is lost: two edits change a length by two at most.
    sizes = terms.select(F.explode(F.sequence(F.length("phrase") - 2, F.length("phrase") + 2)).alias("_n")).distinct()
    labels = labels.join(F.broadcast(sizes), F.length("label") == F.col("_n"), "left_semi")
    near = joins.fuzzy_join(labels, "label", terms, "phrase").where("distance > 0").select("label", F.col("right.brand").alias("brand"), F.col("right.phrase").alias("phrase"), "distance")
    return latest.latest_by(near, ["label", "brand"], [F.col("distance"), F.col("phrase")])


def brand_mentions(spark, d):
    """Documents that name a brand, with occurrences."""
    brands = table(spark, d, "brand_terms").select("brand", "brand_name").where("brand_name is not null").distinct()
    docs = _docs(spark, d).where("text is not null").select("doc_id", "text")
    n = F.expr("(length(text) - length(replace(text, brand_name, ''))) div length(brand_name)")
    hit = joins.contains_join(docs, "text", brands, "brand_name", gram=3).select("doc_id", "text", "right.*")
    return hit.select("doc_id", "brand", n.cast("int").alias("mentions"))


def address_classes(spark, d):
    """Addresses that sweeps saw, and a fixed one of every other class, by class."""
    log = table(spark, d, "discovery_log").where("source = 'dnstwist'")
    ips = log.select(F.explode(F.from_json(F.get_json_object("context_json", "$.dns.dns_a"), "array<string>")).alias("ip"))
    fixed = F.explode(F.array(*[F.lit(x) for x in ADDRESSES]))
    rows = ips.unionByName(spark.range(1).select(fixed.alias("ip")))
    return rows.groupBy(net.address_class(F.col("ip")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("addresses"))


def list_caps(spark, d):
    """The first three different sources of every site in order, as a capped list."""
    docs = _docs(spark, d).where("site is not null and source is not null")
    first = docs.groupBy("site", "source").agg(F.min("doc_id").alias("at"))
    return first.groupBy("site").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]), 1, 3), ",").alias("sources"))


def corpus_digest(spark, d):
    """A version of the set of active images per brand: the sha256 of its sorted hashes.

    The hashes of a brand are sorted within 256 buckets of their first byte, and the digest is taken over the buckets'
    digests, so no task holds more than a bucket of a brand.
    """
    c = table(spark, d, "reference_corpus").where("active and sha256 is not null and brand is not null").select("brand", F.lower("sha256").alias("sha")).distinct()
    buckets = c.groupBy("brand", F.substring("sha", 1, 2).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), "\n"), 256).alias("part"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda x: x["part"]), "\n")
    return buckets.groupBy("brand").agg(F.sum("n").alias("images"), F.sha2(parts, 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        sanitized, csv_neutralized, sentence_counts, numbers_found, stable_ids, stable_sample, recaptured, latest_capture, char_quota,
        label_pivot, repeated_phrases, brands_without_references, corpus_rollup, corpus_revalidated, corpus_retired,
        closest_references, page_hosts, host_owner, phrase_contained, phrase_fuzzy, brand_mentions, address_classes, list_caps, corpus_digest,
    )
}

_LABEL = "regexp_replace(regexp_extract(lower(name), '^(\\*\\.)?([^.]*)', 2), '-', '', 'g')"
_HOSTOF = "nullif(lower(regexp_replace(regexp_replace(regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), '^.*@', ''), ':\\d*$', '')), '')"

ORACLE = {
    "sanitized": r"SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(length(c) AS INTEGER) AS kept, md5(c) AS digest FROM (SELECT doc_id, text, (regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\p{Cc}\p{Cf}\x{2028}\x{2029}]', '', 'g')) AS c FROM documents WHERE text IS NOT NULL)",
    "csv_neutralized": r"SELECT doc_id, CASE WHEN regexp_matches(h, '^([\t\r\n]|[\s\p{Z}]*[=+@-])') THEN chr(39) || h ELSE h END AS cell FROM (SELECT doc_id, coalesce(text, '') AS h FROM documents)",
    "stable_sample": "SELECT doc_id FROM documents WHERE CAST(CAST('0x' || substr(sha256('sample:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < 0.1",
    "address_classes": """WITH a AS (SELECT unnest(CAST(json_extract(context_json, '$.dns.dns_a') AS VARCHAR[])) AS ip FROM discovery_log WHERE source = 'dnstwist' AND json_valid(context_json)),
c AS (SELECT ip, 'documentation' AS class FROM a WHERE starts_with(ip, '192.0.2.') OR starts_with(ip, '198.51.100.') OR starts_with(ip, '203.0.113.')
UNION ALL VALUES ('0.1.2.3', 'unspecified'), ('10.9.8.7', 'private'), ('100.64.0.1', 'cgnat'), ('127.0.0.1', 'loopback'), ('169.254.1.1', 'link_local'), ('172.16.0.1', 'private'), ('172.32.0.1', 'public'),
  ('192.0.0.8', 'reserved'), ('192.0.2.1', 'documentation'), ('192.88.99.1', 'reserved'), ('192.168.1.1', 'private'), ('198.18.0.1', 'benchmarking'), ('198.51.100.2', 'documentation'),
  ('203.0.113.9', 'documentation'), ('224.0.0.1', 'multicast'), ('255.255.255.255', 'broadcast'), ('240.0.0.1', 'reserved'), ('8.8.8.8', 'public'), ('::', 'unspecified'), ('::1', 'loopback'),
  ('64:ff9b:1::5', 'nat64_local'), ('100::1', 'reserved'), ('2001::5', 'teredo'), ('2001:db8::1', 'documentation'), ('fc00::1', 'unique_local'), ('fe80::1', 'link_local'), ('fec0::1', 'site_local'),
  ('ff02::1', 'multicast'), ('::ffff:10.0.0.1', 'ipv4_mapped:private'), ('::ffff:8.8.8.8', 'public'), ('64:ff9b::a00:1', 'nat64:private'), ('::ffff:0:808:808', 'ipv4_translated'),
  ('::a00:1', 'ipv4_compatible:private'), ('2002:a00:1::', '6to4:private'), ('2002:808:808::1', '6to4'), ('2606:4700::1', 'public'), ('1.2.3', NULL), ('::1::', NULL), ('x', NULL))
SELECT class, count(*) AS n, count(DISTINCT ip) AS addresses FROM c GROUP BY 1""",
    "sentence_counts": r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS sentences,
  CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL""",
    "numbers_found": """WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 5), ',') AS numbers FROM n""",
    "char_quota": """WITH RECURSIVE o AS (SELECT site, doc_id, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY site ORDER BY captured_at ASC NULLS FIRST, doc_id) AS n FROM documents WHERE site IS NOT NULL),
w AS (SELECT site, doc_id, n, chars <= 20000 AS ok, 20000 - CASE WHEN chars <= 20000 THEN chars ELSE 0 END AS room FROM o WHERE n = 1
  UNION ALL SELECT o.site, o.doc_id, o.n, o.chars <= w.room, w.room - CASE WHEN o.chars <= w.room THEN o.chars ELSE 0 END FROM w JOIN o ON o.site = w.site AND o.n = w.n + 1)
SELECT site, doc_id FROM w WHERE ok""",
    "stable_ids": "SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(site, '') || chr(31) || CAST(doc_id AS VARCHAR)) AS event_id FROM documents",
    "recaptured": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1",
    "latest_capture": "SELECT case_id, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY captured_at DESC NULLS LAST, doc_id DESC) AS rn FROM documents WHERE case_id IS NOT NULL) WHERE rn = 1",
    "label_pivot": """SELECT doc_id, string_agg(DISTINCT s, ',' ORDER BY s) FILTER (WHERE annotator = 'a1') AS a1, string_agg(DISTINCT s, ',' ORDER BY s) FILTER (WHERE annotator = 'a2') AS a2, string_agg(DISTINCT s, ',' ORDER BY s) FILTER (WHERE annotator = 'a3') AS a3
FROM (SELECT doc_id, lower(trim(subject)) AS s, annotator FROM subject_labels WHERE subject IS NOT NULL) GROUP BY doc_id""",
    "repeated_phrases": "SELECT regexp_replace(lower(phrase), '[ -]', '', 'g') AS phrase, count(*) AS n, min(term_id) AS first_term FROM brand_terms GROUP BY 1 HAVING count(*) > 1",
    "brands_without_references": "SELECT DISTINCT brand FROM brand_terms WHERE brand NOT IN (SELECT brand FROM reference_corpus WHERE brand IS NOT NULL)",
    "corpus_rollup": "SELECT brand, kind, count(*) AS n, count(*) FILTER (WHERE active) AS active, count(DISTINCT lower(sha256)) AS images FROM reference_corpus GROUP BY ALL",
    "corpus_revalidated": """SELECT id, CASE WHEN brand IS NULL OR brand NOT IN (SELECT brand FROM brand_terms) THEN 'unknown_brand' WHEN sha256 IS NULL THEN 'no_digest'
  WHEN NOT coalesce(active, false) THEN 'retired' WHEN width <= 0 OR height <= 0 THEN 'no_size' END AS reason FROM reference_corpus""",
    "corpus_retired": """WITH m AS (SELECT *, date_trunc('hour', collected_at) AS h, max(date_trunc('hour', collected_at)) OVER (PARTITION BY reference_page) AS last FROM reference_corpus WHERE reference_page IS NOT NULL AND collected_at IS NOT NULL)
SELECT id, reference_page FROM m a WHERE h < last AND NOT EXISTS (SELECT 1 FROM m b WHERE b.h = b.last AND b.reference_page = a.reference_page AND b.sha256 IS NOT DISTINCT FROM a.sha256)""",
    "closest_references": """WITH c AS (SELECT id, nullif(lower(trim(sha256)), '') AS sha, CAST('0x' || lpad(trim(phash), 16, '0') AS UBIGINT) AS p, CAST('0x' || lpad(trim(dhash), 16, '0') AS UBIGINT) AS d,
  luma_stddev >= 12 AND width > 0 AND height > 0 AS ok, width / height AS aspect, coalesce(active, false) AS active FROM reference_corpus),
p AS (SELECT q.id AS query, e.id AS entry, coalesce(q.sha = e.sha, false) AS same, CAST(bit_count(xor(q.p, e.p)) + bit_count(xor(q.d, e.d)) AS INTEGER) AS bits,
  q.ok AND e.ok AND greatest(q.aspect, e.aspect) <= 1.35 * least(q.aspect, e.aspect) AS fit FROM c q JOIN c e ON q.id <> e.id WHERE q.id % 50 = 0 AND e.active)
SELECT query, place, entry, bits FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY same DESC, bits ASC NULLS LAST, entry) AS INTEGER) AS place FROM p WHERE same OR (fit AND bits IS NOT NULL)) WHERE place <= 5""",
    "page_hosts": f"SELECT host, count(*) AS n FROM (SELECT {_HOSTOF.format(u='reference_page')} AS host FROM reference_corpus UNION ALL SELECT {_HOSTOF.format(u='source')} FROM reference_corpus) WHERE host IS NOT NULL GROUP BY host",
    "host_owner": f"""WITH o AS (SELECT regexp_replace({_HOSTOF.format(u="reference_page")}, '^www\\.', '') AS domain, min(brand) AS brand FROM reference_corpus WHERE brand IS NOT NULL AND reference_page IS NOT NULL GROUP BY 1),
l AS (SELECT delivery_id, regexp_replace(regexp_replace(lower(name), '^\\*\\.', ''), '\\.+$', '') AS host FROM discovery_log WHERE name IS NOT NULL)
SELECT delivery_id, brand, domain FROM (SELECT l.delivery_id, o.brand, o.domain, row_number() OVER (PARTITION BY l.delivery_id ORDER BY length(o.domain) DESC) AS rn FROM l JOIN o ON l.host = o.domain OR ends_with(l.host, '.' || o.domain)) WHERE rn = 1""",
    "phrase_contained": f"""WITH l AS (SELECT delivery_id, {_LABEL} AS label FROM discovery_log WHERE name IS NOT NULL),
t AS (SELECT DISTINCT lower(trim(phrase)) AS phrase, brand FROM brand_terms WHERE strength = 'weak' AND trim(phrase) <> '')
SELECT delivery_id, brand, phrase FROM l JOIN t ON contains(label, phrase)""",
    "brand_mentions": "WITH b AS (SELECT DISTINCT brand, brand_name FROM brand_terms WHERE brand_name IS NOT NULL) SELECT doc_id, brand, CAST((length(text) - length(replace(text, brand_name, ''))) // length(brand_name) AS INTEGER) AS mentions FROM documents JOIN b ON contains(text, brand_name)",
    "list_caps": "SELECT site, array_to_string(list_slice(list(source ORDER BY seen), 1, 3), ',') AS sources FROM (SELECT site, source, min(doc_id) AS seen FROM documents WHERE site IS NOT NULL AND source IS NOT NULL GROUP BY ALL) GROUP BY site",
    "corpus_digest": """WITH c AS (SELECT DISTINCT brand, lower(sha256) AS sha FROM reference_corpus WHERE active AND sha256 IS NOT NULL AND brand IS NOT NULL),
b AS (SELECT brand, substr(sha, 1, 2) AS b, count(*) AS n, sha256(string_agg(sha, chr(10) ORDER BY sha)) AS part FROM c GROUP BY ALL)
SELECT brand, CAST(sum(n) AS BIGINT) AS images, sha256(string_agg(part, chr(10) ORDER BY b)) AS digest FROM b GROUP BY brand""",
}
