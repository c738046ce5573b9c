"""Queries of what texts say: payments, payees, commerce, claims, editorial cues, image choice, providers.

Captured texts of the tables hold few of these, so fixed texts of every kind go with them, under negative ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.functions import claims, text
from lookout.operators import joins, latest
from lookout.session import materialize
from lookout.sources.tables import table

#: Texts of every kind.
SAMPLES = (
    (-1, "Donate now: upi://pay?pa=Seva.Fund@okbank&pn=Seva%20Fund&am=501&cu=INR or to seva.fund@okbank and relief@ybl. Mail us at help@desk.example."),
    (-2, "Account No: 0001 2345 6789 IFSC hdfc0001234. A/C 12-34 is none. Account number 0001-2345-6789 again."),
    (-3, "Only Rs. 1,499.00 or 20 USD today! Add to cart, then proceed to payment. Shop now."),
    (-4, "This fan site is not affiliated with anyone. Critics alleged fraud; the shop declined to comment."),
    (-5, "This is the official website of Lumina. We are not the official store of Lumina."),
    (-6, "gpay://pay?pn=No%20Payee and phonepe://pay?pa=a.b@upi&tn=Gift%20for%20you#x"),
    (-7, ""),
)
#: Payees that are known: identifier, owner. And hosts of payment providers.
PAYEES = (("seva.fund@okbank", "seva"), ("000123456789", "seva"), ("other@upi", "other"))
PROVIDERS = (("example", "plainpay"), ("pay.example", "examplepay"), ("site.invalid", "sitepay"))


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(SAMPLES, "doc_id long, text string")).where("text is not null")


def _flat(column) -> F.Column:
    return F.array_join(column, "|")


def text_payments(spark, d):
    """Payment identifiers and donation cues of all texts that have any."""
    p = F.col("p")
    rows = _texts(spark, d).select("doc_id", claims.payments(F.col("text")).alias("p"))
    links = F.array_join(F.transform("p.links", lambda x: F.concat_ws(",", x["payee"], x["payee_name"], x["amount"], x["currency"], x["note"])), "|")
    out = rows.select("doc_id", links.alias("links"), _flat(p["vpas"]).alias("vpas"), _flat(p["accounts"]).alias("accounts"), _flat(p["ifsc"]).alias("ifsc"), _flat(p["donation"]).alias("donation"))
    return out.where("links <> '' or vpas <> '' or accounts <> '' or ifsc <> '' or donation <> ''")


def known_payees(spark, d):
    """Identifiers in texts by whether a known payee owns them: a hash join on normalized identifiers, the known side size-checked by nature of a registry."""
    rows = _texts(spark, d).select("doc_id", claims.payments(F.col("text")).alias("p"))
    said = rows.select("doc_id", F.explode(F.array_distinct(F.concat(F.transform("p.links", lambda x: x["payee"]), "p.vpas", "p.accounts"))).alias("identifier"))
    known = spark.createDataFrame(PAYEES, "_id string, owner string").withColumn("_id", text.normalize_identifier(F.col("_id")))
    return said.join(known, text.normalize_identifier(F.col("identifier")) == F.col("_id"), "left").select("doc_id", "identifier", "owner")


def text_commerce(spark, d):
    """Prices, calls to action and carts of all texts that have any."""
    rows = _texts(spark, d).select("doc_id", claims.commerce(F.col("text")).alias("c"))
    return rows.where("size(c.prices) > 0 or size(c.calls) > 0 or c.cart").select("doc_id", _flat(F.col("c.prices")).alias("prices"), _flat(F.col("c.calls")).alias("calls"), "c.cart", "c.commerce")


def text_editorial(spark, d):
    """Disclaimers and critical cues of all texts that have any."""
    rows = _texts(spark, d).select("doc_id", claims.editorial(F.col("text")).alias("e"))
    return rows.where("size(e.disclaimers) > 0 or size(e.critical) > 0").select("doc_id", _flat(F.col("e.disclaimers")).alias("disclaimers"), _flat(F.col("e.critical")).alias("critical"))


def official_claims(spark, d):
    """Sentences that speak of an official site, denied or not, counted by text."""
    rows = _texts(spark, d).select("doc_id", F.explode(claims.official_claims(text.sentences(F.col("text")))).alias("c"))
    return rows.groupBy("doc_id").agg(F.count_if(~F.col("c.denied")).alias("claims"), F.count_if("c.denied").alias("denied"))


def provider_hosts(spark, d):
    """Hosts of texts' sites by the payment provider that owns them or a domain above them, the longest domain first."""
    sites = table(spark, d, "documents").where("site is not null").groupBy(F.lower("site").alias("site")).agg(F.count(F.lit(1)).alias("documents"))
    catalogue = spark.createDataFrame(PROVIDERS, "domain string, provider string")
    return joins.suffix_join(materialize(sites, "sites"), "site", catalogue, "domain").select("site", "documents", F.col("right.provider").alias("provider"))


def image_choice(spark, d):
    """The images of every brand that would be compared: at most two of a kind and six in all, logos first, then by size and id.

    Only the best of each kind reach the second ranking.
    """
    c = table(spark, d, "reference_corpus").where("brand is not null and coalesce(active, false) and width > 0 and height > 0")
    rank = F.when(F.col("kind") == "logo", 0).when(F.col("kind") == "favicon", 1).when(F.col("kind") == "qr", 2).otherwise(3)
    rows = c.select("brand", F.coalesce("kind", F.lit("")).alias("kind"), "id", (F.col("width").cast("long") * F.col("height")).alias("area"), rank.alias("rank"))
    two = latest.top_per_key(rows, ["brand", "kind"], [F.col("area").desc(), F.col("id")], 2)
    return latest.top_per_key(two, ["brand"], [F.col("rank"), F.col("area").desc(), F.col("id")], 6, "place").select("brand", "place", "kind", "id")


def brand_sets(spark, d):
    """Per case the brands that its references' hosts and its texts name: both, either and the difference."""
    brands = table(spark, d, "brand_terms").where("brand_name is not null").select("brand", "brand_name").distinct()
    docs = table(spark, d, "documents").where("case_id is not null and text is not null").select("case_id", "source", "text")
    hit = joins.contains_join(docs, "text", brands, "brand_name").select("case_id", F.col("source").isin("page_text", "rendered_page").alias("shown"), F.col("right.brand").alias("brand"))
    none = F.array().cast("array<string>")
    per = hit.groupBy("case_id").agg(F.collect_set(F.when(F.col("shown"), F.col("brand"))).alias("a"), F.collect_set(F.when(~F.coalesce("shown", F.lit(False)), F.col("brand"))).alias("b"))
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    return per.select("case_id", listed(F.array_union(a, b)).alias("either"), listed(F.array_intersect(a, b)).alias("both_"), listed(F.array_except(a, b)).alias("only_shown"))


def escaped_texts(spark, d):
    """Texts with characters that a terminal would act on: how many, and a digest of the escaped text."""
    rows = _texts(spark, d).where(F.col("text").rlike(text.UNSAFE))
    return rows.select("doc_id", F.length(text.escape_terminal(F.col("text"))).alias("n"), F.md5(F.regexp_replace(text.escape_terminal(F.col("text")), r"\\(?:x[0-9a-f]{2}|u[0-9a-f]{4}|U[0-9a-f]{8})", "")).alias("digest"))


QUERIES = {f.__name__: f for f in (text_payments, known_payees, text_commerce, text_editorial, official_claims, provider_hosts, image_choice, brand_sets, escaped_texts)}

_WORD = "(?:^|[^a-z])({p})(?:[^a-z]|$)"


def _list(pattern: str, column: str = "t", fix: str = "x") -> str:
    """Different matches in order of place, as one text."""
    escaped = pattern.replace("'", "''")
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({column}, '{escaped}', 1), lambda x: {fix}), lambda x, i: list_position(list_transform(regexp_extract_all({column}, '{escaped}', 1), lambda x: {fix}), x) = i), '|')"


_SPACED = "regexp_replace(x, '\\s+', ' ', 'g')"
_DONATED = _WORD.format(p=claims.DONATION.split(")(", 1)[1].rsplit(")(?!", 1)[0])
_CALLS = _WORD.format(p=claims.CALL.split(")(", 1)[1].rsplit(")(?!", 1)[0])
_DISCLAIMED = _WORD.format(p=claims.DISCLAIMER.split(")(", 1)[1].rsplit(")(?!", 1)[0])
_CRITIC = _WORD.format(p=claims.CRITICAL.split(")(", 1)[1].rsplit(")(?!", 1)[0])
_IN = "(SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)"

#: What the fixed texts give, written down; the rest of the rows come from the documents.
ORACLE = {
    "text_payments": f"""SELECT doc_id, '' AS links, '' AS vpas, '' AS accounts, '' AS ifsc, {_list(_DONATED, fix=_SPACED)} AS donation FROM {_IN} WHERE regexp_matches(t, '{_DONATED}')
UNION ALL VALUES (-1, 'seva.fund@okbank,Seva Fund,501,INR', 'relief@ybl', '', '', 'donate|seva'), (-2, '', '', '000123456789', 'HDFC0001234', ''), (-6, 'a.b@upi,gift for you', '', '', '', '')""".replace("Seva Fund,501,INR", "seva fund,501,inr"),
    "known_payees": "SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'seva.fund@okbank', 'seva'), (-1, 'relief@ybl', NULL), (-2, '000123456789', 'seva'), (-6, 'a.b@upi', NULL)) v(doc_id, identifier, owner)",
    "text_commerce": f"""WITH c AS (SELECT doc_id, '' AS prices, {_list(_CALLS, fix=_SPACED)} AS calls, regexp_matches(t, '(^|[^a-z])(add\\s+to\\s+(cart|bag|basket)|view\\s+cart|my\\s+cart)([^a-z]|$)') AS cart FROM {_IN})
SELECT *, cart AS commerce FROM c WHERE calls <> '' OR cart UNION ALL VALUES (-3, 'rs. 1,499.00|20 usd', 'add to cart|proceed to payment|shop now', true, true)""",
    "text_editorial": f"""WITH e AS (SELECT doc_id, {_list(_DISCLAIMED, fix=_SPACED)} AS disclaimers, {_list(_CRITIC, fix=_SPACED)} AS critical FROM {_IN})
SELECT * FROM e WHERE disclaimers <> '' OR critical <> '' UNION ALL VALUES (-4, 'fan site|not affiliated', 'critics|alleged|fraud|declined to comment')""",
    "official_claims": """WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(lower(s), '(couldn.t|n''t|not|no)[^.!?;]*official')) AS claims, count(*) FILTER (WHERE regexp_matches(lower(s), '(couldn.t|n''t|not|no)[^.!?;]*official')) AS denied
FROM s WHERE regexp_matches(lower(s), '(^|[^a-z])official\\s+(website|web\\s+site|site|page|address|store|shop|portal|account)([^a-z]|$)') GROUP BY doc_id UNION ALL VALUES (-5, 1, 1)""",
    "escaped_texts": r"""SELECT doc_id, CAST(length(c) + 4 * (length(text) - length(regexp_replace(text, '[\x{00}-\x{1f}\x{7f}-\x{9f}\x{ad}]', '', 'g'))) + 6 * len(regexp_extract_all(text, '[\x{0600}-\x{0605}\x{061c}\x{06dd}\x{070f}\x{180e}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fff9}-\x{fffb}]'))
  + 10 * len(regexp_extract_all(text, '[\x{e0001}-\x{e007f}]')) AS INTEGER) AS n, md5(c) AS digest
FROM (SELECT doc_id, text, regexp_replace(text, '[\p{Cc}\p{Cf}\x{2028}\x{2029}]', '', 'g') AS c FROM documents WHERE text IS NOT NULL) WHERE c <> text""",
    "provider_hosts": """WITH s AS (SELECT lower(site) AS site, count(*) AS documents FROM documents WHERE site IS NOT NULL GROUP BY 1), p(domain, provider) AS (VALUES ('example', 'plainpay'), ('pay.example', 'examplepay'), ('site.invalid', 'sitepay'))
SELECT site, documents, provider FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length(domain) DESC) AS n FROM s JOIN p ON site = domain OR ends_with(site, '.' || domain)) WHERE n = 1""",
    "image_choice": """WITH c AS (SELECT brand, coalesce(kind, '') AS kind, id, CAST(width AS BIGINT) * height AS area, CASE kind WHEN 'logo' THEN 0 WHEN 'favicon' THEN 1 WHEN 'qr' THEN 2 ELSE 3 END AS rank
  FROM reference_corpus WHERE brand IS NOT NULL AND coalesce(active, false) AND width > 0 AND height > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY brand, kind ORDER BY area DESC, id) AS n FROM c)
SELECT brand, place, kind, id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY rank, area DESC, id) AS INTEGER) AS place FROM t WHERE n <= 2) WHERE place <= 6""",
    "brand_sets": """WITH b AS (SELECT DISTINCT brand, brand_name FROM brand_terms WHERE brand_name IS NOT NULL),
h AS (SELECT DISTINCT case_id, coalesce(source IN ('page_text', 'rendered_page'), false) AS shown, brand FROM documents JOIN b ON contains(text, brand_name) WHERE case_id IS NOT NULL),
g AS (SELECT case_id, brand, bool_or(shown) AS a, bool_or(NOT shown) AS b FROM h GROUP BY ALL)
SELECT case_id, string_agg(brand, ',' ORDER BY brand) AS either, coalesce(string_agg(brand, ',' ORDER BY brand) FILTER (WHERE a AND b), '') AS both_, coalesce(string_agg(brand, ',' ORDER BY brand) FILTER (WHERE a AND NOT b), '') AS only_shown FROM g GROUP BY case_id""",
}
