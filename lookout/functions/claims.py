"""What a text says: payees, prices, calls to action, claims of being official, disclaimers, editorial cues. Column expressions.

Patterns are Java's. A text is scanned whole; lists hold every different find in order of place, and ``most`` bounds a list
only where the caller asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lookout.functions.text import bound

# The patterns of the classes that results must agree on.
VPA = r"(?<![\w.@-])([a-z0-9][a-z0-9._-]{1,255}@[a-z][a-z0-9]{1,63})(?![\w@-])(?!\.[a-z0-9])"
UPI_LINK = r"(?i)((?:upi|tez|phonepe|paytmmp|gpay|bhim)://pay\?[^\s\"'<>]{1,1024})"
IFSC = r"(?<![a-z0-9])([a-z]{4}0[a-z0-9]{6})(?![a-z0-9])"
ACCOUNT = r"(?:account|a/c|acct|acc\.?)\s*(?:no\.?|number|#)?[^0-9]{0,20}(\d[\d -]{7,24}\d)(?!\d)"
DONATION = r"(?<![a-z])(donat(?:e|es|ed|ing|ion|ions)|contribut(?:e|ion|ions)|seva|offering|dakshina|relief\s+fund|fundrais(?:er|ing)|support\s+(?:our|the)\s+cause|give\s+now|charity|80g|tax\s+exempt(?:ion)?|sponsor\s+a)(?![a-z])"
PRICE = r"((?<![a-z])(?:₹|rs\.?|inr|\$|usd|us\$|€|eur|£|gbp)\s?\d[\d,]{0,12}(?:\.\d{1,2})?|\d[\d,]{0,12}(?:\.\d{1,2})?\s?(?:inr|rupees|rs\.?|usd|dollars|eur|euros|gbp)(?![a-z]))"
CALL = r"(?<![a-z])(add\s+to\s+(?:cart|bag|basket)|buy\s+now|book\s+now|shop\s+now|order\s+now|pay\s+now|checkout|check\s+out|proceed\s+to\s+pay(?:ment)?|purchase|enroll?\s+now|register\s+now|book\s+(?:a|your)\s+\w+|get\s+tickets?)(?![a-z])"
CART = r"(?<![a-z])(?:add\s+to\s+(?:cart|bag|basket)|view\s+cart|my\s+cart)(?![a-z])"
DISCLAIMER = r"(?<![a-z])(not\s+(?:affiliated|associated|connected|endorsed|sponsored)|no\s+affiliation|unofficial|fan\s+(?:site|page)|independent\s+(?:of|from)|disclaimer)(?![a-z])"
CRITICAL = r"(?<![a-z])(critics?|criticism|criticised|criticized|allegations?|alleged(?:ly)?|controvers(?:y|ial)|accused|lawsuit|investigation|complaints?|concerns?|questions\s+over|did\s+not\s+respond|declined\s+to\s+comment|scam|fraud|exposed)(?![a-z])"
OFFICIAL = r"(?<![a-z])(official\s+(?:website|web\s+site|site|page|address|store|shop|portal|account))(?![a-z])"
NEGATED = r"(?:\bnot\b|n't\b|\bno\b|\bnever\b|\bwithout\b|\bunofficial\b|couldn.t)[^.!?;]{0,60}\z"


def different(text: Column, pattern: str, most: int | None = None) -> Column:
    """The first group's different matches in order of place; an empty list for null."""
    found = F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))
    return found if most is None else F.slice(found, 1, most)


def payment_link(link: Column) -> Column:
    """payee, name, amount, currency, note of a upi: link; null without a payee."""
    query = F.regexp_extract(link, r"\A\s*[A-Za-z]+:(?://)?[^?#]*\?([^#]*)", 1)

    def field(q: Column, key: str) -> Column:
        raw = F.regexp_extract(q, rf"(?:\A|&){key}=([^&]*)", 1)
        return F.nullif(F.trim(F.coalesce(F.try_url_decode(raw), raw)), F.lit(""))

    def parts(q: Column) -> Column:
        payee = F.lower(field(q, "pa"))
        known = {"payee_name": "pn", "amount": "am", "currency": "cu", "note": "tn"}
        return F.when(payee.isNotNull(), F.struct(payee.alias("payee"), *[field(q, k).alias(n) for n, k in known.items()]))

    return F.when(link.rlike(r"(?i)\A\s*(?:upi|tez|phonepe|paytmmp|gpay|bhim|intent):"), bound(query, parts))


def payments(text: Column) -> Column:
    """links (UPI deep links as :func:`payment_link`), vpas (payee addresses not linked), accounts, ifsc, donation cues of a text."""

    def made(t: Column) -> Column:
        links = F.filter(F.transform(different(t, UPI_LINK), payment_link), lambda x: x.isNotNull())
        accounts = F.filter(F.array_distinct(F.transform(different(t, ACCOUNT), lambda a: F.regexp_replace(a, "[ -]", ""))), lambda a: F.length(a).between(9, 18))
        return bound(
            links,
            lambda known: F.struct(
                known.alias("links"),
                F.array_except(different(t, VPA), F.transform(known, lambda x: x["payee"])).alias("vpas"),
                accounts.alias("accounts"),
                F.transform(different(t, IFSC), F.upper).alias("ifsc"),
                F.transform(different(t, DONATION), lambda d: F.regexp_replace(d, r"\s+", " ")).alias("donation"),
            ),
        )

    return bound(F.lower(text), made)


def commerce(text: Column) -> Column:
    """prices, calls, cart, commerce (prices with a call, or a cart) of a text."""

    def made(t: Column) -> Column:
        prices, calls, cart = different(t, PRICE), F.transform(different(t, CALL), lambda c: F.regexp_replace(c, r"\s+", " ")), F.coalesce(t.rlike(CART), F.lit(False))
        return F.struct(prices.alias("prices"), calls.alias("calls"), cart.alias("cart"), (((F.size(prices) > 0) & (F.size(calls) > 0)) | cart).alias("commerce"))

    return bound(F.lower(text), made)


def editorial(text: Column) -> Column:
    """disclaimers and critical cues of a text."""
    spaced = lambda found: F.transform(found, lambda c: F.regexp_replace(c, r"\s+", " "))
    return bound(F.lower(text), lambda t: F.struct(spaced(different(t, DISCLAIMER)).alias("disclaimers"), spaced(different(t, CRITICAL)).alias("critical")))


def official_claims(sentences: Column) -> Column:
    """Of a list of sentences those that claim to be official: sentence, and whether the claim is denied in its clause."""

    def judged(s: Column) -> Column:
        before = F.regexp_extract(F.lower(s), rf"(?s)\A(.*?){OFFICIAL}", 1)
        return F.struct(s.alias("sentence"), before.rlike(NEGATED).alias("denied"))

    return F.transform(F.filter(sentences, lambda s: F.lower(s).rlike(OFFICIAL)), judged)


def image_role(hints: Column) -> Column:
    """qr, logo, icon or photo by the words of an image's hints (alt, class, id, file name)."""
    h = F.lower(F.coalesce(hints, F.lit("")))
    word = lambda p: h.rlike(rf"(?<![a-z])(?:{p})(?![a-z])")
    return F.when(word("qr|scan|upi|bhim|gpay|paytm|phonepe"), "qr").when(word("logo|brand|emblem|crest"), "logo").when(word("icon|favicon|sprite"), "icon").otherwise("photo")
