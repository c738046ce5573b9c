"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control, format, line and paragraph separator characters, as a Java pattern.
UNSAFE = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}]"


def bound(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once and kept once in the plan, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sanitize(text: Column, most: int | None = 4096) -> Column:
    """Tabs and line ends become spaces, other unsafe characters go, and the rest is capped, unless ``most`` is None."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]", " "), UNSAFE, "")
    return safe if most is None else F.substring(safe, 1, most)


def escape_terminal(text: Column) -> Column:
    """Text fit to print: control, format and separator characters as \\xNN, \\uNNNN or \\UNNNNNNNN; the rest as it is."""
    chars = F.split(text, "")
    code = lambda c, n: F.lpad(F.lower(F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))), n, "0")
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    shown = lambda c: F.when(~c.rlike(r"\A[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]\z"), c).when(point(c) < 256, F.concat(F.lit("\\x"), code(c, 2))).when(point(c) < 65536, F.concat(F.lit("\\u"), code(c, 4))).otherwise(F.concat(F.lit("\\U"), code(c, 8)))
    return F.when(text.rlike(UNSAFE), F.array_join(F.transform(chars, shown), "")).otherwise(text)


def neutralize_csv(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"(?U)\A(?:[\t\r\n]|\s*[=+\-@])"), F.concat(F.lit("'"), t)).otherwise(t)


def csv_cell(text: Column, most: int = 2000) -> Column:
    return neutralize_csv(F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, most))


def normalize_identifier(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"))), F.lit(0))


def unique_matches(text: Column, pattern: str, most: int, group: int = 0) -> Column:
    """Distinct matches in order of their first occurrence."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))), 1, most)


def around(text: Column, start: Column, end: Column, margin: int = 120, most: int = 300) -> Column:
    """The text from ``margin`` characters before a 0-based span to as many after it."""
    a = F.greatest(start - margin, F.lit(0))
    return F.substr(text, a + 1, F.least(end + margin - a, F.lit(most)))


def stable_id(*parts: Column) -> Column:
    """sha256 of the parts joined by U+001F; null parts count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sampled(key: Column, rate: float) -> Column:
    """A stable choice: the first 64 bits of the key's sha256 as a fraction are below the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64) < F.lit(rate)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    bits = lambda x: F.conv(x, 16, -10).cast("long")
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


def hash_bits(col: Column) -> Column:
    """A 64-bit hash in hex of either case as a long, leading zeros or not; null if it isn't one."""
    bare = F.lower(F.trim(col))
    return F.when(bare.rlike(r"\A[0-9a-f]{1,16}\z"), F.conv(F.lpad(bare, 16, "0"), 16, -10).cast("long"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user info and port; unlike parse_url it takes any label. Null if there is none."""
    authority = F.regexp_extract(url, r"\A\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"\A.*@", ""), r":\d*\z", ""))
    return F.nullif(host, F.lit(""))


def iso_seconds(epoch: Column) -> Column:
    """Epoch seconds as ISO in UTC with offset; null for null and 0."""
    return F.when(epoch.isNotNull() & (epoch != 0), F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ssxxx"))


def period(time: Column, hourly: bool = True) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HH" if hourly else "yyyyMMdd")


def ipv4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a long; null if it isn't one in canonical form."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(rf"\A{part}(?:\.{part}){{3}}\z"), parts[0].cast("long") * 16777216 + parts[1].cast("long") * 65536 + parts[2].cast("long") * 256 + parts[3].cast("long"))


#: IPv4 ranges that aren't public, in order; the first that holds an address names its class.
IPV4_CLASSES = (
    ("0.0.0.0", 8, "unspecified"), ("10.0.0.0", 8, "private"), ("100.64.0.0", 10, "cgnat"), ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link_local"),
    ("172.16.0.0", 12, "private"), ("192.0.0.0", 24, "reserved"), ("192.0.2.0", 24, "documentation"), ("192.88.99.0", 24, "reserved"), ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "benchmarking"), ("198.51.100.0", 24, "documentation"), ("203.0.113.0", 24, "documentation"), ("224.0.0.0", 4, "multicast"),
    ("255.255.255.255", 32, "broadcast"), ("240.0.0.0", 4, "reserved"),
)


def class_of_ipv4(n: Column) -> Column:
    """The class of an IPv4 address given as a long; null for null."""
    out = None
    for base, bits, name in IPV4_CLASSES:
        a, b, c, d = (int(x) for x in base.split("."))
        first = a << 24 | b << 16 | c << 8 | d
        cond = n.between(first, first + (1 << (32 - bits)) - 1)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(n.isNotNull(), out.otherwise("public"))


def ipv4_class(ip: Column) -> Column:
    """The class of a blocked IPv4 address, ``public`` otherwise; null if it isn't an IPv4 address."""
    return class_of_ipv4(ipv4_number(ip))


def backoff(failures: Column, first: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.least(failures, F.lit(30))))


def share_of_group(value: Column, *keys: str) -> Column:
    from pyspark.sql import Window

    return value / F.sum(value).over(Window.partitionBy(*keys))
