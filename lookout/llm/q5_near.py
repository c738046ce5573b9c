"""Queries of problem 5."""

from __future__ import annotations

from lookout.llm import near_images
from lookout.sources.tables import table


def p5_found(spark, d):
    """All pairs of alike corpus entries."""
    return near_images.alike_pairs(table(spark, d, "reference_corpus"))


def p5_groups(spark, d):
    """The group of every corpus entry, by one-permutation hashing."""
    return near_images.alike_groups(table(spark, d, "reference_corpus"))


QUERIES = {f.__name__: f for f in (p5_found, p5_groups)}

#: The plain definition: every pair of rows. Quadratic, and right.
_PAIRS = """
WITH RECURSIVE e AS (SELECT id, nullif(lower(trim(sha256)), '') AS sha, width, height, luma_stddev,
    CAST(('0x' || lpad(trim(phash), 16, '0')) AS UBIGINT) AS p, CAST(('0x' || lpad(trim(dhash), 16, '0')) AS UBIGINT) AS d FROM reference_corpus),
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.id < b.id AND (a.sha = b.sha OR (
  a.luma_stddev >= 12 AND b.luma_stddev >= 12 AND a.width > 0 AND a.height > 0 AND b.width > 0 AND b.height > 0
  AND greatest(a.width / a.height, b.width / b.height) <= 1.35 * least(a.width / a.height, b.width / b.height)
  AND bit_count(xor(a.p, b.p)) <= 10 AND bit_count(xor(a.d, b.d)) <= 8)))
"""

ORACLE = {
    "p5_found": _PAIRS + "SELECT id_a, id_b FROM pairs",
    # Exact components. Hashing finds a group with a probability short of 1 (README); at scale 0.01 it finds all.
    "p5_groups": _PAIRS
    + """, ends AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(id, other) AS (SELECT id, id FROM e UNION SELECT r.id, b FROM reach r JOIN ends ON r.other = a)
SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
}
