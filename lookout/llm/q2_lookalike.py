"""Queries of problem 2. Collation and punycode have no SQL in DuckDB; the tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.llm import lookalike
from lookout.sources.tables import table


def p2_found(spark, d):
    """Deliveries whose first label reads the same as a brand phrase in other characters."""
    return lookalike.matching_terms(table(spark, d, "discovery_log"), "delivery_id", "name", table(spark, d, "brand_terms"), "term_id", "phrase")


def p2_forms(spark, d):
    """The consistent form of every distinct first label and phrase."""
    labels = table(spark, d, "discovery_log").select(lookalike.first_label(F.col("name")).alias("raw")).distinct()
    return lookalike.canonical_forms(labels.unionByName(table(spark, d, "brand_terms").select(F.col("phrase").alias("raw")).distinct()))


QUERIES = {f.__name__: f for f in (p2_found, p2_forms)}
ORACLE: dict[str, str] = {}
