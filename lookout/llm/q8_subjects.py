"""Queries of problem 8. An automaton over normalized text has no SQL; the tests hold it against brute force and the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.llm import subjects
from lookout.sources.tables import table


def p8_found(spark, d):
    """doc_id, subject: every subject that at least a fifth of the text's sentences deal with, ``other`` if none does."""
    return subjects.subject_areas(table(spark, d, "documents"))


def p8_composition(spark, d):
    """The corpus by subject and source: documents, and their share of the source's documents with a legible text."""
    docs = table(spark, d, "documents")
    found = subjects.subject_areas(docs)
    rows = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "subject").agg(F.countDistinct("doc_id").alias("documents"))
    totals = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]")).groupBy(F.col("source").alias("_source")).agg(F.countDistinct("doc_id").alias("_all"))
    return rows.join(totals, rows["source"].eqNullSafe(totals["_source"])).select("source", "subject", "documents", (F.col("documents") / F.col("_all")).alias("share"))


QUERIES = {f.__name__: f for f in (p8_found, p8_composition)}
ORACLE: dict[str, str] = {}
