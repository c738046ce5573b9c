"""Queries of problem 6. BPE has no SQL; the tests hold the ids against the vocabulary's own library."""

from __future__ import annotations

from lookout.llm import bpe
from lookout.sources.tables import table


def p6_ids(spark, d):
    """doc_id and the ids of every text, by byte_bpe_50k without special tokens; null and empty texts have none ([])."""
    return bpe.with_ids(table(spark, d, "documents"))


def p6_round_trip(spark, d):
    """doc_id, the bytes that decoding the ids gives, and whether they are the text."""
    return bpe.round_trips(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip)}
ORACLE = {"p6_round_trip": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS same FROM documents"}
