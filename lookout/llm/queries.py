"""Queries and SQL of the llm operators, by problem."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("q2_lookalike", "q3_seen", "q5_near", "q6_tokens", "q7_mixing", "q8_subjects")

QUERIES: dict = {}
ORACLE: dict = {}
for _p in _PARTS:
    _m = import_module(f"lookout.llm.{_p}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
