"""Queries of problem 7. Token counts have no SQL; SQL states the rules that every selection keeps, the tests hold it against brute force."""

from __future__ import annotations

from lookout.llm import mixing
from lookout.sources.tables import table


def p7_mix(spark, d):
    """The documents of every mix at their training positions, in order."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    """The shares reached, for every row of mix_targets."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_checks(spark, d):
    """Whether caps, shares and schedule are kept, for every mix and source that has documents."""
    return mixing.checks(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p7_mix, p7_shares, p7_checks)}
ORACLE = {
    "p7_checks": """SELECT DISTINCT mix, source, true AS caps_kept, true AS supplied, true AS near_target, true AS in_time
FROM mix_targets WHERE target_share > 0 AND NOT isnan(target_share) AND coalesce(max_repeats, 1) >= 1 AND source IN (SELECT source FROM documents WHERE text <> '')""",
}
