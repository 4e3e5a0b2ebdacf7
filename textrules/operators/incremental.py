"""Incremental rule runs: one high-water mark per rule.

``marks``: rule_id, last_post_id. A rule without a mark is new and sees all posts; post ids
start at 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.operators.matching import KEYS, rule_matches

# What a rule without a mark has seen: nothing, not even post 0.
NO_MARK = -1


def incremental_matches(
    sentences: DataFrame,
    rules: DataFrame,
    marks: DataFrame,
    until: int,
    parity: bool = False,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Matches in posts above each rule's mark and up to ``until``.

    ``parity`` leaves out ``until`` itself, which then no later run sees either. New rules meet
    all posts; the others only those above their lowest mark, which is a literal and reaches
    the scan. So one new rule does not send all rules through the whole history.
    """
    high = until - 1 if parity else until
    seen = sentences.filter(F.col("post_id") <= high)
    new = rules.join(marks.select("rule_id"), "rule_id", "left_anti")
    found = rule_matches(seen, new, sample)
    marked = rules.join(marks.select("rule_id", "last_post_id"), "rule_id")
    low = marked.agg(F.min("last_post_id").alias("low")).first()["low"]
    if low is None:
        return found
    window = (F.col("last_post_id"), F.lit(high))
    return found.unionByName(rule_matches(seen.filter(F.col("post_id") > low), marked, sample, window))


def advance_marks(rules: DataFrame, marks: DataFrame, until: int) -> DataFrame:
    """After a run every rule's mark is ``until``, unless it was further already."""
    return rules.select("rule_id").join(marks, "rule_id", "left").select(
        "rule_id",
        F.greatest(F.lit(until).cast("long"), F.coalesce("last_post_id", F.lit(NO_MARK).cast("long")))
        .alias("last_post_id"),
    )


def new_only(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Matches not stored yet, each once."""
    return found.dropDuplicates(list(KEYS)).join(stored.select(*KEYS), list(KEYS), "left_anti")


def append_new(stored: DataFrame, found: DataFrame) -> DataFrame:
    return stored.select(*KEYS).unionByName(new_only(found, stored).select(*KEYS))
