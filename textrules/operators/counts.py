"""Counts of matches that are kept up to date by deltas, so that reports never scan matches.

Two tables of deltas, of which the sums count:

``by_day``: rule_id, topic_id, source_id, day, n - matches of a rule in a day's posts.
``by_post``: post_id, rule_id, n - matches of a rule in one post.

A run adds the deltas of its new matches. Deleting rules or a source's posts adds their counts
with the other sign, taken from the counts themselves. ``folded`` sums deltas up to one row a
key. Days are those of the session's time zone, as the bounds of reports are; a post without a
time has a null day and is in no range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrules.session import checked_broadcast

DAY_KEYS = ("rule_id", "topic_id", "source_id", "day")
POST_KEYS = ("post_id", "rule_id")
SCHEMAS = {
    "by_day": "rule_id long, topic_id int, source_id int, day date, n long",
    "by_post": "post_id long, rule_id long, n long",
}


@dataclass(frozen=True)
class MatchCounts:
    by_day: DataFrame
    by_post: DataFrame

    def plus(self, other: MatchCounts) -> MatchCounts:
        return MatchCounts(self.by_day.unionByName(other.by_day), self.by_post.unionByName(other.by_post))


def no_counts(spark: SparkSession) -> MatchCounts:
    return MatchCounts(*(spark.createDataFrame([], SCHEMAS[name]) for name in ("by_day", "by_post")))


def deltas_of(matches: DataFrame, posts: DataFrame) -> MatchCounts:
    """What new matches add. Counted per post first, so no hot rule or post is shuffled raw.

    ``posts``: post_id, topic_id, source_id, ts; matches in other posts add nothing to days.
    """
    by_post = matches.groupBy(*POST_KEYS).agg(F.count(F.lit(1)).alias("n"))
    own = posts.select("post_id", "topic_id", "source_id", F.to_date("ts").alias("day"))
    by_day = by_post.join(own, "post_id").groupBy(*DAY_KEYS).agg(F.sum("n").alias("n"))
    return MatchCounts(by_day, by_post)


def _turned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", -F.col("n"))


def deltas_without_rules(counts: MatchCounts, rules: DataFrame) -> MatchCounts:
    """What deleting rules (rule_id) takes away."""
    gone = checked_broadcast(rules.select("rule_id").distinct())
    return MatchCounts(*(_turned(folded(t.join(gone, "rule_id", "left_semi"), k)) for t, k in _both(counts)))


def deltas_without_source(counts: MatchCounts, posts: DataFrame, topic_id: int, source_id: int) -> MatchCounts:
    """What removing all posts of a (topic, source) takes away; ``posts`` as they were before."""
    mine = (F.col("topic_id") == topic_id) & (F.col("source_id") == source_id)
    gone = posts.filter(mine).select("post_id")
    by_post = counts.by_post.join(gone, "post_id", "left_semi")
    return MatchCounts(
        _turned(folded(counts.by_day.filter(mine), DAY_KEYS)), _turned(folded(by_post, POST_KEYS))
    )


def _both(counts: MatchCounts) -> list[tuple[DataFrame, Sequence[str]]]:
    return [(counts.by_day, DAY_KEYS), (counts.by_post, POST_KEYS)]


def folded(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key, none where the sum is 0."""
    return deltas.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0").select(*keys, "n")


def compacted(counts: MatchCounts) -> MatchCounts:
    """The same counts with one row a key."""
    return MatchCounts(*(folded(t, k) for t, k in _both(counts)))


# -- reports ------------------------------------------------------------------------------


def counts_by_rule(
    counts: MatchCounts,
    rules: DataFrame,
    topic_id: int,
    source_ids: Sequence[int],
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    """rule_id, count of matches in the posts that the same filter of posts would show."""
    inside = (F.col("topic_id") == topic_id) & F.col("source_id").isin(*source_ids) & F.col("day").isNotNull()
    if from_date:
        inside &= F.col("day") >= F.lit(from_date).cast("date")
    if to_date:
        inside &= F.col("day") <= F.lit(to_date).cast("date")
    mine = checked_broadcast(rules.select("rule_id"))
    return (
        counts.by_day.filter(inside)
        .join(mine, "rule_id", "left_semi")
        .groupBy("rule_id")
        .agg(F.sum("n").alias("count"))
        .filter("count <> 0")
    )


def counts_by_post_ruleset(counts: MatchCounts, rules: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, category_seq, count over rules of the post's own topic; ``posts`` are filtered."""
    mine = checked_broadcast(rules.select("rule_id", "topic_id", "category_seq"))
    per_post = (
        counts.by_post.join(mine, "rule_id")
        .groupBy("post_id", "topic_id", "category_seq")
        .agg(F.sum("n").alias("count"))
        .filter("count <> 0")
    )
    return per_post.join(
        posts.select("post_id", "topic_id"), ["post_id", "topic_id"], "left_semi"
    ).select("post_id", "category_seq", "count")
