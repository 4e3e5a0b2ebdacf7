"""Counts and sentence lists over stored matches.

``matches``: rule_id, post_id, sentence_seq. ``posts`` are already filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrules.operators.numbering import number_rows
from textrules.session import checked_broadcast

SENTENCE = ["post_id", "sentence_seq"]


def counts_by_rule(matches: DataFrame, rules: DataFrame, posts: DataFrame) -> DataFrame:
    """Matches per rule within the posts. Counted per post first, so no hot post is shuffled raw."""
    mine = checked_broadcast(rules.select("rule_id"))
    per_post = (
        matches.join(mine, "rule_id", "left_semi")
        .groupBy("post_id", "rule_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_post.join(posts.select("post_id"), "post_id", "left_semi")
        .groupBy("rule_id")
        .agg(F.sum("n").alias("count"))
    )


def zero_filled(counts: DataFrame, marks: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Counts with 0 for rules analysed without a match; rules never analysed stay out.

    With ``rules`` only their marks count; without, every mark gives a row.
    """
    if rules is not None:
        marks = marks.join(rules.select("rule_id"), "rule_id", "left_semi")
    analysed = marks.select("rule_id").unionByName(counts.select("rule_id")).distinct()
    return analysed.join(counts, "rule_id", "left").select(
        "rule_id", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def counts_by_post_ruleset(matches: DataFrame, rules: DataFrame, posts: DataFrame) -> DataFrame:
    """Matches per post and category, counting only rules of the post's own topic."""
    mine = checked_broadcast(rules.select("rule_id", "topic_id", "category_seq"))
    per_post = (
        matches.join(mine, "rule_id")
        .groupBy("post_id", "topic_id", "category_seq")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return per_post.join(
        posts.select("post_id", "topic_id"), ["post_id", "topic_id"], "left_semi"
    ).select("post_id", "category_seq", "count")


def counts_by_ruleset(rule_counts: DataFrame, rules: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Sum of rule counts per ruleset; rulesets without matches are left out."""
    return (
        rule_counts.join(rules.select("rule_id", "topic_id", "category_seq"), "rule_id")
        .groupBy("topic_id", "category_seq")
        .agg(F.sum("count").alias("count"))
        .filter("count > 0")
        .join(rulesets, ["topic_id", "category_seq"])
        .select("topic_id", "category_seq", "name", "count")
    )


def post_ruleset_share(post_counts: DataFrame) -> DataFrame:
    """Each category's percentage of its post's matches."""
    total = F.sum("count").over(Window.partitionBy("post_id"))
    return post_counts.select(
        "post_id", "category_seq", "count",
        F.round(F.col("count") * 100.0 / total, 4).alias("share"),
    )


def _rules_of_sentences(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*SENTENCE).agg(
        F.array_sort(F.collect_list("rule_id")).alias("rules")  # at most one per rule
    )


def sentences_of_post(sentences: DataFrame, matches: DataFrame) -> DataFrame:
    """Every sentence with the ordered list of rules it matches, empty if none."""
    return sentences.join(_rules_of_sentences(matches), SENTENCE, "left").select(
        *SENTENCE, "full_text",
        F.coalesce("rules", F.array().cast("array<bigint>")).alias("rules"),
    )


def sentences_by_rule(matches: DataFrame, posts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Matched sentences within the posts, numbered from 0 per rule in (post, sentence) order."""
    mine = matches.join(posts.select("post_id"), "post_id", "left_semi")
    numbered = number_rows(mine.select("rule_id", *SENTENCE), by=["rule_id"])
    return numbered.join(sentences.select(*SENTENCE, "full_text"), SENTENCE).select(
        "rule_id", "rnum", *SENTENCE, "full_text"
    )


def sentences_by_ruleset(
    matches: DataFrame,
    rules: DataFrame,
    posts: DataFrame,
    sentences: DataFrame,
    parity: bool = False,
) -> DataFrame:
    """Sentences matched by any rule of a category, with those rules, numbered from 0 per category.

    Only rules of the post's topic count; ``parity`` lets in the rules of every topic that
    carry the same category number.
    """
    mine = checked_broadcast(
        rules.select("rule_id", "category_seq", F.col("topic_id").alias("_rule_topic"))
    )
    found = matches.join(mine, "rule_id").join(posts.select("post_id", "topic_id"), "post_id")
    if not parity:
        found = found.filter("_rule_topic = topic_id")
    grouped = found.groupBy("category_seq", *SENTENCE).agg(
        F.array_sort(F.collect_list("rule_id")).alias("rules")
    )
    numbered = number_rows(grouped, by=["category_seq"])
    return numbered.join(sentences.select(*SENTENCE, "full_text"), SENTENCE).select(
        "category_seq", "rnum", *SENTENCE, "full_text", "rules"
    )


def sentence_primary_ruleset(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """The category of each sentence's first matched rule."""
    first = matches.groupBy(*SENTENCE).agg(F.min("rule_id").alias("rule_id"))
    return first.join(checked_broadcast(rules.select("rule_id", "category_seq")), "rule_id").select(
        *SENTENCE, "rule_id", "category_seq"
    )
