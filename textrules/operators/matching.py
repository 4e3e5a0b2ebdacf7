"""Rule matching: which sentences contain which rules' words, in order and close together.

``sentences``: post_id, sentence_seq, words ARRAY<STRING>.
``rules``: rule_id, gap, words ARRAY<STRING> (see ``rules.pack_rules``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions.matching import holds_all, ordered_gap_match
from textrules.session import BROADCAST_BYTES, broadcast_parts

ANCHOR_SAMPLE = 0.05
KEYS = ("rule_id", "post_id", "sentence_seq")


def with_anchors(rules: DataFrame, sample: DataFrame) -> DataFrame:
    """Give each rule its rarest word, by the frequencies in ``sample``, as ``anchor``.

    Any word of the rule is a sound anchor, since a match needs them all; the sample only
    decides how many pairs are tried. ``rules`` must be small enough to broadcast.
    """
    rule_words = rules.select("rule_id", F.explode("words").alias("word"))
    freq = (
        sample.select(F.explode("words").alias("word"))
        .join(F.broadcast(rule_words.select("word").distinct()), "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    anchors = (
        rule_words.join(F.broadcast(freq), "word", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word"))["word"].alias("anchor"))
    )
    return rules.join(F.broadcast(anchors), "rule_id")


def candidate_pairs(
    sentences: DataFrame,
    rules: DataFrame,
    sample: DataFrame | None = None,
    limit: int = BROADCAST_BYTES // 2,
) -> DataFrame:
    """Sentences joined with the rules whose anchor word they hold.

    The rules are broadcast, in several parts when they are measured to be too large for
    one, so a sentence never moves and a hot word is no hot key.
    """
    sentences = sentences.select("post_id", "sentence_seq", "words")
    if sample is None:
        sample = sentences.sample(ANCHOR_SAMPLE, seed=7)
    held = sentences.select("*", F.explode(F.array_distinct("words")).alias("anchor"))
    pairs = [
        held.join(
            F.broadcast(with_anchors(part, sample).withColumnRenamed("words", "rule_words")),
            "anchor",
        )
        for part in broadcast_parts(rules, "rule_id", limit)
    ]
    return reduce(DataFrame.unionByName, pairs)


def rule_matches(
    sentences: DataFrame,
    rules: DataFrame,
    sample: DataFrame | None = None,
    window: tuple[Column, Column] | None = None,
    limit: int = BROADCAST_BYTES // 2,
) -> DataFrame:
    """(rule_id, post_id, sentence_seq) of every match; keys are unique.

    ``sample``: sentences to estimate word frequencies from. ``window``: bounds on post_id,
    possibly using columns of ``rules``; only posts above the first and up to the second
    are tested.
    """
    pairs = candidate_pairs(sentences, rules, sample, limit)
    if window is not None:
        pairs = pairs.filter((F.col("post_id") > window[0]) & (F.col("post_id") <= window[1]))
    # As filters the tests would become a condition of the join, which Spark then runs row by row on a
    # copy of the sentence for each of its words; a generator stays behind it.
    holds = holds_all(F.col("words"), F.col("rule_words"))
    valid = (F.size("rule_words") == 1) | ordered_gap_match(F.col("words"), F.col("rule_words"), F.col("gap"))
    valid = F.when(holds, valid)
    return pairs.select(*KEYS, F.explode_outer(F.array(valid)).alias("valid")).filter("valid").select(*KEYS)


def tested_candidates(
    sentences: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(rule_id, post_id, sentence_seq, valid): every candidate and what the ordered test says."""
    valid = ordered_gap_match(F.col("words"), F.col("rule_words"), F.col("gap"))
    return _candidates(sentences, rules, limit).select(*KEYS, F.coalesce(valid, F.lit(False)).alias("valid"))


def match_candidates(
    sentences: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Sentences with at least as many occurrences of rule words as the rule has words.

    Gives the positions and words of just those occurrences, in sentence order.
    """
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))),
        lambda x: F.array_contains(F.col("rule_words"), x["w"]),
    )
    return _candidates(sentences, rules, limit).select(
        *KEYS,
        F.transform(hits, lambda h: h["p"]).alias("word_seqs"),
        F.col("shared").alias("hit_words"),
    )


def _candidates(sentences: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """Pairs with their words, the rule's words and gap, and the words they share.

    A pair is reached through each word it shares; it is kept only for the first of them, so
    no de-duplicating shuffle is needed.
    """
    by_word = rules.select(
        "rule_id", "gap", F.col("words").alias("rule_words"),
        F.explode(F.array_distinct("words")).alias("word"),
    )
    held = sentences.select(
        "post_id", "sentence_seq", "words", F.explode(F.array_distinct("words")).alias("word")
    )
    pairs = reduce(
        DataFrame.unionByName,
        [held.join(part, "word") for part in broadcast_parts(by_word, "rule_id", limit)],
    )
    shared = F.filter("words", lambda w: F.array_contains(F.col("rule_words"), w))
    return (
        pairs.withColumn("shared", shared)
        .filter(F.col("word") == F.get("shared", F.lit(0)))
        .filter(F.size("shared") >= F.size("rule_words"))
    )


def max_post_id(posts: DataFrame, topic_id: int | None = None, source_ids=None) -> DataFrame:
    """Largest post id, overall or within a topic and a set of sources."""
    if topic_id is not None:
        posts = posts.filter(F.col("topic_id") == topic_id)
    if source_ids:
        posts = posts.filter(F.col("source_id").isin(*source_ids))
    return posts.agg(F.max("post_id").alias("max_post_id"))
