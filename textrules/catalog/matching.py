"""Rule matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrules.catalog.sql import sql, sql_plain_sentences
from textrules.functions import text as tx
from textrules.operators import matching as op
from textrules.operators.posts import filter_posts
from textrules.operators.rule_trie import rule_trie, trie_matches
from textrules.operators.rules import pack_rules
from textrules.session import checked_broadcast


def match_from_documents(c):
    return op.rule_matches(c.raw_sentences, c.packed_rules, c.sampled_sentences)


def match_candidates(c):
    found = op.match_candidates(c.sentences, c.packed_rules)
    return found.select(
        *op.KEYS,
        F.concat_ws(",", F.transform("word_seqs", lambda p: p.cast("string"))).alias("word_seqs"),
        F.concat_ws(",", "hit_words").alias("hit_words"),
    )


def match_ordered_gap(c):
    """The test itself, applied to every candidate."""
    return op.tested_candidates(c.sentences, c.packed_rules)


def rule_matches_rnum(c):
    keys = ["post_id", "sentence_seq"]
    return c.matches.join(c.numbers, keys).select("rule_id", "post_id", "rnum")


def match_any_topic(c):
    """How many matches each rule topic has in each post topic."""
    rules = c.rules.select("rule_id", F.col("topic_id").alias("rule_topic"))
    per_post = c.matches.groupBy("post_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_post.join(checked_broadcast(rules), "rule_id")
        .groupBy("post_id", "rule_topic")
        .agg(F.sum("n").alias("n"))
        .join(c.stored_posts.select("post_id", F.col("topic_id").alias("post_topic")), "post_id")
        .groupBy("rule_topic", "post_topic")
        .agg(F.sum("n").alias("matches"))
    )


def match_candidates_filtered(c):
    """Candidates among one topic's and some sources' posts only."""
    mine = filter_posts(c.stored_posts, 1, list(range(15)))
    sentences = c.sentences.join(mine.select("post_id"), "post_id", "left_semi")
    found = op.match_candidates(sentences, c.packed_rules)
    return found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.size("word_seqs")).alias("occurrences"),
    )


def wide_rules(c):
    """A rule from every sentence of every example text: its first 1 to 6 words at steps of 1 to 3."""
    spoken = c.table("benchmark").select("item_id", F.posexplode(tx.plain_sentences(F.col("text"))).alias("k", "full_text"))
    n, step = (F.col("item_id") + F.col("k")) % 6 + 1, (F.col("item_id") + F.col("k")) % 3 + 1
    rules = spoken.select(
        (F.col("item_id") * 1000 + F.col("k")).alias("rule_id"), F.lit(1).alias("topic_id"), F.lit(1).alias("category_seq"),
        n.alias("n"), step.alias("step"), F.posexplode(tx.words(F.col("full_text"))).alias("word_seq", "word"),
    ).filter((F.col("word_seq") % F.col("step") == 0) & (F.col("word_seq") < F.col("n") * F.col("step")))
    return pack_rules(rules.select("rule_id", "topic_id", "category_seq").distinct(), rules)


def rule_matches_trie(c):
    """All rules of ``wide_rules`` at once, over the stored sentences."""
    return trie_matches(c.sentences, rule_trie(wide_rules(c)))


_WIDE = {
    "spoken_rules": ("", f"""
SELECT item_id, k - 1 AS k, l[k] AS full_text FROM (
  SELECT item_id, l, unnest(range(1, len(l) + 1)) AS k FROM (
    SELECT item_id, {sql_plain_sentences('text')} AS l FROM benchmark))"""),
    "rules": ("spoken_rules", """
SELECT item_id * 1000 + k AS rule_id, 1 AS topic_id, 1 AS category_seq, full_text,
  (item_id + k) % 6 + 1 AS n, (item_id + k) % 3 + 1 AS step FROM spoken_rules"""),
    "rule_words": ("rules", """
SELECT rule_id, word_seq, word FROM (
  SELECT rule_id, n, step, CAST(unnest(range(len(l))) AS INTEGER) AS word_seq, unnest(l) AS word
  FROM (SELECT *, regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') AS l FROM rules))
WHERE word_seq % step = 0 AND word_seq < n * step"""),
}

ENTRIES = {
    "rule_matches": (
        match_from_documents,
        sql("matches", "SELECT rule_id, post_id, sentence_seq FROM matches"),
    ),
    "match_candidates": (
        match_candidates,
        sql("candidates", """
SELECT rule_id, post_id, sentence_seq,
  array_to_string(list_transform(toks, lambda t: CAST(t.p AS VARCHAR)), ',') AS word_seqs,
  array_to_string(list_transform(toks, lambda t: t.w), ',') AS hit_words
FROM candidates"""),
    ),
    "match_candidates_filtered": (
        match_candidates_filtered,
        sql("candidates posts", """
SELECT rule_id, count(*) AS candidates, CAST(sum(len(toks)) AS BIGINT) AS occurrences
FROM candidates JOIN posts USING (post_id)
WHERE topic_id = 1 AND source_id BETWEEN 0 AND 14 GROUP BY rule_id"""),
    ),
    "match_ordered_gap": (
        match_ordered_gap,
        sql("candidates", """
SELECT rule_id, post_id, sentence_seq, list_reduce(toks, lambda s, t: CASE
    WHEN s.i < len(rule_words) AND t.w = rule_words[s.i + 1] AND (s.i = 0 OR t.p - s.p <= gap)
      THEN {'p': t.p, 'w': t.w, 'i': s.i + 1}
    WHEN s.i < len(rule_words) AND s.i > 0 AND t.w = rule_words[s.i]
      THEN {'p': t.p, 'w': t.w, 'i': s.i}
    ELSE s END, {'p': -1, 'w': '', 'i': 0}).i = len(rule_words) AS valid
FROM candidates"""),
    ),
    "rule_matches_trie": (
        rule_matches_trie,
        sql("matches", "SELECT rule_id, post_id, sentence_seq FROM matches", **_WIDE),
    ),
    "rule_matches_rnum": (
        rule_matches_rnum,
        sql("matches numbers", """
SELECT rule_id, post_id, rnum FROM matches JOIN numbers USING (post_id, sentence_seq)"""),
    ),
    "match_any_topic": (
        match_any_topic,
        sql("matches posts rules", """
SELECT r.topic_id AS rule_topic, p.topic_id AS post_topic, count(*) AS matches
FROM matches m JOIN rules r USING (rule_id) JOIN posts p USING (post_id) GROUP BY 1, 2"""),
    ),
    "max_post_id": (
        lambda c: op.max_post_id(c.stored_posts, 1, list(range(15))).unionByName(op.max_post_id(c.stored_posts)),
        sql("posts", """
SELECT max(post_id) AS max_post_id FROM posts WHERE topic_id = 1 AND source_id BETWEEN 0 AND 14
UNION ALL SELECT max(post_id) FROM posts"""),
    ),
}
