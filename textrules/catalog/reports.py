"""Report queries under one filter: topic 1, sources 0 to 14, nearly all of 2024."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrules.catalog.sql import sql
from textrules.operators import posts as p
from textrules.operators import reports as r
from textrules.plans.dashboard import dashboard

TOPIC, SOURCES, FROM, TO = 1, list(range(15)), "2024-01-03", "2024-12-30"


def shown(c):
    return p.filter_posts(c.stored_posts, TOPIC, SOURCES, FROM, TO)


def topic_rules(c):
    return c.rules.filter(F.col("topic_id") == TOPIC)


def rule_counts(c):
    return r.counts_by_rule(c.matches, topic_rules(c), shown(c))


def post_counts(c):
    return r.counts_by_post_ruleset(c.matches, c.rules, shown(c))


def listed(column):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


def sentences_of_post(c):
    found = r.sentences_of_post(c.sentences, c.matches)
    return found.select("post_id", "sentence_seq", "full_text", listed("rules"))


def by_ruleset(parity):
    def query(c):
        found = r.sentences_by_ruleset(c.matches, c.rules, shown(c), c.sentences, parity)
        return found.select(
            "category_seq", "rnum", "post_id", "sentence_seq", "full_text", listed("rules")
        )

    return query


def by_ruleset_sql(condition):
    return sql("matches rules shown_posts sentences", f"""
found AS (SELECT r.category_seq, m.post_id, m.sentence_seq,
    array_to_string(list(CAST(m.rule_id AS VARCHAR) ORDER BY m.rule_id), ',') AS rules
  FROM matches m JOIN rules r USING (rule_id) JOIN shown_posts p USING (post_id)
  WHERE {condition} GROUP BY 1, 2, 3)
SELECT category_seq, row_number() OVER (PARTITION BY category_seq ORDER BY post_id, sentence_seq) - 1
  AS rnum, post_id, sentence_seq, full_text, rules
FROM found JOIN sentences USING (post_id, sentence_seq)""")


def counts_by_ruleset_flagship(c):
    """Every ruleset's matches over all posts of its topic."""
    per_post = r.counts_by_post_ruleset(c.matches, c.rules, c.stored_posts)
    return (
        per_post.join(c.stored_posts.select("post_id", "topic_id"), "post_id")
        .groupBy("topic_id", "category_seq").agg(F.sum("count").alias("count"))
        .join(c.rulesets, ["topic_id", "category_seq"])
        .select("topic_id", "category_seq", "name", "count")
    )


def posts_page_all_dates(c):
    return p.posts_page(shown(c), page=2)


def dashboard_rows(c):
    return dashboard(
        c.stored_posts, c.rulesets, c.rules, c.rule_words, c.matches, c.watermark,
        TOPIC, SOURCES, FROM, TO,
    ).as_rows()


_PAGE = """page AS (SELECT * FROM shown_posts ORDER BY post_id LIMIT 10)"""

ENTRIES = {
    "filter_posts": (
        lambda c: shown(c).select(
            "post_id", "topic_id", "source_id", "title",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        ),
        sql("shown_posts", """
SELECT post_id, topic_id, source_id, title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM shown_posts"""),
    ),
    "posts_count": (
        lambda c: p.posts_count(shown(c)),
        sql("shown_posts", "SELECT count(*) AS posts_count FROM shown_posts"),
    ),
    "posts_page": (
        posts_page_all_dates,
        sql("shown_posts", """
SELECT post_id, title, url, strftime(ts, '%Y/%m/%d') AS date
FROM shown_posts ORDER BY post_id LIMIT 10 OFFSET 10"""),
    ),
    "page_count": (
        lambda c: p.posts_count(shown(c)).select(p.last_page(F.col("posts_count")).alias("last_page")),
        sql("shown_posts", "SELECT CAST(floor(count(*) / 10) + 1 AS BIGINT) AS last_page FROM shown_posts"),
    ),
    "counts_by_rule": (
        rule_counts,
        sql("rule_counts", "SELECT rule_id, count FROM rule_counts"),
    ),
    "counts_by_rule_zero_filled": (
        lambda c: r.zero_filled(rule_counts(c), c.watermark, topic_rules(c)),
        sql("rule_counts watermark", """
SELECT rule_id, coalesce(count, 0) AS count FROM (
  SELECT rule_id FROM watermark JOIN rules USING (rule_id) WHERE topic_id = 1
  UNION SELECT rule_id FROM rule_counts) LEFT JOIN rule_counts USING (rule_id)"""),
    ),
    "counts_by_rule_zero_filled_parity": (
        lambda c: r.zero_filled(rule_counts(c), c.watermark),
        sql("rule_counts watermark", """
SELECT rule_id, coalesce(count, 0) AS count FROM (
  SELECT rule_id FROM watermark UNION SELECT rule_id FROM rule_counts)
LEFT JOIN rule_counts USING (rule_id)"""),
    ),
    "counts_by_post_ruleset": (
        post_counts,
        sql("post_counts", "SELECT post_id, category_seq, count FROM post_counts"),
    ),
    "counts_by_ruleset": (
        lambda c: r.counts_by_ruleset(rule_counts(c), c.rules, c.rulesets),
        sql("rule_counts rules rulesets", """
SELECT r.topic_id, r.category_seq, any_value(s.name) AS name, CAST(sum(count) AS BIGINT) AS count
FROM rule_counts JOIN rules r USING (rule_id)
JOIN rulesets s ON s.topic_id = r.topic_id AND s.category_seq = r.category_seq
GROUP BY 1, 2 HAVING sum(count) > 0"""),
    ),
    "counts_by_ruleset_all_topics": (
        counts_by_ruleset_flagship,
        sql("matches rules posts rulesets", """
SELECT r.topic_id, r.category_seq, any_value(s.name) AS name, count(*) AS count
FROM matches m JOIN rules r USING (rule_id)
JOIN posts p ON p.post_id = m.post_id AND p.topic_id = r.topic_id
JOIN rulesets s ON s.topic_id = r.topic_id AND s.category_seq = r.category_seq
GROUP BY 1, 2"""),
    ),
    "post_ruleset_share": (
        lambda c: r.post_ruleset_share(post_counts(c)),
        sql("post_counts", """
SELECT post_id, category_seq, count,
  round(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY post_id), 4) AS share
FROM post_counts"""),
    ),
    "sentences_of_post": (
        sentences_of_post,
        sql("sentences matches", """
SELECT s.post_id, s.sentence_seq, any_value(full_text) AS full_text,
  coalesce(string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id), '') AS rules
FROM sentences s LEFT JOIN matches m ON s.post_id = m.post_id AND s.sentence_seq = m.sentence_seq
GROUP BY 1, 2"""),
    ),
    "sentences_of_post_plain": (
        lambda c: c.sentences.select("post_id", "sentence_seq", "full_text"),
        sql("sentences", "SELECT post_id, sentence_seq, full_text FROM sentences"),
    ),
    "sentences_by_rule": (
        lambda c: r.sentences_by_rule(c.matches, shown(c), c.sentences),
        sql("matches shown_posts sentences", """
SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY m.post_id, m.sentence_seq) - 1
  AS rnum, m.post_id, m.sentence_seq, full_text
FROM matches m JOIN shown_posts USING (post_id)
JOIN sentences s ON s.post_id = m.post_id AND s.sentence_seq = m.sentence_seq"""),
    ),
    "sentences_by_ruleset": (by_ruleset(False), by_ruleset_sql("r.topic_id = p.topic_id")),
    "sentences_by_ruleset_parity": (by_ruleset(True), by_ruleset_sql("true")),
    "sentence_primary_ruleset": (
        lambda c: r.sentence_primary_ruleset(c.matches, c.rules),
        sql("matches rules", """
SELECT post_id, sentence_seq, rule_id, category_seq FROM (
  SELECT post_id, sentence_seq, min(rule_id) AS rule_id FROM matches GROUP BY 1, 2)
JOIN rules USING (rule_id)"""),
    ),
    "dashboard": (
        dashboard_rows,
        sql("shown_posts rulesets rules packed_rules rule_counts watermark post_counts", f"""
{_PAGE}
SELECT 'posts_count' AS part, CAST(NULL AS BIGINT) AS post_id, CAST(NULL AS BIGINT) AS rule_id,
  CAST(NULL AS INTEGER) AS category_seq, CAST(NULL AS VARCHAR) AS label, count(*) AS count
FROM shown_posts
UNION ALL SELECT 'post', post_id, NULL, NULL, title, NULL FROM page
UNION ALL SELECT 'ruleset', NULL, NULL, category_seq, name, NULL FROM rulesets WHERE topic_id = 1
UNION ALL SELECT 'rule', NULL, rule_id, category_seq, array_to_string(rule_words, ' '), NULL
  FROM packed_rules WHERE topic_id = 1
UNION ALL SELECT 'rule_count', NULL, rule_id, NULL, NULL, coalesce(count, 0) FROM (
  SELECT rule_id FROM watermark JOIN rules USING (rule_id) WHERE topic_id = 1
  UNION SELECT rule_id FROM rule_counts) LEFT JOIN rule_counts USING (rule_id)
UNION ALL SELECT 'post_count', post_id, NULL, category_seq, NULL, count
  FROM post_counts JOIN page USING (post_id)"""),
    ),
}
