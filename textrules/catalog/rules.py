"""Rule and ruleset maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.catalog.sql import sql, sql_plain_sentences
from textrules.functions import text as tx
from textrules.operators import rules as op
from textrules.operators.vocabulary import vocab_upsert


def stored_rule_words(c) -> tuple[DataFrame, DataFrame]:
    """Rule words as stored: by id of a vocabulary that holds them all."""
    grown = vocab_upsert(c.vocab, c.rule_words.select("word"))
    return c.rule_words.join(grown, "word").select("rule_id", "word_seq", "word_id"), grown


def joined(column):
    return F.array_join(column, " ").alias(column)


def rule_words(c):
    packed = op.pack_rules(c.rules, c.rule_words)
    return packed.select("rule_id", "topic_id", "category_seq", "gap", joined("words"))


def rule_words_of_topic(c):
    packed = op.pack_rules(c.rules.filter("topic_id = 1"), c.rule_words)
    return packed.select("rule_id", "category_seq", "gap", joined("words"))


def rules_with_words(c):
    words, vocab = stored_rule_words(c)
    return op.rules_with_words(c.rules, words, vocab).withColumn("words", joined("words"))


def new_rules(c) -> DataFrame:
    """Rules made from the first turn of every conversation: its words 0, 1 and 3."""
    example = F.get(tx.plain_sentences(F.col("text")), F.lit(0))
    chosen = F.filter(
        F.transform(
            tx.words(F.col("full_text")),
            lambda w, i: F.struct(i.alias("seq"), w.alias("word")),
        ),
        lambda x: x["seq"].isin(0, 1, 3),
    )
    return (
        c.table("conversations")
        .filter("turn = 0")
        .select(
            F.col("conv_id").alias("new_key"),
            (F.col("conv_id") % 2 + 1).cast("int").alias("topic_id"),
            (F.col("conv_id") % 5 + 1).cast("int").alias("category_seq"),
            example.alias("full_text"),
        )
        .withColumn("chosen", chosen)
    )


def rules_add(c):
    words, vocab = stored_rule_words(c)
    rules, words, vocab = op.rules_add(c.rules, words, vocab, new_rules(c))
    return (
        rules.join(words, "rule_id")
        .join(vocab, "word_id")
        .select("rule_id", "topic_id", "category_seq", "word_seq", "word")
    )


def vocabulary_after_rules_add(c):
    words, vocab = stored_rule_words(c)
    return op.rules_add(c.rules, words, vocab, new_rules(c))[2].select("word")


def state(c) -> dict[str, DataFrame]:
    return {
        "rules": c.rules,
        "rule_words": c.rule_words,
        "matches": c.matches,
        "rule_watermark": c.watermark,
        "rulesets": c.rulesets,
    }


def per_rule(tables: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, table in tables.items():
        if "rule_id" not in table.columns:
            continue
        piece = (
            table.groupBy("rule_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("table_name", F.lit(name))
        )
        rows = piece if rows is None else rows.unionByName(piece)
    return rows


def rule_delete_cascade(c):
    """Delete the rules of which no word is over four letters long."""
    short = c.packed_rules.filter(F.forall("words", lambda w: F.length(w) <= 4))
    return per_rule(op.delete_rules(state(c), short))


_STATE = """
state AS (
  SELECT 'rules' AS table_name, rule_id FROM rules
  UNION ALL SELECT 'rule_words', rule_id FROM rule_words
  UNION ALL SELECT 'matches', rule_id FROM matches
  UNION ALL SELECT 'rule_watermark', rule_id FROM watermark)"""


def source_reset(c):
    left = op.reset_source(
        {
            "posts": c.posts, "sentences": c.sentences, "sentence_words": c.sentence_words,
            "sources": c.sources,
        },
        topic_id=1,
        source_id=3,
    )
    rows = None
    for name in ("posts", "sentences", "sentence_words"):
        piece = left[name].groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
        piece = piece.select(F.lit(name).alias("table_name"), F.col("post_id").alias("id"), "n")
        rows = piece if rows is None else rows.unionByName(piece)
    names = left["sources"].select(
        F.lit("sources").alias("table_name"), F.col("source_id").cast("long").alias("id"),
        F.lit(1).cast("long").alias("n"),
    )
    return rows.unionByName(names)


def new_rulesets(c):
    """One new ruleset per pair of topic and source, named after the source."""
    return c.posts.join(c.sources, "source_id").select("topic_id", "name").distinct()


ENTRIES = {
    "rule_words": (
        rule_words,
        sql("packed_rules", """
SELECT rule_id, topic_id, category_seq, gap, array_to_string(rule_words, ' ') AS words
FROM packed_rules"""),
    ),
    "rule_words_of_topic": (
        rule_words_of_topic,
        sql("packed_rules", """
SELECT rule_id, category_seq, gap, array_to_string(rule_words, ' ') AS words
FROM packed_rules WHERE topic_id = 1"""),
    ),
    "rules_with_words": (
        rules_with_words,
        sql("rules rule_words", """
SELECT r.rule_id, any_value(topic_id) AS topic_id, any_value(category_seq) AS category_seq,
  any_value(full_text) AS full_text, string_agg(word, ' ' ORDER BY word_seq) AS words
FROM rules r JOIN rule_words w ON w.rule_id = r.rule_id GROUP BY r.rule_id"""),
    ),
    "rules_add": (
        rules_add,
        sql("rules rule_words", f"""
fresh AS (
  SELECT (SELECT max(rule_id) FROM rules) + row_number() OVER (ORDER BY conv_id) AS rule_id,
    CAST(conv_id % 2 + 1 AS INTEGER) AS topic_id, CAST(conv_id % 5 + 1 AS INTEGER) AS category_seq,
    regexp_extract_all(lower(({sql_plain_sentences('text')})[1]), '[\\p{{L}}\\p{{N}}]+') AS l
  FROM conversations WHERE turn = 0)
SELECT rule_id, topic_id, category_seq, word_seq, word FROM rules JOIN rule_words USING (rule_id)
UNION ALL SELECT * FROM (
  SELECT rule_id, topic_id, category_seq, CAST(unnest(range(len(l))) AS INTEGER) AS word_seq,
    unnest(l) AS word FROM fresh) WHERE word_seq IN (0, 1, 3)"""),
    ),
    "rules_add_vocabulary": (
        vocabulary_after_rules_add,
        sql("rule_words tokens", f"""
fresh AS (SELECT regexp_extract_all(lower(({sql_plain_sentences('text')})[1]),
    '[\\p{{L}}\\p{{N}}]+') AS l FROM conversations WHERE turn = 0)
SELECT word FROM tokens UNION SELECT word FROM rule_words
UNION SELECT word FROM (SELECT unnest(range(len(l))) AS i, unnest(l) AS word FROM fresh)
WHERE i IN (0, 1, 3)"""),
    ),
    "rule_delete_cascade": (
        rule_delete_cascade,
        sql("matches rules rule_words watermark packed_rules", f"""{_STATE}
SELECT table_name, rule_id, count(*) AS n FROM state
WHERE rule_id NOT IN (SELECT rule_id FROM packed_rules
  WHERE len(list_filter(rule_words, lambda w: length(w) > 4)) = 0)
GROUP BY 1, 2"""),
    ),
    "ruleset_add": (
        lambda c: op.ruleset_add(c.rulesets, new_rulesets(c)),
        sql("rulesets posts sources", """
fresh AS (SELECT DISTINCT topic_id, s.name FROM posts JOIN sources s USING (source_id))
SELECT topic_id, category_seq, name FROM rulesets
UNION ALL SELECT f.topic_id,
  CAST(coalesce((SELECT max(category_seq) FROM rulesets r WHERE r.topic_id = f.topic_id), 0)
    + row_number() OVER (PARTITION BY f.topic_id ORDER BY f.name) AS INTEGER), f.name FROM fresh f"""),
    ),
    "next_category_seq": (
        lambda c: op.ruleset_add(
            c.rulesets.filter("topic_id <= 2"), c.topics.select("topic_id", "name")
        ),
        sql("rulesets topics", """
SELECT topic_id, category_seq, name FROM rulesets WHERE topic_id <= 2
UNION ALL SELECT topic_id, CASE WHEN topic_id <= 2 THEN 6 ELSE 1 END, name FROM topics"""),
    ),
    "ruleset_latest": (
        lambda c: op.ruleset_latest(op.ruleset_add(c.rulesets, new_rulesets(c))),
        sql("rulesets posts sources", """
fresh AS (SELECT DISTINCT topic_id, s.name FROM posts JOIN sources s USING (source_id))
SELECT topic_id, CAST(5 + count(*) AS INTEGER) AS category_seq, max(name) AS name
FROM fresh GROUP BY topic_id"""),
    ),
    "ruleset_delete_cascade": (
        lambda c: per_rule(op.delete_ruleset(state(c), 1, 3)),
        sql("matches rules rule_words watermark", f"""{_STATE}
SELECT table_name, rule_id, count(*) AS n FROM state
WHERE rule_id NOT IN (SELECT rule_id FROM rules WHERE topic_id = 1 AND category_seq = 3)
GROUP BY 1, 2"""),
    ),
    "rulesets_after_delete": (
        lambda c: op.delete_ruleset(state(c), 1, 3)["rulesets"],
        sql("rulesets", """
SELECT topic_id, category_seq, name FROM rulesets WHERE NOT (topic_id = 1 AND category_seq = 3)"""),
    ),
    "source_reset": (
        source_reset,
        sql("posts sentences tokens sources", """
kept AS (SELECT post_id FROM posts WHERE NOT (topic_id = 1 AND source_id = 3))
SELECT 'posts' AS table_name, post_id AS id, 1::BIGINT AS n FROM kept
UNION ALL SELECT 'sentences', post_id, count(*) FROM sentences JOIN kept USING (post_id) GROUP BY post_id
UNION ALL SELECT 'sentence_words', post_id, count(*) FROM tokens JOIN kept USING (post_id) GROUP BY post_id
UNION ALL SELECT 'sources', source_id, 1 FROM sources WHERE source_id <> 3"""),
    ),
    "rulesets_list": (
        lambda c: c.rulesets.filter("topic_id = 1").select("category_seq", "name"),
        sql("rulesets", "SELECT category_seq, name FROM rulesets WHERE topic_id = 1"),
    ),
    "rulesets_with_rules": (
        lambda c: op.rulesets_with_rules(c.rulesets, c.rules),
        sql("rulesets rules", """
SELECT topic_id, category_seq, name, rule_id, full_text
FROM rulesets JOIN rules USING (topic_id, category_seq)"""),
    ),
    "rules_ids": (
        lambda c: c.rules.filter("topic_id = 1").select("rule_id"),
        sql("rules", "SELECT rule_id FROM rules WHERE topic_id = 1"),
    ),
    "topics_list": (
        lambda c: c.topics,
        sql("topics", "SELECT topic_id, name FROM topics"),
    ),
    "sources_list": (
        lambda c: c.sources,
        sql("sources", "SELECT source_id, name FROM sources"),
    ),
    "watermark_gc": (
        lambda c: op.drop_stale_marks(c.watermark, c.rules.filter("topic_id = 1")),
        sql("watermark rules", """
SELECT rule_id, last_post_id FROM watermark
WHERE rule_id IN (SELECT rule_id FROM rules WHERE topic_id = 1)"""),
    ),
}
