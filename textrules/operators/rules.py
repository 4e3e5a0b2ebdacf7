"""Rule tables: packing, listing, adding and deleting.

``rules``: rule_id, topic_id, category_seq, full_text.
``rule_words``: rule_id, word_seq and word or word_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators.numbering import number_rows
from textrules.operators.vocabulary import vocab_upsert
from textrules.session import checked_broadcast


def pack_rules(rules: DataFrame, rule_words: DataFrame, word: str = "word") -> DataFrame:
    """One row per rule that has words: attributes, gap and the ordered word list.

    ``gap`` is the distance from the first to the last chosen word of the example.
    """
    packed = rule_words.groupBy("rule_id").agg(
        (F.max("word_seq") - F.min("word_seq")).cast("int").alias("gap"),
        F.array_sort(F.collect_list(F.struct("word_seq", F.col(word).alias("w")))).alias("_w"),
    )
    return (
        rules.select("rule_id", "topic_id", "category_seq")
        .join(packed, "rule_id")
        .withColumn("words", F.transform("_w", lambda x: x["w"]))
        .drop("_w")
    )


def rules_with_words(rules: DataFrame, rule_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rules with their display words (stored word without tag) in order; wordless rules drop out."""
    small = checked_broadcast(rule_words)
    worded = vocab.join(small, "word_id").withColumn("shown", _shown("word"))
    lists = worded.groupBy("rule_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("word_seq", "shown"))), lambda x: x["shown"]
        ).alias("words")
    )
    return rules.join(lists, "rule_id").select(
        "rule_id", "topic_id", "category_seq", "full_text", "words"
    )


def _shown(word: str):
    return F.when(F.col(word).contains("_"), tx.token_of(F.col(word))).otherwise(F.col(word))


def rulesets_with_rules(rulesets: DataFrame, rules: DataFrame) -> DataFrame:
    return rulesets.join(rules, ["topic_id", "category_seq"]).select(
        "topic_id", "category_seq", "name", "rule_id", "full_text"
    )


def ruleset_add(rulesets: DataFrame, new: DataFrame) -> DataFrame:
    """Append rulesets (topic_id, name): each topic's numbers go on from its largest, or from 1."""
    top = rulesets.groupBy("topic_id").agg(F.max("category_seq").alias("_top"))
    order = Window.partitionBy("topic_id").orderBy("name")
    added = (
        new.withColumn("_n", F.row_number().over(order))
        .join(top, "topic_id", "left")
        .select(
            "topic_id",
            (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int").alias("category_seq"),
            "name",
        )
    )
    return rulesets.select("topic_id", "category_seq", "name").unionByName(added)


def ruleset_latest(rulesets: DataFrame) -> DataFrame:
    """Per topic the ruleset with the largest number."""
    return rulesets.groupBy("topic_id").agg(
        F.max("category_seq").alias("category_seq"),
        F.max_by("name", "category_seq").alias("name"),
    )


def rules_add(
    rules: DataFrame, rule_words: DataFrame, vocab: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add rules given as (new_key BIGINT, topic_id, category_seq, full_text, chosen).

    ``chosen`` is ARRAY<STRUCT<seq INT, word STRING>>. Unknown words enter the vocabulary
    first. Returns the grown (rules, rule_words, vocab); ids go on in new_key order.
    """
    top = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("_top"))
    numbered = (
        number_rows(new.withColumn("_one", F.lit(0)), lead="new_key", tail="_one", start=1)
        .join(F.broadcast(top))  # one row
        .withColumn("rule_id", F.col("_top") + F.col("rnum"))
    )
    chosen = numbered.select("rule_id", F.explode("chosen").alias("c")).select(
        "rule_id", F.col("c.seq").alias("word_seq"), F.col("c.word").alias("word")
    )
    grown = vocab_upsert(vocab, chosen.select("word"))
    new_words = chosen.join(grown, "word").select("rule_id", "word_seq", "word_id")
    columns = ["rule_id", "topic_id", "category_seq", "full_text"]
    return (
        rules.select(*columns).unionByName(numbered.select(*columns)),
        rule_words.select("rule_id", "word_seq", "word_id").unionByName(new_words),
        grown,
    )


def delete_rules(tables: dict[str, DataFrame], rule_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove rules from every table that has a rule_id column (words, matches, marks, rules)."""
    gone = checked_broadcast(rule_ids.select("rule_id").distinct())
    return {
        name: table.join(gone, "rule_id", "left_anti") if "rule_id" in table.columns else table
        for name, table in tables.items()
    }


def delete_ruleset(tables: dict[str, DataFrame], topic_id: int, category_seq: int) -> dict[str, DataFrame]:
    """Remove one ruleset, its rules and everything hanging on them."""
    here = (F.col("topic_id") == topic_id) & (F.col("category_seq") == category_seq)
    left = delete_rules(tables, tables["rules"].filter(here))
    return {**left, "rulesets": left["rulesets"].filter(~here)}


def reset_source(tables: dict[str, DataFrame], topic_id: int, source_id: int) -> dict[str, DataFrame]:
    """Remove a (topic, source)'s posts with their sentences and words, and the source itself."""
    posts = tables["posts"]
    mine = (F.col("topic_id") == topic_id) & (F.col("source_id") == source_id)
    gone = posts.filter(mine).select("post_id")
    left = {
        name: table.join(gone, "post_id", "left_anti")
        for name, table in tables.items()
        if name in ("sentences", "sentence_words")
    }
    return {
        **tables,
        **left,
        "posts": posts.filter(~F.coalesce(mine, F.lit(False))),
        "sources": tables["sources"].filter(F.col("source_id") != source_id),
    }


def drop_stale_marks(marks: DataFrame, rules: DataFrame) -> DataFrame:
    """High-water marks of rules that still exist."""
    return marks.join(rules.select("rule_id"), "rule_id", "left_semi")
