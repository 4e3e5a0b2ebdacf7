"""Posts to sentences to words. All row-local: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions import text as tx


def sentence_rows(
    posts: DataFrame,
    text: str = "text",
    split: Callable[[Column], Column] = tx.plain_sentences,
    key: str = "post_id",
) -> DataFrame:
    """One row per sentence: key, sentence_seq from 0, full_text."""
    return posts.select(key, F.posexplode(split(F.col(text))).alias("sentence_seq", "full_text"))


def with_words(sentences: DataFrame, words: Callable[[Column], Column] = tx.words) -> DataFrame:
    """Add the ordered words as one array, the packed form the matcher reads.

    ``words`` cuts a sentence: into bare words, or with ``tagged_words`` into words and their classes.
    """
    return sentences.withColumn("words", words(F.col("full_text")))


def word_rows(sentences: DataFrame, key: str = "post_id") -> DataFrame:
    """Long form: one row per word with word_seq from 0."""
    return sentences.select(key, "sentence_seq", F.posexplode("words").alias("word_seq", "word"))


def tag_tokens(
    sentences: DataFrame, lexicon: DataFrame | None = None, key: str = "post_id"
) -> DataFrame:
    """Ordered tokens with a class tag; words found in the lexicon take its tag.

    ``lexicon`` has columns token, tag (token unique).
    """
    from textrules.session import checked_broadcast

    tokens = sentences.select(
        key,
        "sentence_seq",
        F.posexplode(tx.extract_all(F.col("full_text"), tx.SURFACE)).alias("word_seq", "token"),
    )
    by_shape = tx.token_class(F.col("token"))
    if lexicon is None:
        return tokens.withColumn("tag", by_shape)
    known = lexicon.select("token", F.col("tag").alias("_tag"))
    return tokens.join(checked_broadcast(known), "token", "left").select(
        key, "sentence_seq", "word_seq", "token", F.coalesce("_tag", by_shape).alias("tag")
    )


def tagged_text(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Replace a text column by ``"tok_TAG tok_TAG …"``; rows without text go to a second table."""
    good = rows.filter(F.col(text).isNotNull()).withColumn(
        text, F.array_join(tx.tagged_words(F.col(text)), " ")
    )
    bad = rows.filter(F.col(text).isNull()).withColumn("error", F.lit("no text"))
    return good, bad


def scrub_rows(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Scrub phones and links; broken rows are dropped. Second table: the changed rows."""
    valid = rows.filter(~F.col(text).contains(tx.MOJIBAKE))
    both = valid.withColumn("_raw", F.col(text)).withColumn(text, tx.scrub(F.col(text)))
    changed = both.filter(F.col("_raw") != F.col(text)).select(
        *[c for c in rows.columns if c != text],
        F.col("_raw").alias("before"),
        F.col(text).alias("after"),
    )
    return both.drop("_raw"), changed
