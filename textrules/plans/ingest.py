"""Files to posts, sentences, words and vocabulary: one batch of an ingest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators.numbering import number_words
from textrules.operators.sentences import sentence_rows, with_words, word_rows
from textrules.operators.vocabulary import added_words, encode_words
from textrules.session import checked_broadcast, written


@dataclass
class Ingested:
    posts: DataFrame
    sentences: DataFrame
    new_words: DataFrame
    sentence_words: DataFrame


def give_post_ids(posts: DataFrame, stored: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Dense ids from ``first``, or after the largest stored one, in the order of the hashed paths.

    Only paths are numbered; texts move for it only when the paths outgrow a broadcast.
    """
    ids = number_words(posts.select("path"), "path", "post_id", start=first)
    if stored is not None:
        top = stored.agg((F.coalesce(F.max("post_id"), F.lit(-1)) + 1).cast("long").alias("_next"))
        ids = ids.join(F.broadcast(top)).select(  # one row
            "path", (F.col("post_id") + F.col("_next")).alias("post_id")
        )
    return posts.join(checked_broadcast(ids), "path")


def post_sentences(posts: DataFrame, words: Callable[[Column], Column] = tx.words) -> DataFrame:
    """Sentences with packed words of posts that have post_id and text."""
    return with_words(sentence_rows(posts, split=tx.text_sentences), words)


def ingest(
    posts: DataFrame,
    vocab: DataFrame | Callable[[DataFrame], DataFrame],
    store: Callable[[DataFrame, str], DataFrame] = written,
    top: int | None = None,
    words: Callable[[Column], Column] = tx.words,
) -> Ingested:
    """``posts``: post_id and text besides its other columns; ``vocab``: what is known so far, or a
    function that looks up distinct words, with ``top``, the largest id given so far.

    ``store`` writes a table and reads it back. Sentences are stored before the vocabulary is
    made from them, and new words before words are looked up, so no text is cut twice.
    """
    stored_posts = store(posts.drop("text"), "posts")
    sentences = store(post_sentences(posts, words), "sentences")
    rows = word_rows(sentences)
    known = vocab(rows.select("word").distinct()) if callable(vocab) else vocab
    new = store(added_words(known, rows, top), "words")
    encoded = encode_words(sentences.drop("full_text"), known.select("word_id", "word").unionByName(new))
    return Ingested(stored_posts, sentences, new, store(encoded, "sentence_words"))
