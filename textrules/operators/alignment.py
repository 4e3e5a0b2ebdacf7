"""Aligning a labelled training set with stored sentences.

``training``: row_key (unique string), label, key. ``labels``: label_id, label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators.numbering import number_words
from textrules.operators.skew import join_skewed
from textrules.operators.vocabulary import encode_words
from textrules.session import BROADCAST_BYTES, BUCKETS, bucketed, checked_broadcast, fits_broadcast, written

# Fixed value: the third column of every label row.
LABEL_SOURCE = 3


def labelled_rows(tables: dict[str, DataFrame], sentence: str = "sentence") -> DataFrame:
    """row_key, label, sentence of one table per label. Equal rows stay apart by copy number.

    Header rows are the reader's business (``csv_source(header=True)`` drops the first row);
    here every row is a sentence, whatever it says.
    """
    rows = [t.select(F.lit(label).alias("label"), F.col(sentence).alias("sentence"))
            for label, t in tables.items()]
    counted = reduce(DataFrame.unionByName, rows).filter("sentence IS NOT NULL").groupBy(
        "label", "sentence"
    ).agg(F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    return counted.select("label", "sentence", copies).select(
        F.concat_ws(":", "label", "_copy", F.md5("sentence")).alias("row_key"), "label", "sentence"
    )


def training_set(labelled: DataFrame) -> DataFrame:
    """row_key, label, key from (row_key, label, sentence); empty cells are dropped."""
    return labelled.filter(F.col("sentence").isNotNull()).select(
        "row_key", "label", tx.match_key(F.col("sentence")).alias("key")
    )


def key_index(sentences: DataFrame) -> DataFrame:
    """key, post_id, sentence_seq: rows rather than lists, as a key may be very common."""
    return sentences.select(
        tx.match_key(F.col("full_text")).alias("key"), "post_id", "sentence_seq"
    )


def labels_found(
    training: DataFrame, index: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per label and stored sentence with the same key.

    Equal training rows are folded to one with their number in ``copies``, so a common
    key gives at most one row per label and stored sentence, not all pairs.
    """
    folded = training.groupBy("label", "key").agg(F.count(F.lit(1)).alias("copies"))
    known = folded.join(checked_broadcast(labels), "label")
    small = fits_broadcast(known, limit)
    pairs = index.join(F.broadcast(known), "key") if small else join_skewed(index, known, "key")
    return pairs.select(
        "post_id", "sentence_seq", F.lit(LABEL_SOURCE).alias("source"), "label_id", "label", "copies"
    )


def labels_new(training: DataFrame, index: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows not stored yet: they become sentences 0, 1, … of one new post.

    Training keys are few next to stored sentences: the stored ones among them are picked out where
    they lie, so no key of the corpus is shuffled but those.
    """
    asked = training.select("key").distinct()
    if fits_broadcast(asked):
        stored = index.select("key").join(F.broadcast(asked), "key", "left_semi").distinct()
        unseen = training.join(checked_broadcast(stored), "key", "left_anti")
    else:
        unseen = training.join(index.select("key").distinct(), "key", "left_anti")
    numbered = number_words(unseen, "row_key", "_n", start=0)
    top = index.agg(F.coalesce(F.max("post_id"), F.lit(-1)).cast("long").alias("_top"))
    return (
        numbered.join(checked_broadcast(labels), "label")
        .join(F.broadcast(top))  # one row
        .select(
            (F.col("_top") + 1).alias("post_id"),
            F.col("_n").alias("sentence_seq"),
            F.lit(LABEL_SOURCE).alias("source"),
            "label_id", "label", F.col("key").alias("text"),
        )
    )


# -- on stored keys -----------------------------------------------------------------------


@dataclass(frozen=True)
class StoredKeys:
    """``keys``: key, key_id, n, by key; ``places``: key_id, post_id, sentence_seq, in the order of key_id;
    ``top``: the largest post id, -1 if there is none.

    A key of very many sentences is one row of ``keys``, and a run of rows over several files of
    ``places``: no bucket and no task has to hold it.
    """

    keys: DataFrame
    places: DataFrame
    top: int


def store_keys(sentences: DataFrame) -> StoredKeys:
    """Make each stored sentence's key once, and lay keys and places out for alignment."""
    index = written(key_index(sentences), "key-rows")
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = bucketed(number_words(counts, "key", "key_id"), "keys", "key")
    ids = keys.select(F.col("key").alias("word"), F.col("key_id").alias("word_id"))
    places = encode_words(index.withColumnRenamed("key", "word"), ids).withColumnRenamed("word_id", "key_id")
    order = ["key_id", "post_id", "sentence_seq"]
    places = written(places.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), "key-places")
    top = index.agg(F.max("post_id").alias("top")).first()["top"]
    return StoredKeys(keys, places, -1 if top is None else top)


def store_training(training: DataFrame) -> DataFrame:
    """label, key, copies, row_keys of a training set, by key; equal rows are folded.

    Rows are dealt out by key before they are folded: where they lie then, they stay.
    """
    folded = training.repartition(BUCKETS, "key").groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("copies"), F.collect_list("row_key").alias("row_keys")
    )
    return bucketed(folded.select("label", "key", "copies", "row_keys"), "training", "key")


def stored_labels_found(
    training: DataFrame, stored: StoredKeys, labels: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``labels_found`` over ``store_training`` and ``store_keys``: keys meet bucket by bucket."""
    met = training.drop("row_keys").join(stored.keys.select("key", "key_id"), "key")
    known = met.join(checked_broadcast(labels), "label").select("key_id", "label_id", "label", "copies")
    known = written(known, "keys-met")
    places = stored.places
    pairs = places.join(F.broadcast(known), "key_id") if fits_broadcast(known, limit) else join_skewed(places, known, "key_id")
    return pairs.select(
        "post_id", "sentence_seq", F.lit(LABEL_SOURCE).alias("source"), "label_id", "label", "copies"
    )


def stored_labels_new(training: DataFrame, stored: StoredKeys, labels: DataFrame) -> DataFrame:
    """``labels_new`` over the same: no key of the corpus moves."""
    unseen = training.join(stored.keys.select("key"), "key", "left_anti")
    rows = unseen.select("label", "key", F.explode("row_keys").alias("row_key"))
    numbered = number_words(rows, "row_key", "_n", start=0)
    return numbered.join(checked_broadcast(labels), "label").select(
        F.lit(stored.top + 1).cast("long").alias("post_id"), F.col("_n").alias("sentence_seq"),
        F.lit(LABEL_SOURCE).alias("source"), "label_id", "label", F.col("key").alias("text"),
    )


def labels_unknown(training: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels without an id, with how many training rows carry them."""
    counts = training.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(labels, "label", "left_anti")
