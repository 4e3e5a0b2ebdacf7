"""Vocabulary, small dimensions, and word indexes."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions import blocks
from textrules.operators.numbering import number_rows, number_words
from textrules.session import BROADCAST_BYTES, fits_broadcast, written

# The code of blocks travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(blocks)

SEGMENT = 1 << 15


def vocab_build(words: DataFrame) -> DataFrame:
    """Distinct words with dense ids from 1."""
    return number_words(words.select("word").distinct()).select("word_id", "word")


def added_words(vocab: DataFrame, words: DataFrame, top: int | None = None) -> DataFrame:
    """The unseen words alone, with ids that go on from ``top``, or from the largest known one."""
    unseen = words.select("word").distinct().join(vocab, "word", "left_anti")
    if top is not None:
        return number_words(unseen, start=top + 1).select("word_id", "word")
    largest = vocab.agg(F.coalesce(F.max("word_id"), F.lit(0)).cast("long").alias("_top"))
    return (
        number_words(unseen)
        .join(F.broadcast(largest))  # one row
        .select((F.col("word_id") + F.col("_top")).alias("word_id"), "word")
    )


def vocab_upsert(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Add unseen words; known words keep their ids, new ids go on from the largest."""
    return vocab.select("word_id", "word").unionByName(added_words(vocab, words))


def dim_upsert(dim: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Look names up in a dimension (key, name), creating the missing ones after the largest key."""
    vocab = dim.select(F.col(key).cast("long").alias("word_id"), F.col("name").alias("word"))
    grown = vocab_upsert(vocab, names.select(F.col("name").alias("word")))
    return grown.select(
        F.col("word_id").cast(dim.schema[key].dataType).alias(key), F.col("word").alias("name")
    )


def encode_words(rows: DataFrame, vocab: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Replace word by word_id (rows with unknown words drop out).

    ``rows`` have one word each, or packed ``words``: then each word gives a row with its place as word_seq.
    A vocabulary measured to fit is broadcast. Beyond that, rows are encoded in blocks, packed ones as they are.
    """
    packed = "words" in rows.columns
    rest = [c for c in rows.columns if c not in ("word", "words")]
    if fits_broadcast(vocab, limit):
        if packed:
            rows, rest = rows.select(*rest, F.posexplode("words").alias("word_seq", "word")), [*rest, "word_seq"]
        return rows.join(F.broadcast(vocab), "word").select(*rest, "word_id")
    if not packed:
        return _in_blocks(rows.filter("word IS NOT NULL"), vocab, "word", rest, "word_id bigint")
    found = _in_blocks(rows.filter("words IS NOT NULL"), vocab, "words", rest, "_ids array<bigint>")
    return found.select(*rest, F.posexplode("_ids").alias("word_seq", "word_id")).filter("word_id IS NOT NULL")


def encode_lists(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sentences with the ids of their ``words`` beside them as ``word_ids``, in the same order; an unknown
    word has none. No word is a row of its own, whatever the vocabulary's size."""
    whole = sentences.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return _in_blocks(whole, vocab, "words", whole.columns, "word_ids array<bigint>")


def _in_blocks(rows: DataFrame, vocab: DataFrame, column: str, kept: list[str], out: str) -> DataFrame:
    """Columns ``kept`` of rows and ``out``, the ids of the words in ``column``, looked up block by block.

    Rows are packed as they lie, about a million words to a block, and only the distinct words of a block go to
    the vocabulary and back. So a hot word is one row a block, and no row of a word is shuffled alone.
    """
    name, kind = out.split()
    schema = rows.select(*kept, F.lit(None).cast(kind).alias(name)).schema
    packed = rows.mapInArrow(blocks.packed(column), "words array<string>, body binary")
    stored = written(packed.withColumn("block", F.monotonically_increasing_id()), "word-blocks")
    asked = stored.select(F.col("block").alias("of"), F.posexplode("words").alias("code", "word"))
    ids = asked.join(vocab.select("word", "word_id"), "word").select("of", "code", "word_id")
    # the words go along only where they come out again
    words = F.col("words") if column in kept else F.lit(None).cast("array<string>").alias("words")
    bodies = stored.select("block", words, F.size("words").alias("n"), "body")
    return bodies.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(
        blocks.unpacked(column, name, schema.names), schema
    )


def with_word_ids(sentences: DataFrame, sentence_words: DataFrame) -> DataFrame:
    """Sentences with their words' ids packed beside the words, in the same order.

    Stored once, so that what needs the words of a sentence never puts them together again.
    """
    keys = ["post_id", "sentence_seq"]
    packed = sentence_words.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word_id"))), lambda x: x["word_id"]).alias("word_ids")
    )
    none = F.array().cast("array<bigint>")
    return sentences.join(packed, keys, "left").withColumn("word_ids", F.coalesce("word_ids", none))


def packed_posting_rows(sentences: DataFrame) -> DataFrame:
    """word_id, rnum of every word of every sentence, once each, from packed ids.

    Sentences are numbered as they are, one row each; words come out after that.
    """
    numbered = number_rows(sentences.select("post_id", "sentence_seq", F.array_distinct("word_ids").alias("word_ids")))
    return numbered.select(F.explode("word_ids").alias("word_id"), "rnum")


def posting_rows(sentence_words: DataFrame, numbers: DataFrame) -> DataFrame:
    """word_id, rnum of every occurrence. A sentence repeating a word gives a pair twice;
    lists and bitmaps take it once, so no shuffle is spent on that here."""
    keys = ["post_id", "sentence_seq"]
    return sentence_words.join(numbers.select(*keys, "rnum"), keys).select("word_id", "rnum")


def posting_lists(postings: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per word and segment of sentence numbers, the ordered list: never over ``segment`` long."""
    part = F.expr(f"rnum div {segment}").cast("int").alias("segment")
    return postings.groupBy("word_id", part).agg(
        F.array_sort(F.collect_set("rnum")).alias("rnums")
    )


def posting_bitmaps(postings: DataFrame) -> DataFrame:
    """Per word and bucket of 32,768 sentence numbers, a bitmap. Bit 0 is the first number.

    The numbers are shuffled, not half-filled bitmaps: a bitmap takes 4 KB however few bits
    it has, and one group never has more numbers than a bucket.
    """
    position = F.col("rnum") + 1
    return (
        postings.withColumn("bucket", F.bitmap_bucket_number(position))
        .repartition("word_id", "bucket")
        .groupBy("word_id", "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap"))
    )


def _nonzero(bits: Column, parts: int, width: int) -> Column:
    """Indexes of the ``width``-byte parts that have any bit set."""
    empty = F.lit(bytearray(width))
    return F.filter(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda k: F.substring(bits, k * width + 1, F.lit(width)) != empty,
    )


def bitmap_positions(bitmaps: DataFrame) -> DataFrame:
    """Read the set bits back as (word_id, rnum), opening only parts that are not empty."""
    parts = bitmaps.select(
        "word_id", ((F.col("bucket") - 1) * SEGMENT).alias("base"), F.col("bitmap").alias("bits")
    )
    width = SEGMENT // 8
    while width > 1:  # 4096 bytes, then parts of 256, 16 and 1
        width //= 16
        parts = parts.select(
            "word_id", "base", "bits", F.explode(_nonzero(F.col("bits"), 16, width)).alias("k")
        ).select(
            "word_id", (F.col("base") + F.col("k") * width * 8).alias("base"),
            F.substring("bits", F.col("k") * width + 1, F.lit(width)).alias("bits"),
        )
    octets = parts.select("word_id", "base", F.conv(F.hex("bits"), 16, 10).cast("int").alias("octet"))
    set_bits = F.expr("filter(sequence(0, 7), b -> shiftright(octet, b) & 1 = 1)")
    return octets.select("word_id", "base", F.explode(set_bits).alias("bit")).select(
        "word_id", (F.col("base") + F.col("bit")).cast("long").alias("rnum")
    )


def sentences_of_numbers(numbers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(post_id, sentence_seq) of given sentence numbers."""
    return numbers.join(wanted.select("rnum"), "rnum", "left_semi")


def numbers_of_posts(numbers: DataFrame, posts: DataFrame) -> DataFrame:
    """Sentence numbers restricted to a set of posts."""
    return numbers.join(posts.select("post_id"), "post_id", "left_semi")
