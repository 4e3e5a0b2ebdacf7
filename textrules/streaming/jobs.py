"""File streams in, tables out. Each micro-batch writes its own folder, so repeating one is harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textrules.operators.matching import rule_matches
from textrules.plans.ingest import give_post_ids, ingest, post_sentences
from textrules.schemas import TABLES
from textrules.session import dealt, written
from textrules.streaming.state import BatchState, bucket_of

EVERY = "20 minutes"


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": EVERY}
    return writer.trigger(**trigger).start()


def stream_rule_matches(
    posts: DataFrame,
    rules: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Match every sentence of arriving posts (post_id, text) against the rules as they are
    when its batch starts.

    Sentences are cut as the ingest cuts them, so their numbers are those of stored sentences.
    ``streaming.reports`` also shows rules that are added later the older posts.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sentences = written(post_sentences(dealt(batch)).drop("full_text"), "stream-sentences")  # cut once
        rule_matches(sentences, rules()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(posts, each, checkpoint, once)


def batch_vocabulary(state: BatchState) -> Callable[[DataFrame], DataFrame]:
    """A look-up of a batch's words among those of earlier batches, by their buckets."""

    def known(words: DataFrame) -> DataFrame:
        wanted = state.put(words.select("word", bucket_of("word")), "batch_words")
        return state.earlier_of_keys("words", TABLES["words"], wanted, "word")

    return known


def stream_ingest_files(
    posts: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Turn arriving posts (path, text, …) into posts, sentences, sentence_words and words.

    Ids go on from the log of the batch before; of earlier words only the buckets of the batch's
    own words are read. No earlier post is.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        state = BatchState(batch.sparkSession, path, batch_id, ("posts", "words"))

        def store(table: DataFrame, name: str) -> DataFrame:
            if name == "words":
                return state.put(table.withColumn("bucket", bucket_of("word")), name).drop("bucket")
            return state.put(table, name)

        arrived = give_post_ids(dealt(batch), first=state.last["posts"])
        done = ingest(arrived, batch_vocabulary(state), store, top=state.last["words"])
        state.commit(
            posts=state.last["posts"] + done.posts.count(), words=state.last["words"] + done.new_words.count()
        )

    return start(posts, each, checkpoint, once)


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """A table the batches have written."""
    return spark.read.parquet(path).drop("batch_id", "bucket")

