"""From arriving files to reports in one stream: posts, words, matches and their counts, batch by batch.

A batch takes its files through these steps, each stored in a folder of the batch:

1. files that cannot be a post (no title, no time, no text) go to ``quarantine`` with the reason;
2. files that are posts already, by topic, source and file name, are left out;
3. names of topics and sources are looked up or created;
4. posts, sentences, words and their places, with ids that go on from the batch before;
5. matches of all rules in the batch's stored sentences, and of rules that are new since the batch
   before in all earlier sentences; every rule's mark then is the newest post;
6. what the matches add to the counts, and what rules that are gone take away from them.

Nothing of earlier batches is read but their log row, their marks, the buckets of the batch's own
words and file names, and, when a rule is new, the sentences it has not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textrules.functions import text as tx
from textrules.operators.counts import MatchCounts, deltas_of, deltas_without_rules, no_counts
from textrules.operators.incremental import NO_MARK
from textrules.operators.matching import rule_matches
from textrules.operators.vocabulary import added_words
from textrules.plans.ingest import give_post_ids, ingest
from textrules.schemas import TABLES
from textrules.session import checked_broadcast, dealt, written
from textrules.sources.text_files import file_stem
from textrules.streaming.jobs import batch_vocabulary, start
from textrules.streaming.state import BatchState, bucket_of

POSTS = T.StructType([*TABLES["posts"].fields, T.StructField("path", T.StringType())])
SENTENCES = T.StructType([*TABLES["sentences"].fields, T.StructField("words", T.ArrayType(T.StringType()))])
FILES = T.StructType([T.StructField("name", T.StringType())])
GONE = T.StructType([T.StructField("rule_id", T.LongType())])
COUNTERS = ("posts", "words", "topics", "sources")


def judged(files: DataFrame) -> DataFrame:
    """``files`` (path, topic, source, title, url, stamp, text) with ts and the reason they are refused."""
    blank = lambda c: F.coalesce(tx.strip(F.col(c)) == "", F.lit(True))
    stamped = files.withColumn("ts", F.col("stamp").try_cast("timestamp"))
    reason = F.when(blank("title"), "no title").when(F.col("ts").isNull(), "no time").when(blank("text"), "no text")
    return stamped.withColumn("reason", reason)


def _names(files: DataFrame) -> Column:
    return F.concat_ws("\x1f", "topic", "source", file_stem())


def _dimension(state: BatchState, names: DataFrame, table: str, key: str) -> DataFrame:
    """(key, name) of the names of a batch; unseen ones are created."""
    known = state.earlier(table, TABLES[table]).select(F.col(key).cast("long").alias("word_id"), F.col("name").alias("word"))
    added = added_words(known, names.select(F.col("name").alias("word")), state.last[table])
    added = added.select(F.col("word_id").cast("int").alias(key), F.col("word").alias("name"))
    new = state.put(added, table)
    return state.earlier(table, TABLES[table]).unionByName(new)


def _batch_posts(state: BatchState, arrived: DataFrame) -> DataFrame:
    """The batch's new posts (post_id, topic_id, source_id, title, url, ts, path, text)."""
    state.put(arrived.filter("reason is not null").select("path", "reason"), "quarantine")
    good = arrived.filter("reason is null").withColumn("_name", _names(arrived))
    first = good.groupBy("_name").agg(F.min("path").alias("path"))
    wanted = written(first.select(F.col("_name").alias("name"), "path", bucket_of("_name")), "stream-files")
    known = state.earlier_of_keys("files", FILES, wanted, "name")
    fresh = wanted.join(known, "name", "left_anti")
    state.put(fresh.select("name", "bucket"), "files")
    posts = good.join(checked_broadcast(fresh.select("path")), "path", "left_semi")
    for table, key, column in (("topics", "topic_id", "topic"), ("sources", "source_id", "source")):
        names = posts.select(F.col(column).alias("name")).distinct()
        ids = checked_broadcast(_dimension(state, names, table, key).select(key, F.col("name").alias(column)))
        posts = posts.join(ids, column)
    numbered = give_post_ids(posts, first=state.last["posts"])
    return numbered.select(*(F.col(f.name).cast(f.dataType) for f in POSTS.fields), "text")


def stream_reports(
    files: DataFrame,
    rules: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    once: bool = False,
    words: Callable[[Column], Column] = tx.words,
) -> StreamingQuery:
    """Take files (path, topic, source, title, url, stamp, text) as they arrive through all steps.

    ``rules`` gives the packed rules as they are when a batch starts. ``StreamTables`` reads what
    has been stored.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = BatchState(spark, path, batch_id, COUNTERS)

        def store(table: DataFrame, name: str) -> DataFrame:
            if name == "words":
                return state.put(table.withColumn("bucket", bucket_of("word")), name).drop("bucket")
            return state.put(table, name)

        arrived = written(judged(dealt(batch)), "stream-arrived")
        done = ingest(_batch_posts(state, arrived), batch_vocabulary(state), store, state.last["words"], words)
        n_posts = state.last["posts"] + done.posts.count()

        now = written(rules().select("rule_id", "gap", "words"), "stream-rules")
        marks = state.of_batch("marks", TABLES["rule_watermark"], batch_id - 1)
        added = written(now.join(marks.select("rule_id"), "rule_id", "left_anti"), "stream-new-rules")
        gone = state.put(marks.join(now.select("rule_id"), "rule_id", "left_anti").select("rule_id"), "gone")
        found = rule_matches(done.sentences, now)
        posts = done.posts
        if batch_id > 0 and not added.isEmpty():
            found = found.unionByName(rule_matches(state.earlier("sentences", SENTENCES), added))
            posts = posts.unionByName(state.earlier("posts", POSTS))
        matches = state.put(found, "matches")
        deltas = deltas_of(matches, posts)
        if not gone.isEmpty():
            earlier = MatchCounts(*(
                state.earlier(name, table.schema) for name, table in _tables(no_counts(spark)).items()
            ))
            deltas = deltas.plus(deltas_without_rules(earlier, gone))
        for name, table in _tables(deltas).items():
            state.put(table, name)
        newest = F.lit(n_posts - 1 if n_posts else NO_MARK).cast("long").alias("last_post_id")
        state.put(now.select("rule_id", newest), "marks")
        state.commit(
            posts=n_posts, words=state.last["words"] + done.new_words.count(),
            **{t: state.last[t] + state.of_batch(t, TABLES[t], batch_id).count() for t in ("topics", "sources")},
        )

    return start(files, each, checkpoint, once)


def _tables(counts: MatchCounts) -> dict[str, DataFrame]:
    return {"by_day": counts.by_day, "by_post": counts.by_post}


class StreamTables:
    """What the batches up to now have stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """posts, sentences, words, sentence_words, topics, sources or quarantine."""
        return self._read(name).drop("batch_id", "bucket")

    @property
    def counts(self) -> MatchCounts:
        return MatchCounts(self.table("by_day"), self.table("by_post"))

    @property
    def matches(self) -> DataFrame:
        """Matches of rules that are still there: those found after a rule was last gone."""
        gone = self._read("gone").groupBy("rule_id").agg(F.max("batch_id").alias("_gone"))
        held = self._read("matches").join(checked_broadcast(gone), "rule_id", "left")
        return held.filter("_gone is null or batch_id > _gone").drop("batch_id", "_gone")

    @property
    def marks(self) -> DataFrame:
        """The marks after the newest batch that has been finished."""
        newest = self._read("log").agg(F.max("batch_id").alias("n")).first()["n"]
        return self.spark.read.parquet(f"{self.path}/marks/batch_id={newest}")
