"""The logical tables, derived from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators.matching import ANCHOR_SAMPLE, rule_matches
from textrules.operators.numbering import number_rows
from textrules.operators.rules import pack_rules
from textrules.operators.sentences import sentence_rows, with_words, word_rows
from textrules.operators.vocabulary import encode_lists, encode_words, vocab_build
from textrules.session import new_folder, spread, written
from textrules.sources.tables import write_posts

TOPICS = {"en": 1, "fr": 2, "de": 3, "es": 4}
CATEGORIES = range(1, 6)

_stored: dict[tuple[str, str, str], DataFrame] = {}


class Corpus:
    """Lazy tables over one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(
        self,
        name: str,
        build: Callable[[], DataFrame],
        write: Callable[[DataFrame, str], DataFrame] = written,
    ) -> DataFrame:
        """Build a table once per application and keep it written, as ingest and rule runs do."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = write(build(), name)
        return _stored[key]

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"), "page_id")

    @cached_property
    def topics(self) -> DataFrame:
        topic = F.create_map(*[F.lit(x) for pair in TOPICS.items() for x in pair])
        return self.documents.select(F.col("lang").alias("name")).distinct().select(
            topic[F.col("name")].alias("topic_id"), "name"
        )

    @cached_property
    def sources(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("name")).distinct().select(
            F.regexp_extract("name", r"src(\d+)", 1).try_cast("int").alias("source_id"), "name"
        )

    @cached_property
    def posts(self) -> DataFrame:
        return self.posts_of(self.documents)

    @staticmethod
    def posts_of(documents: DataFrame) -> DataFrame:
        topic = F
        for lang, number in TOPICS.items():
            topic = topic.when(F.col("lang") == lang, number)
        return documents.select(
            F.col("doc_id").alias("post_id"),
            topic.alias("topic_id"),
            F.regexp_extract("source", r"src(\d+)", 1).try_cast("int").alias("source_id"),
            F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
            F.lit(None).cast("string").alias("url"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 8760))")
            .alias("ts"),
            "text",
        )

    @cached_property
    def stored_posts(self) -> DataFrame:
        """Posts as the ingest leaves them, without their text."""
        path = new_folder(self.spark, "posts")
        return self.stored("posts", lambda: self.posts.drop("text"), lambda df, _: write_posts(df, path))

    @cached_property
    def raw_sentences(self) -> DataFrame:
        """Sentences with packed words, straight from the documents."""
        return with_words(sentence_rows(self.posts))

    @cached_property
    def sampled_sentences(self) -> DataFrame:
        """Sentences of a twentieth of the posts, sampled before any text work."""
        posts = self.posts_of(self.table("documents").sample(ANCHOR_SAMPLE, seed=7))
        return with_words(sentence_rows(posts))

    @cached_property
    def sentences(self) -> DataFrame:
        return self.stored("sentences", lambda: self.raw_sentences)

    @cached_property
    def word_rows(self) -> DataFrame:
        return word_rows(self.sentences)

    @cached_property
    def vocab(self) -> DataFrame:
        return self.stored("words", lambda: vocab_build(self.word_rows))

    @cached_property
    def sentence_words(self) -> DataFrame:
        return self.stored("sentence_words", lambda: encode_words(self.sentences.drop("full_text"), self.vocab))

    @cached_property
    def packed_sentences(self) -> DataFrame:
        """Sentences with words and their ids side by side; their text stays where it is, so it never moves."""
        return self.stored(
            "packed_sentences", lambda: encode_lists(self.sentences.drop("full_text"), self.vocab)
        )

    @cached_property
    def numbers(self) -> DataFrame:
        return number_rows(self.sentences.select("post_id", "sentence_seq"))

    @cached_property
    def rulesets(self) -> DataFrame:
        seq = F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category_seq")
        return self.topics.select("topic_id", seq).withColumn(
            "name", F.concat(F.lit("cat"), F.col("category_seq").cast("string"))
        )

    @cached_property
    def rules(self) -> DataFrame:
        return self.table("benchmark").select(
            (F.col("item_id") + 1).alias("rule_id"),
            (F.col("item_id") % 2 + 1).cast("int").alias("topic_id"),
            (F.col("item_id") % 5 + 1).cast("int").alias("category_seq"),
            F.get(tx.plain_sentences(F.col("text")), F.lit(0)).alias("full_text"),
        )

    @cached_property
    def rule_words(self) -> DataFrame:
        """The chosen words of each rule's example: its words 0, 2 and 4."""
        return self.rules.select(
            "rule_id", F.posexplode(tx.words(F.col("full_text"))).alias("word_seq", "word")
        ).filter(F.col("word_seq").isin(0, 2, 4))

    @cached_property
    def packed_rules(self) -> DataFrame:
        return pack_rules(self.rules, self.rule_words)

    @cached_property
    def watermark(self) -> DataFrame:
        """Marks of earlier runs; every fourth rule is new and has none."""
        item = F.col("rule_id") - 1
        return self.rules.filter(item % 4 != 3).select(
            "rule_id", (item % 3 * 100).cast("long").alias("last_post_id")
        )

    @cached_property
    def matches(self) -> DataFrame:
        return self.stored("matches", lambda: rule_matches(self.sentences, self.packed_rules))
