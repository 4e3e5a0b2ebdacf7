"""The stream from files to counts: one batch after another, killed batches, rules that come and go."""

import pytest
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators import counts as cn
from textrules.operators.matching import rule_matches
from textrules.plans.ingest import post_sentences
from textrules.session import new_folder, written
from textrules.streaming.reports import StreamTables, stream_reports
from textrules.streaming.state import BUCKETS, BatchState, bucket_of

COLUMNS = "path string, topic string, source string, title string, url string, stamp string, text string"
BODIES = ["a b c. d e", "c b a", "f f. a x b", "e\nd. a b", "a b. a c b", "x y z"]


def row(i, **other):
    made = {
        "path": f"posts/s{i % 2}/f{i}.txt", "topic": f"t{i % 3}", "source": f"s{i % 2}", "title": f"title {i}", "url": None,
        "stamp": f"2024-02-{1 + i % 5:02d} 10:00:00", "text": BODIES[i % len(BODIES)],
    }
    return tuple((made | other).values())


BATCHES = [
    [row(i) for i in range(8)],
    [*(row(i) for i in range(8, 14)), row(14, title=" "), row(15, stamp="soon"), row(16, text="\n"), row(17, text=None)],
    [*(row(i) for i in range(18, 22)), row(2), row(3, path="posts/s1/copy/f3.txt")],  # two files seen before
]
RULES = [(1, 2, ["a", "b"]), (2, 3, ["d"]), (3, 0, ["f"]), (4, 2, ["c", "b"])]


@pytest.fixture(scope="module")
def arriving(spark):
    """A folder to which one file is added a batch, and the stream over it."""
    folder = new_folder(spark, "arriving")

    def add(rows):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(folder)

    return folder, add


def rules_of(spark, ids):
    return spark.createDataFrame([r for r in RULES if r[0] in ids], "rule_id long, gap int, words array<string>")


def run(spark, folder, path, marks, rules):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", "1").parquet(folder)
    stream_reports(stream, rules, path, marks, once=True).awaitTermination()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def contents(tables):
    """All that the batches stored, as far as it does not depend on the order in which rows lie."""
    named = {n: tables.table(n) for n in ("posts", "sentences", "words", "sentence_words", "topics", "sources", "quarantine")}
    named |= {"matches": tables.matches, "marks": tables.marks}
    named |= {"by_day": cn.folded(tables.counts.by_day, cn.DAY_KEYS), "by_post": cn.folded(tables.counts.by_post, cn.POST_KEYS)}
    return {n: rows(df) for n, df in named.items()}


def expected(tables, rules):
    """Matches and counts from scratch, over the posts and sentences that were stored."""
    matches = rule_matches(tables.table("sentences"), rules)
    counts = cn.deltas_of(matches, tables.table("posts"))
    return {
        "matches": rows(matches),
        "by_day": rows(counts.by_day.select(*cn.DAY_KEYS, "n")), "by_post": rows(counts.by_post.select(*cn.POST_KEYS, "n")),
    }


def test_batches_killed_batches_and_rules_that_come_and_go(spark, arriving):
    folder, add = arriving
    whole, broken = ([new_folder(spark, "out"), new_folder(spark, "state")] for _ in range(2))
    present = [{1, 2}, {1, 2, 3}, {1, 3, 4}]  # 3 is added, then 4 is added and 2 goes
    for batch in BATCHES:
        add(batch)

    def in_turn(calls, dies_at=None):
        def rules():
            calls.append(1)
            if len(calls) - 1 == dies_at:
                raise RuntimeError("executor gone")
            return rules_of(spark, present[len(calls) - 1])

        return rules

    run(spark, folder, *whole, in_turn([]))
    with pytest.raises(Exception, match="executor gone"):
        run(spark, folder, *broken, in_turn([], dies_at=1))  # after posts, words and files have been written
    run(spark, folder, *broken, in_turn([1]))
    tables = StreamTables(spark, whole[0])
    got = contents(tables)
    assert got == contents(StreamTables(spark, broken[0]))
    assert got.items() >= expected(tables, rules_of(spark, present[-1])).items()
    add([row(30)])
    now = rules_of(spark, {1, 2, 3, 4})  # 2 comes back: it sees everything again, once
    run(spark, folder, *whole, lambda: now)
    got = contents(tables)
    assert got.items() >= expected(tables, now).items()
    assert got["quarantine"] == [
        ("posts/s0/f14.txt", "no title"), ("posts/s0/f16.txt", "no text"), ("posts/s1/f15.txt", "no time"), ("posts/s1/f17.txt", "no text")
    ]
    assert len(got["posts"]) == 8 + 6 + 4 + 1 and [p[0] for p in sorted(got["posts"])] == list(range(19))
    ids = [r[0] for r in got["words"]]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and len({r[1] for r in got["words"]}) == len(ids)
    assert {r[1] for r in got["topics"]} == {"t0", "t1", "t2"} and {r[1] for r in got["sources"]} == {"s0", "s1"}
    assert got["marks"] == [(k, 18) for k in (1, 2, 3, 4)]
    sentences = post_sentences(tables.table("posts").join(
        spark.createDataFrame([r for b in [*BATCHES, [row(30)]] for r in b], COLUMNS).select("path", "text").dropDuplicates(["path"]), "path"
    ))
    assert rows(sentences.select("post_id", "sentence_seq", "full_text")) == rows(tables.table("sentences").select("post_id", "sentence_seq", "full_text"))


def test_a_batch_reads_its_own_buckets(spark):
    path = new_folder(spark, "keyed")
    words = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("word_id"))
    first = BatchState(spark, path, 0, ("words",))
    assert first.last == {"words": 0}
    first.put(words.withColumn("bucket", bucket_of("word")), "words")
    first.commit(words=5000)
    second = BatchState(spark, path, 1, ("words",))
    assert second.last == {"words": 5000}
    keys = written(spark.createDataFrame([("w7",), ("w11",), ("new",)], "word string").select("word", bucket_of("word")), "keys")
    found = second.earlier_of_keys("words", words.schema, keys, "word")
    assert sorted(tuple(r) for r in found.collect()) == [("w11", 11), ("w7", 7)]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(bucket, [" in plan and "batch_id" in plan.split("PartitionFilters: [")[1][:80]
    assert 3 <= BUCKETS // 2
    second.put(words.limit(3).withColumn("bucket", bucket_of("word")), "words")  # a half-written try of its own
    assert second.earlier("words", words.schema).count() == 5000


def test_tagged_words_are_ingested(spark):
    posts = spark.createDataFrame([(1, "Hello #tag 42. bye")], "post_id long, text string")
    found = post_sentences(posts, tx.tagged_words).orderBy("sentence_seq").collect()
    assert [r.words for r in found] == [["Hello_Alpha", "#tag_Hashtag", "42_Number", "._Punctuation"], ["bye_Alpha"]]


def test_counts_after_every_step(spark):
    posts = spark.createDataFrame(
        [(p, 1 + p % 2, p % 3, None if p == 7 else f"2024-03-{1 + p % 4:02d} 05:00:00") for p in range(12)],
        "post_id long, topic_id int, source_id int, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    matches = spark.createDataFrame(
        [(1 + (p * s) % 5, p, s) for p in range(12) for s in range(4)], "rule_id long, post_id long, sentence_seq int"
    )
    rules = spark.createDataFrame([(k, 1 + k % 2, k % 3) for k in range(1, 7)], "rule_id long, topic_id int, category_seq int")

    def fresh(kept, left):
        return {
            "by_rule": rows(cn.counts_by_rule(kept, rules, 1, [0, 2], "2024-03-02", "2024-03-03")),
            "by_post": rows(cn.counts_by_post_ruleset(kept, rules, posts)),
        }, {
            "by_rule": rows(cn.counts_by_rule(cn.deltas_of(left, posts), rules, 1, [0, 2], "2024-03-02", "2024-03-03")),
            "by_post": rows(cn.counts_by_post_ruleset(cn.deltas_of(left, posts), rules, posts)),
        }

    kept = cn.no_counts(spark)
    for low, high in ((-1, 4), (4, 11)):
        kept = kept.plus(cn.deltas_of(matches.filter((F.col("post_id") > low) & (F.col("post_id") <= high)), posts))
    assert fresh(kept, matches)[0] == fresh(kept, matches)[1]
    gone = rules.filter("category_seq = 1 and topic_id = 1")
    kept = kept.plus(cn.deltas_without_rules(kept, gone))
    left = matches.join(gone, "rule_id", "left_anti")
    assert fresh(kept, left)[0] == fresh(kept, left)[1] and left.count() < matches.count()
    kept = cn.compacted(kept.plus(cn.deltas_without_source(kept, posts, 1, 2)))
    left = left.join(posts.filter("topic_id = 1 and source_id = 2"), "post_id", "left_anti")
    assert fresh(kept, left)[0] == fresh(kept, left)[1]
    assert rows(kept.by_post.groupBy("post_id").agg(F.sum("n"))) == rows(left.groupBy("post_id").count())
    again = kept.plus(cn.deltas_of(left, posts)).plus(cn.deltas_without_rules(kept, rules))
    assert rows(cn.folded(again.by_day, cn.DAY_KEYS)) == rows(cn.folded(kept.by_day, cn.DAY_KEYS))
