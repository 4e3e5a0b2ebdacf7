import random

import pytest

from textrules.operators.incremental import advance_marks, append_new, incremental_matches
from textrules.operators.matching import rule_matches
from textrules.operators.sentences import sentence_rows, with_words
from textrules.plans.ingest import give_post_ids, ingest, post_sentences
from textrules.plans.rule_run import run_rules
from textrules.schemas import TABLES
from textrules.session import new_folder, written
from textrules.sources.text_files import article_posts, read_text_files, stream_text_files
from textrules.streaming import jobs


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(6)
    rows = [
        (i, ". ".join(" ".join(rng.choice("abcdef") for _ in range(6)) for _ in range(4)))
        for i in range(1, 61)
    ]
    return spark.createDataFrame(rows, "post_id long, text string")


@pytest.fixture(scope="module")
def sentences(posts):
    return with_words(sentence_rows(posts)).cache()


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(
        [(1, 2, ["a", "b"]), (2, 4, ["c", "d", "e"]), (3, 0, ["f"])],
        "rule_id long, gap int, words array<string>",
    )


def keys(df):
    return sorted(tuple(r) for r in df.collect())


def test_slices_equal_one_run(spark, sentences, rules):
    stored = spark.createDataFrame([], TABLES["matches"])
    marks = spark.createDataFrame([], TABLES["rule_watermark"])
    for until in (7, 7, 30, 60):
        known = rules if until > 7 else rules.filter("rule_id <> 3")  # rule 3 comes later
        run = run_rules(sentences, known, marks, stored, until)
        stored = written(stored.unionByName(run.new_matches), "stored")
        marks = written(run.marks, "marks")
    assert keys(stored) == keys(rule_matches(sentences, rules))
    assert dict(marks.collect()) == {1: 60, 2: 60, 3: 60}


def test_parity_never_sees_the_last_post(spark, sentences, rules):
    marks = spark.createDataFrame([(1, 50), (2, 60)], TABLES["rule_watermark"])
    strict = incremental_matches(sentences, rules, marks, 60, parity=True)
    full = incremental_matches(sentences, rules, marks, 60)
    everything = keys(rule_matches(sentences, rules))
    low = {1: 50, 2: 60, 3: 0}
    assert keys(full) == [k for k in everything if k[1] > low[k[0]]]
    assert keys(strict) == [k for k in everything if low[k[0]] < k[1] < 60]


def test_marks_never_go_back(spark, rules):
    marks = spark.createDataFrame([(1, 80), (2, 5)], TABLES["rule_watermark"])
    assert dict(advance_marks(rules, marks, 60).collect()) == {1: 80, 2: 60, 3: 60}


def test_appending_twice_changes_nothing(spark, sentences, rules):
    found = rule_matches(sentences, rules)
    once = append_new(spark.createDataFrame([], TABLES["matches"]), found.unionByName(found))
    assert keys(append_new(once, found)) == keys(found)


def test_scan_is_bounded_by_the_lowest_mark(spark, sentences, rules):
    stored = written(sentences, "sentences")
    marks = spark.createDataFrame([(1, 50), (2, 55), (3, 52)], TABLES["rule_watermark"])
    plan = incremental_matches(stored, rules, marks, 60)._jdf.queryExecution().toString()
    assert "GreaterThan(post_id,50)" in plan and "LessThanOrEqual(post_id,60)" in plan


def test_stream_equals_batch(spark, posts, rules):
    source, path, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    posts.repartition(3).write.parquet(source)

    def run():
        stream = (
            spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", "1").parquet(source)
        )
        jobs.stream_rule_matches(stream, lambda: rules, path, state, once=True).awaitTermination()
        return keys(jobs.streamed(spark, path))

    assert run() == keys(rule_matches(post_sentences(posts), rules))  # numbered as the ingest does
    more = spark.createDataFrame([(99, "f. a b")], posts.schema)
    more.write.mode("append").parquet(source)
    assert [k for k in run() if k[1] == 99] == [(1, 99, 1), (3, 99, 0)]


def test_streamed_files_equal_one_ingest(spark, tmp_path):
    for i in range(5):
        text = f"title {i}\nhttp://u/{i}\nfirst word{i}. second ㅋㅋ common\n"
        (tmp_path / f"2016-04-09_{i}.txt").write_text(text, encoding="utf-8")
    path, state = new_folder(spark, "ingest"), new_folder(spark, "state")
    stream = article_posts(stream_text_files(spark, str(tmp_path), files_per_batch=2))
    jobs.stream_ingest_files(stream, path, state, once=True).awaitTermination()

    def spoken(posts, words, relations):
        joined = relations.join(words, "word_id").join(posts.select("post_id", "path"), "post_id")
        return sorted(
            tuple(r) for r in joined.select("path", "sentence_seq", "word_seq", "word").collect()
        )

    tables = {n: jobs.streamed(spark, f"{path}/{n}") for n in ("posts", "words", "sentence_words")}
    batch = give_post_ids(article_posts(read_text_files(spark, str(tmp_path))))
    once = ingest(batch, spark.createDataFrame([], TABLES["words"]))
    streamed = spoken(tables["posts"], tables["words"], tables["sentence_words"])
    assert streamed == spoken(once.posts, once.new_words, once.sentence_words)
    assert sorted(r.post_id for r in tables["posts"].collect()) == list(range(5))
    ids = [r.word_id for r in tables["words"].collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_new_rules_see_post_0(spark):
    sentences = spark.createDataFrame(
        [(p, 0, ["a", "b"]) for p in range(4)], "post_id long, sentence_seq int, words array<string>"
    )
    rules = spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["b"]), (3, 1, ["a", "b"])], "rule_id long, gap int, words array<string>")
    marks = spark.createDataFrame([(2, 0), (3, 2)], "rule_id long, last_post_id long")
    found = incremental_matches(sentences, rules, marks, 3).collect()
    assert sorted((r.rule_id, r.post_id) for r in found) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3)]
    run = run_rules(sentences, rules, marks, spark.createDataFrame([], "rule_id long, post_id long, sentence_seq int"), 3)
    assert run.new_matches.count() == 8


def test_stored_matches_are_read_above_the_lowest_mark(spark, sentences, rules):
    from textrules.plans.rule_run import above_marks

    stored = written(rule_matches(sentences, rules), "stored")
    marks = spark.createDataFrame([(1, 50), (2, 55), (9, 1)], TABLES["rule_watermark"])
    found = above_marks(stored, rules.filter("rule_id < 3"), marks)
    assert "GreaterThan(post_id,50)" in found._jdf.queryExecution().toString()
    assert keys(found) == [k for k in keys(stored) if k[1] > {1: 50, 2: 55, 3: 99}[k[0]]]
    everything = above_marks(stored, rules, marks)  # rule 3 has no mark
    assert keys(everything) == [k for k in keys(stored) if k[1] > {1: 50, 2: 55, 3: -1}[k[0]]]
    assert keys(above_marks(stored, rules, marks.filter("false"))) == keys(stored)


def test_runs_are_matched_once_for_both_counts(spark, monkeypatch):
    from textrules.catalog.incremental import kept_counts
    from textrules.fixtures import Corpus
    from textrules.operators import incremental

    calls, real = [], incremental.incremental_matches
    monkeypatch.setattr(incremental, "incremental_matches", lambda *a: calls.append(1) or real(*a))
    # a folder under a name of its own: nothing of it is stored yet
    kept_counts(Corpus(spark, "/root/testdata/sf0.001/."))
    assert len(calls) == 1
