import pytest

from textrules.operators import alignment as al
from textrules.operators import exports as ex
from textrules.operators import topics as op
from textrules.operators import vocabulary as vo


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ["sun", "sea", "sand"] * 3 if i % 2 else ["code", "bug", "test"] * 3) for i in range(40)]
    return spark.createDataFrame([*rows, (40, [])], "doc_id long, words array<string>")


def test_dictionary_and_bags(spark, docs):
    terms = op.dictionary(docs)
    assert sorted(r.word_id for r in terms.collect()) == list(range(6))
    assert {r.docs for r in terms.collect()} == {20}
    assert op.dictionary(docs, max_share=0.2).count() == 0
    assert op.dictionary(docs, min_docs=21).count() == 0
    other = spark.createDataFrame([(1, ["sun", "sun", "new"]), (2, ["new"])], "doc_id long, words array<string>")
    bags = op.bag_of_words(other, terms, ["doc_id"])
    sun = {r.word: r.word_id for r in terms.collect()}["sun"]
    assert [tuple(r) for r in bags.collect()] == [(1, sun, 2)]
    packed = {r.doc_id: (r.terms, r.counts) for r in op.packed_bags(other, bags, ["doc_id"]).collect()}
    assert packed == {1: ([sun], [2]), 2: ([], [])}  # all words out of vocabulary


def test_argmax_keeps_ties_and_compares_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, 9e-05, 0.5]), (2, [9e-05, 0.1])], "id long, dist array<double>")
    assert sorted(tuple(r) for r in op.topic_argmax(df, ["id"]).collect()) == [(1, 0), (1, 2), (2, 1)]


def test_alignment(spark):
    stored = spark.createDataFrame(
        [(3, 0, "a b"), (3, 1, "[2020-01-02 03:04 :05] a b"), (7, 0, "c")],
        "post_id long, sentence_seq int, full_text string",
    )
    labelled = spark.createDataFrame(
        [("1", "L", "label"), ("2", "L", "sentence"), ("3", "L", "ab"), ("4", "L", "a b"),
         ("5", "M", "new one"), ("6", "M", None), ("7", "N", "c")],
        "row_key string, label string, sentence string",
    )
    labels = spark.createDataFrame([(1, "L"), (2, "M")], "label_id int, label string")
    training, index = al.training_set(labelled), al.key_index(stored)
    assert training.count() == 6  # what a sentence says never makes it a header
    found = sorted(tuple(r) for r in al.labels_found(training, index, labels).collect())
    assert found == [(3, 0, 3, 1, "L", 2), (3, 1, 3, 1, "L", 2)]
    new = [tuple(r) for r in al.labels_new(training, index, labels).collect()]
    assert sorted(r[3:] for r in new) == [(1, "L", "label"), (1, "L", "sentence"), (2, "M", "newone")]
    assert sorted(r[:3] for r in new) == [(8, 0, 3), (8, 1, 3), (8, 2, 3)]
    assert [tuple(r) for r in al.labels_unknown(training, labels).collect()] == [("N", 1)]
    apart = sorted(tuple(r) for r in al.labels_found(training, index, labels, limit=1).collect())
    assert apart == found


def test_one_table_per_label(spark):
    sheet = spark.createDataFrame([("label",), ("sentence",), ("a b",), ("a b",), (None,)], "sentence string")
    rows = al.labelled_rows({"L": sheet, "M": sheet.filter("sentence = 'a b'").limit(1)})
    assert rows.select("row_key").distinct().count() == rows.count() == 5
    training = al.training_set(rows)
    assert sorted((r.label, r.key) for r in training.collect()) == [
        ("L", "ab"), ("L", "ab"), ("L", "label"), ("L", "sentence"), ("M", "ab")
    ]


def test_exports(spark):
    posts = spark.createDataFrame([(1, 4), (2, 8), (3, 7)], "post_id long, source_id int")
    sentences = spark.createDataFrame(
        [(1, 0, ["x", "y", "x"]), (1, 1, ["z"]), (2, 0, ["x"]), (3, 0, ["y", "z"])],
        "post_id long, sentence_seq int, words array<string>",
    )
    vocab = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "word_id long, word string")
    ids = {"x": 1, "y": 2, "z": 3}
    relations = spark.createDataFrame(
        [(r.post_id, r.sentence_seq, i, ids[w]) for r in sentences.collect() for i, w in enumerate(r.words)],
        "post_id long, sentence_seq int, word_seq int, word_id long",
    )
    rules = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "rule_id long, category_seq int")
    matches = spark.createDataFrame(
        [(3, 1, 0), (1, 1, 0), (2, 1, 0), (1, 1, 1), (1, 2, 0)],
        "rule_id long, post_id long, sentence_seq int",
    )
    slice_ = dict(offset=0, limit=2)  # x and y
    labelled = ex.export_sentences_labeled(matches, rules, posts, sentences, relations, **slice_)
    # (1, 1) has no word of the slice, post 2 another source
    assert [tuple(r) for r in labelled.collect()] == [(1, 0, "5 5 6", "x y x")]
    rest = ex.export_sentences_unlabeled(matches, posts, sentences, relations, **slice_)
    assert [tuple(r) for r in rest.collect()] == [(3, 0, "y")]
    packed = vo.with_word_ids(sentences, relations)
    assert [tuple(r) for r in ex.export_sentences_labeled(matches, rules, posts, packed, **slice_).collect()] == [(1, 0, "5 5 6", "x y x")]
    assert [tuple(r) for r in ex.export_sentences_unlabeled(matches, posts, packed, **slice_).collect()] == [(3, 0, "y")]
    everything = ex.export_sentences_labeled(matches, rules, posts, packed)
    assert sorted(tuple(r) for r in everything.collect()) == sorted(
        tuple(r) for r in ex.export_sentences_labeled(matches, rules, posts, sentences, relations).collect()
    )
    words = {r.word: (r.tag, r["count"]) for r in ex.export_words(relations, vocab, **slice_).collect()}
    assert words == {"x": ("Alpha", 3), "y": ("Alpha", 2)}


def test_alignment_on_stored_keys(spark):
    common = [(p, s, "read on") for p in range(30) for s in range(40)]
    stored = spark.createDataFrame(
        [(3, 0, "a b"), (3, 1, "[2020-01-02 03:04 :05] a b"), (7, 0, "c"), *((100 + p, s, t) for p, s, t in common)],
        "post_id long, sentence_seq int, full_text string",
    )
    labelled = spark.createDataFrame(
        [("1", "L", "label"), ("2", "L", "sentence"), ("3", "L", "ab"), ("4", "L", "a b"), ("5", "M", "new one"),
         ("6", "M", None), ("7", "N", "c"), ("8", "M", "read on"), ("9", "M", "new one")],
        "row_key string, label string, sentence string",
    )
    labels = spark.createDataFrame([(1, "L"), (2, "M")], "label_id int, label string")
    training, keys = al.training_set(labelled), al.store_keys(stored)
    folded = al.store_training(training)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for limit in (1 << 20, 1):
        found = al.stored_labels_found(folded, keys, labels, limit)
        assert rows(found) == rows(al.labels_found(training, al.key_index(stored), labels)) and found.count() == 2 + 1200
    assert rows(al.stored_labels_new(folded, keys, labels)) == rows(al.labels_new(training, al.key_index(stored), labels))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # keys meet bucket by bucket: nothing is exchanged
        plan = folded.drop("row_keys").join(keys.keys.select("key", "key_id"), "key")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" not in folded.join(keys.keys.select("key"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    empty = al.store_keys(stored.filter("false"))
    assert empty.top == -1 and rows(al.stored_labels_found(folded, empty, labels)) == []
