import random

import pyarrow as pa

from textrules.functions import blocks
from textrules.operators import vocabulary as v
from textrules.operators.numbering import number_rows
from textrules.operators.skew import hot_keys, join_skewed


def test_upsert_keeps_known_ids(spark):
    vocab = spark.createDataFrame([(5, "b"), (9, "a")], "word_id long, word string")
    words = spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "word string")
    grown = {r.word: r.word_id for r in v.vocab_upsert(vocab, words).collect()}
    assert grown["b"] == 5 and grown["a"] == 9
    assert sorted((grown["c"], grown["d"])) == [10, 11]
    empty = spark.createDataFrame([], "word_id long, word string")
    assert sorted(r.word_id for r in v.vocab_upsert(empty, words).collect()) == [1, 2, 3]


def test_encoding_with_hot_and_unknown_words(spark):
    rng = random.Random(2)
    # "the" and the unknown "zzz" are hot, the others rare
    words = ["the"] * 2500 + ["zzz"] * 2500 + [f"w{i}" for i in range(3000)]
    rng.shuffle(words)
    rows = [(i, 0, 0, w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "post_id long, sentence_seq int, word_seq int, word string")
    vocab = spark.createDataFrame(
        [(1, "the")] + [(i + 2, f"w{i}") for i in range(2000)], "word_id long, word string"
    )
    ids = {r.word: r.word_id for r in vocab.collect()}
    for limit in (1 << 20, 0):  # one broadcast; salted
        found = v.encode_words(df, vocab, limit=limit).collect()
        got = sorted((r.post_id, r.word_id) for r in found)
        assert got == sorted((i, ids[w]) for i, w in enumerate(words) if w in ids)
    assert {r.word for r in hot_keys(df, "word").collect()} == {"the", "zzz"}


def test_blocks_ask_for_each_word_once():
    rows = pa.RecordBatch.from_pydict({"post_id": range(6), "word": ["a", "b", "a", "a", "b", "c"]})
    whole = list(blocks.packed("word")(iter([rows, rows])))
    assert [b["words"].to_pylist() for b in whole] == [[["a", "b", "c"]]]
    small = list(blocks.packed("word", words=6)(iter([rows, rows])))
    assert [b["words"].to_pylist() for b in small] == [[["a", "b", "c"]]] * 2


def test_lists_are_encoded_in_order(spark):
    words = [["b", "a", "b"], [], None, ["zzz", "a"], ["c"]]
    df = spark.createDataFrame(
        [(i, i % 2, w) for i, w in enumerate(words)] * 3, "post_id long, sentence_seq int, words array<string>"
    )
    vocab = spark.createDataFrame([(7, "a"), (8, "b"), (1 << 40, "c")], "word_id long, word string")
    ids = {r.word: r.word_id for r in vocab.collect()}
    found = v.encode_lists(df, vocab).collect()
    want = [(i, i % 2, w or [], [ids.get(x) for x in w or []]) for i, w in enumerate(words)] * 3
    assert sorted((r.post_id, r.sentence_seq, r.words, r.word_ids) for r in found) == sorted(want, key=lambda x: x[0])
    for limit in (1 << 20, 0):
        rows = v.encode_words(df, vocab, limit=limit)
        assert rows.columns == ["post_id", "sentence_seq", "word_seq", "word_id"]
        places = [(i, s, k, x) for i, s, _, l in want for k, x in enumerate(l) if x]
        assert sorted(tuple(r) for r in rows.collect()) == sorted(places)
    nobody = v.encode_lists(df, vocab.filter("word_id < 0")).collect()
    assert all(set(r.word_ids) <= {None} and len(r.word_ids) == len(r.words) for r in nobody)


def test_skewed_join_equals_plain_join(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, -1, id) as k")
    side = spark.sql("select * from values (-1L, 'x'), (-1L, 'y'), (4L, 'z'), (9999L, 'n') as t(k, label)")
    plain = sorted(tuple(r) for r in rows.join(side, "k").collect())
    assert sorted(tuple(r) for r in join_skewed(rows, side, "k").collect()) == plain
    assert len(plain) == 2 * 1667 + 1


def test_bitmaps_read_back(spark):
    rng = random.Random(8)
    postings = {(rng.randint(1, 5), rng.choice([0, 7, 8, 32767, 32768, rng.randint(0, 200000)]))
                for _ in range(3000)}
    df = spark.createDataFrame(sorted(postings), "word_id long, rnum long")
    bitmaps = v.posting_bitmaps(df)
    assert {tuple(r) for r in v.bitmap_positions(bitmaps).collect()} == postings
    lists = v.posting_lists(df).collect()
    assert {(r.word_id, n) for r in lists for n in r.rnums} == postings
    assert all(n // v.SEGMENT == r.segment for r in lists for n in r.rnums)


def test_packed_postings_equal_those_of_rows(spark):
    sentences = spark.createDataFrame(
        [(1, 0, ["x", "y", "x"]), (1, 1, []), (2, 0, ["z"]), (5, 3, ["y", "z", "y"])],
        "post_id long, sentence_seq int, words array<string>",
    )
    ids = {"x": 1, "y": 2, "z": 3}
    relations = spark.createDataFrame(
        [(r.post_id, r.sentence_seq, i, ids[w]) for r in sentences.collect() for i, w in enumerate(r.words)],
        "post_id long, sentence_seq int, word_seq int, word_id long",
    )
    packed = v.with_word_ids(sentences, relations)
    assert {(r.post_id, r.sentence_seq): r.word_ids for r in packed.collect()} == {
        (1, 0): [1, 2, 1], (1, 1): [], (2, 0): [3], (5, 3): [2, 3, 2]
    }
    numbers = number_rows(sentences.select("post_id", "sentence_seq"))
    rows = lambda df: sorted((r.word_id, r.segment, tuple(r.rnums)) for r in df.collect())
    want = rows(v.posting_lists(v.posting_rows(relations, numbers)))
    assert rows(v.posting_lists(v.packed_posting_rows(packed))) == want == [(1, 0, (0,)), (2, 0, (0, 3)), (3, 0, (2, 3))]


def test_packed_sentences_leave_the_text_behind(spark):
    from textrules.fixtures import Corpus

    packed = Corpus(spark, "/root/testdata/sf0.001").packed_sentences
    assert packed.columns == ["post_id", "sentence_seq", "words", "word_ids"]
