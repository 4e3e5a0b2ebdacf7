import random

import pytest

from textrules.operators.numbering import number_rows, number_words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = {(rng.choice("xy"), rng.choice([7, 7, 7, rng.randint(0, 500)]), rng.randint(0, 900))
            for _ in range(2000)}
    return sorted(keys)


@pytest.mark.parametrize(("lead_bits", "tail_block"), [(4, 10), (14, 1 << 16)])
def test_numbers_are_dense_and_ordered(spark, rows, lead_bits, tail_block):
    pairs = sorted({(lead, tail) for _, lead, tail in rows})
    df = spark.createDataFrame(random.Random(1).sample(pairs, len(pairs)), "post_id long, sentence_seq int")
    got = number_rows(df, start=1, lead_bits=lead_bits, tail_block=tail_block).collect()
    assert [(r.post_id, r.sentence_seq) for r in sorted(got, key=lambda r: r.rnum)] == pairs
    assert sorted(r.rnum for r in got) == list(range(1, len(pairs) + 1))


def test_numbers_start_again_in_every_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, post_id long, sentence_seq int")
    got = number_rows(df, by=["g"], lead_bits=4, tail_block=10).collect()
    for group in "xy":
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.rnum)
        assert [(r.post_id, r.sentence_seq) for r in mine] == [k[1:] for k in rows if k[0] == group]
        assert [r.rnum for r in mine] == list(range(len(mine)))


def test_word_numbers_are_dense_and_stable(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    first = {r.word: r.word_id for r in number_words(df).collect()}
    again = {r.word: r.word_id for r in number_words(df.repartition(7)).collect()}
    assert sorted(first.values()) == list(range(1, 3001))
    assert first == again


def test_sparse_and_negative_leads(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.choice([1, -1]) * rng.getrandbits(rng.choice([3, 20, 40, 62])), rng.randint(0, 5)) for _ in range(3000)})
    df = spark.createDataFrame(rng.sample(pairs, len(pairs)), "post_id long, sentence_seq int")
    got = sorted((r.rnum, r.post_id, r.sentence_seq) for r in number_rows(df).collect())
    assert [g[1:] for g in got] == pairs and [g[0] for g in got] == list(range(len(pairs)))
