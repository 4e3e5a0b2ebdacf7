import random

import pytest
from pyspark.sql import functions as F

from textrules.functions.matching import ordered_gap_match
from textrules.operators.matching import match_candidates, rule_matches


def by_hand(rule, gap, sentence):
    """The rule's words one after the other, by plain search for the next word."""
    met, place = 0, None
    for here, word in enumerate(sentence):
        if met == len(rule):
            break
        in_reach = met == 0 or here - place <= gap
        if word == rule[met] and in_reach:
            met, place = met + 1, here
        elif met and word == rule[met - 1]:
            place = here
    return met == len(rule)


def test_fold_equals_plain_search(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        rule = [rng.choice("abcd") for _ in range(rng.randint(1, 4))]
        rows.append((i, words, rule, rng.randint(0, 5)))
    df = spark.createDataFrame(rows, "i int, words array<string>, rule array<string>, gap int")
    got = dict(
        df.select("i", ordered_gap_match(F.col("words"), F.col("rule"), F.col("gap"))).collect()
    )
    assert got == {i: by_hand(rule, gap, words) for i, words, rule, gap in rows}
    assert 300 < sum(got.values()) < 2700


@pytest.mark.parametrize(
    ("rule", "gap", "sentence", "expected"),
    [
        (["a"], 0, ["x", "a"], True),  # one-word rule
        (["a", "a"], 1, ["a", "a"], True),  # repeated word
        (["a", "a"], 1, ["a"], False),
        (["a", "a"], 1, ["a", "x", "x", "a", "a"], True),  # too far, then measured anew
        (["a", "b"], 1, ["a", "x", "x", "a", "b"], True),  # the first word again, beyond the gap
        (["a", "b"], 1, ["a", "x", "b"], False),
        (["a", "b"], 5, ["b", "a"], False),  # wrong order
        (["a", "b", "c"], 2, ["a", "b", "a", "c"], True),
        (["a"], 0, [], False),
    ],
)
def test_edges(spark, rule, gap, sentence, expected):
    df = spark.createDataFrame(
        [(rule, gap, sentence)], "rule array<string>, gap int, words array<string>"
    )
    found = df.select(ordered_gap_match(F.col("words"), F.col("rule"), F.col("gap"))).first()[0]
    assert found is expected


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    words = ["the"] * 8 + list("abcdefg")
    sentences = [
        (post, seq, [rng.choice(words) for _ in range(rng.randint(0, 15))])
        for post in range(60)
        for seq in range(5)
    ]
    rules = [
        (i, rng.randint(0, 6), [rng.choice(words) for _ in range(rng.randint(1, 3))])
        for i in range(25)
    ]
    return (
        sentences,
        rules,
        spark.createDataFrame(sentences, "post_id long, sentence_seq int, words array<string>"),
        spark.createDataFrame(rules, "rule_id long, gap int, words array<string>"),
    )


# A limit of a few bytes makes the rules go out in several broadcasts.
@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_rule_matches(small, limit):
    sentences, rules, s, r = small
    got = [tuple(x) for x in rule_matches(s, r, limit=limit).collect()]
    expected = {
        (rule_id, post, seq)
        for rule_id, gap, rule in rules
        for post, seq, words in sentences
        if by_hand(rule, gap, words)
    }
    assert len(got) == len(set(got))
    assert set(got) == expected


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_match_candidates(small, limit):
    sentences, rules, s, r = small
    got = {
        (x.rule_id, x.post_id, x.sentence_seq): (x.word_seqs, x.hit_words)
        for x in match_candidates(s, r, limit=limit).collect()
    }
    expected = {}
    for rule_id, _, rule in rules:
        for post, seq, words in sentences:
            hits = [(p, w) for p, w in enumerate(words) if w in rule]
            if len(hits) >= len(rule):
                expected[rule_id, post, seq] = ([p for p, _ in hits], [w for _, w in hits])
    assert got == expected


def test_no_rules_no_matches(small, spark):
    _, _, s, r = small
    assert rule_matches(s, r.filter("false")).count() == 0


def test_word_tests_are_no_condition_of_the_join(spark):
    """As a condition they would be run row by row, on a copy of the sentence for each of its words."""
    sentences = spark.createDataFrame(
        [(1, 0, ["a", "x", "b"]), (1, 1, ["b", "a"]), (2, 0, ["x", "c"]), (2, 1, None)], "post_id long, sentence_seq int, words array<string>"
    )
    rules = spark.createDataFrame([(1, 2, ["a", "b"]), (2, 0, ["c"]), (3, 1, ["a", "b"])], "rule_id long, gap int, words array<string>")
    found = rule_matches(sentences, rules, sentences)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("lambdafunction" in line for line in joins)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0), (2, 2, 0)}
