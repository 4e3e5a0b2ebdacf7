import random

import pytest

from textrules.operators.matching import rule_matches
from textrules.operators.rule_trie import rule_trie, trie_matches


def made(spark, rng, letters, n_rules, n_sentences, most=6):
    rules = [(k, rng.randrange(6), rng.choices(letters, k=rng.randrange(most + 1))) for k in range(n_rules)]
    sentences = [(k // 5, k % 5, rng.choices(letters, k=rng.randrange(16))) for k in range(n_sentences)]
    return (
        spark.createDataFrame(rules, "rule_id long, gap int, words array<string>"),
        spark.createDataFrame(sentences, "post_id long, sentence_seq int, words array<string>"),
    )


def keys(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("depth", "limit"), [(3, 1 << 25), (2, 2000), (1, 1 << 25)])
def test_trie_equals_rule_by_rule(spark, depth, limit):
    rules, sentences = made(spark, random.Random(depth), "aabbcdefg", 300, 400)
    got = keys(trie_matches(sentences, rule_trie(rules, depth), limit))
    want = keys(rule_matches(sentences, rules.filter("size(words) > 0")))
    assert got == want and len(set(got)) == len(got) > 1000


def test_words_with_separators_and_equal_rules(spark):
    rules = spark.createDataFrame(
        [(1, 3, ["a|b", "c"]), (2, 3, ["a", "b|c"]), (3, 3, ["a|b", "c"]), (4, 0, ["1:a"]), (5, 9, ["a"]), (6, 2, ["a"]), (7, 1, [])],
        "rule_id long, gap int, words array<string>",
    )
    sentences = spark.createDataFrame(
        [(1, 0, ["a|b", "c"]), (2, 0, ["a", "x", "b|c"]), (3, 0, ["1:a"]), (4, 0, []), (5, 0, None)],
        "post_id long, sentence_seq int, words array<string>",
    )
    assert keys(trie_matches(sentences, rule_trie(rules))) == [(1, 1, 0), (2, 2, 0), (3, 1, 0), (4, 3, 0), (5, 2, 0), (6, 2, 0)]
    assert keys(trie_matches(sentences, rule_trie(rules.filter("false")))) == []


def test_rules_that_begin_alike_share_their_nodes(spark):
    rules = spark.createDataFrame(
        [(k, 4, ["the", "same", f"w{k}", "x"]) for k in range(500)], "rule_id long, gap int, words array<string>"
    )
    trie = rule_trie(rules)
    assert trie.edges.count() == 1 + 1 + 500 and trie.ends.count() == 500
    # work: the pairs that reach the last level are those whose three first words are there
    sentences = spark.createDataFrame(
        [(p, 0, ["the", "same", f"w{p}", "x" if p % 2 else "y"]) for p in range(50)], "post_id long, sentence_seq int, words array<string>"
    )
    assert keys(trie_matches(sentences, trie)) == [(p, p, 0) for p in range(1, 50, 2)]
    plan = trie_matches(sentences, trie)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_all_levels_are_one_pass_over_the_sentences(spark):
    """Rules that end at every level, on the way to longer ones, and words that are null."""
    rules = spark.createDataFrame(
        [(1, 9, ["a"]), (2, 9, ["a", "b"]), (3, 9, ["a", "b", "c"]), (4, 9, ["a", "b", "c", "d"]), (5, 0, ["a", "b"]), (6, 9, ["b", "d"])],
        "rule_id long, gap int, words array<string>",
    )
    sentences = spark.createDataFrame(
        [(1, 0, ["a", None, "b", "c", "d"]), (2, 0, ["a", None, None]), (3, 0, [None, "b", "a", "b"]), (4, 0, [None])],
        "post_id long, sentence_seq int, words array<string>",
    )
    found = trie_matches(sentences, rule_trie(rules))
    want = keys(rule_matches(sentences, rules))
    assert keys(found) == want and {r for r, *_ in want} >= {1, 2, 3, 4, 6}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [post_id") == 1
