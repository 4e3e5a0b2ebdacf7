"""Matching very many rules at once, over a trie of their first words.

Rules that begin alike share the work for what they have in common. The test of a rule goes through
its words in order and its state depends on the words met so far alone: where the last of them
was met. So a node of the trie, that is some first words and (from the second word on) a gap, is
tested once a sentence for all rules below it. Levels are joins: the sentences that reach a node go
on to the children whose word they hold further on, so work grows with the beginnings that do
occur, not with rules times sentences. Rules longer than the trie is deep test the rest on their
own.

Nodes and rules are broadcast, in several parts when they are measured to be too large for one;
no sentence moves. While each is one part, all levels are one pass over the sentences: where rules end
at a node, a row without a word further on goes along beside those that go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions.matching import next_place, rest_matches
from textrules.operators.matching import KEYS
from textrules.operators.numbering import number_words
from textrules.session import BROADCAST_BYTES, broadcast_parts, fits_broadcast, written

#: Words of a rule that the trie holds.
DEPTH = 3


@dataclass(frozen=True)
class RuleTrie:
    """``edges``: depth, parent, word, child, gap; ``ends``: node, depth, rule_id, gap, words."""

    edges: DataFrame
    ends: DataFrame
    depth: int


def _node(words: Column, gap: Column, depth: int) -> Column:
    """A node by its words; from the second on the gap tells nodes apart, before that nothing is measured."""
    own = F.array_join(F.transform(F.slice(words, 1, depth), lambda w: F.concat(F.length(w), F.lit(":"), w)), "")
    return own if depth == 1 else F.concat(gap.cast("string"), F.lit("|"), own)


def rule_trie(rules: DataFrame, depth: int = DEPTH) -> RuleTrie:
    """The trie of rules (rule_id, gap, words); rules without words match nothing and are left out."""
    rules = rules.filter(F.size("words") > 0).select("rule_id", "gap", "words")
    steps = []
    for d in range(1, depth + 1):
        here = rules.filter(F.size("words") >= d)
        parent = F.lit("") if d == 1 else _node(F.col("words"), F.col("gap"), d - 1)
        gap = F.lit(0) if d == 1 else F.col("gap")
        steps.append(here.select(
            F.lit(d).alias("depth"), parent.alias("_parent"), F.get("words", F.lit(d - 1)).alias("word"),
            _node(F.col("words"), F.col("gap"), d).alias("_child"), gap.cast("int").alias("gap"),
        ).distinct())
    steps = written(reduce(DataFrame.unionByName, steps), "trie-steps")
    # Names are unique over all depths: each tells its number of words by their lengths.
    ids = written(number_words(steps.select(F.col("_child").alias("word")).distinct()), "trie-nodes")
    child = ids.select(F.col("word").alias("_child"), F.col("word_id").alias("child"))
    up = ids.select(F.col("word").alias("_parent"), F.col("word_id").alias("parent"))
    edges = steps.join(child, "_child").join(up, "_parent", "left").select(
        "depth", F.coalesce("parent", F.lit(0)).alias("parent"), "word", "child", "gap"
    )
    last = F.least(F.size("words"), F.lit(depth))
    named = F.lit(None).cast("string")
    for d in range(1, depth + 1):
        named = F.when(last == d, _node(F.col("words"), F.col("gap"), d)).otherwise(named)
    ends = rules.withColumn("_child", named).withColumn("depth", last).join(child, "_child").select(
        F.col("child").alias("node"), "depth", "rule_id", "gap", "words"
    )
    return RuleTrie(written(edges, "trie-edges"), written(ends, "trie-ends"), depth)


def _joined(rows: DataFrame, side: DataFrame, on: list[str], key: str, limit: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.join(part, on) for part in broadcast_parts(side, key, limit)])


def _in_one_pass(sentences: DataFrame, trie: RuleTrie, sides: list[DataFrame]) -> DataFrame:
    """``trie_matches`` where the edges of each level (``sides``) and all ends fit a broadcast."""
    stops = trie.ends.select(F.col("node").alias("child")).distinct().withColumn("stop", F.lit(True))
    sides = [F.broadcast(side.join(stops, "child", "left")) for side in sides]  # no larger than what was measured, but for a flag
    words = F.col("words")
    held = sentences.select("post_id", "sentence_seq", "words", F.explode(F.array_distinct("words")).alias("word"))
    here = held.join(sides[0].select("word", "child", "stop"), "word").select(
        "post_id", "sentence_seq", "words", F.col("child").alias("node"), "word",
        (F.array_position("words", F.col("word")) - 1).cast("int").alias("at"), "stop",
    )
    for side in sides[1:]:
        # Of a sentence, only the words after the place can be next; a row that has ended has none.
        later = F.array_compact(F.array_distinct(F.slice("words", F.col("at") + 2, F.size("words"))))
        none = F.array().cast("array<string>")
        ended = F.when(F.col("stop"), F.array(F.lit(None).cast("string"))).otherwise(none)
        ahead = here.select(
            "post_id", "sentence_seq", "words", F.col("node").alias("parent"), F.col("word").alias("own"), "at",
            F.explode(F.concat(ended, F.when(F.col("word").isNull(), none).otherwise(later))).alias("word"),
        )
        reached = ahead.join(side, ["parent", "word"], "left").filter("word is null or child is not null")
        place = next_place(words, F.col("at"), F.col("own"), F.col("word"), F.col("gap"))
        here = reached.select(
            "post_id", "sentence_seq", "words", F.coalesce("child", "parent").alias("node"), "word",
            F.when(F.col("word").isNull(), F.col("at")).otherwise(place).alias("at"),
            (F.col("word").isNull() | F.col("stop")).alias("stop"),
        ).filter("at is not null")
    ends = trie.ends.select("node", "rule_id", "gap", F.col("words").alias("rule_words"))
    rest = rest_matches(words, F.col("rule_words"), F.col("gap"), trie.depth, F.col("at"))
    done = here.filter("stop").join(F.broadcast(ends), "node").filter((F.size("rule_words") <= trie.depth) | rest)
    return done.select(*KEYS)


def trie_matches(sentences: DataFrame, trie: RuleTrie, limit: int = BROADCAST_BYTES // 2) -> DataFrame:
    """(rule_id, post_id, sentence_seq) of every match, as ``matching.rule_matches`` gives them."""
    edges = lambda d: trie.edges.filter(F.col("depth") == d).select("parent", "word", "child", "gap")
    words = F.col("words")
    sides = [edges(d) for d in range(1, trie.depth + 1)]
    if all(fits_broadcast(side, limit) for side in [*sides, trie.ends.drop("depth")]):
        return _in_one_pass(sentences, trie, sides)
    held = sentences.select("post_id", "sentence_seq", "words", F.explode(F.array_distinct("words")).alias("word"))
    first = _joined(held, edges(1).select("word", "child"), ["word"], "child", limit)
    here = first.select(
        "post_id", "sentence_seq", "words", F.col("child").alias("node"), "word",
        (F.array_position("words", F.col("word")) - 1).cast("int").alias("at"),
    )
    found = []
    for d in range(1, trie.depth + 1):
        ends = trie.ends.filter(F.col("depth") == d).select("node", "rule_id", "gap", F.col("words").alias("rule_words"))
        if d < trie.depth:  # all words of these rules have been met
            done = _joined(here, ends.select("node", "rule_id"), ["node"], "rule_id", limit)
        else:
            done = _joined(here, ends, ["node"], "rule_id", limit).filter(
                (F.size("rule_words") == d) | rest_matches(words, F.col("rule_words"), F.col("gap"), d, F.col("at"))
            )
        found.append(done.select(*KEYS))
        if d == trie.depth:
            break
        # Of a sentence, only the words after the place can be next.
        later = F.array_distinct(F.slice("words", F.col("at") + 2, F.size("words")))
        ahead = here.select(
            "post_id", "sentence_seq", "words", F.col("node").alias("parent"), F.col("word").alias("own"), "at",
            F.explode(later).alias("word"),
        )
        reached = _joined(ahead, edges(d + 1), ["parent", "word"], "child", limit)
        place = next_place(words, F.col("at"), F.col("own"), F.col("word"), F.col("gap"))
        here = reached.select(
            "post_id", "sentence_seq", "words", F.col("child").alias("node"), "word", place.alias("at")
        ).filter("at is not null")
    return reduce(DataFrame.unionByName, found)
