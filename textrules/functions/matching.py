"""The ordered, gap-bounded word test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds_all(words: Column, rule_words: Column) -> Column:
    """Every rule word occurs somewhere: cheap, and implied by a match."""
    return F.forall(rule_words, lambda w: F.array_contains(words, w))


def _state(done: Column, last: Column) -> Column:
    return F.struct(done.cast("int").alias("done"), last.cast("int").alias("last"))


def _step(words: Column, rule_words: Column, gap: Column):
    def step(s: Column, here: Column) -> Column:
        # out of range, get() gives null and no case applies
        word, done, last = F.get(words, here), s["done"], s["last"]
        near = (done == 0) | (here - last <= gap)
        return (
            F.when((word == F.get(rule_words, done)) & near, _state(done + 1, here))
            .when(word == F.get(rule_words, done - 1), _state(done, here))
            .otherwise(s)
        )

    return step


def ordered_gap_match(words: Column, rule_words: Column, gap: Column) -> Column:
    """Do the rule's words occur in order, each at most ``gap`` after the one before?

    One pass over the positions of the sentence. ``done`` counts rule words met so far,
    ``last`` is the position the next one is measured from. The latest met word occurring
    again moves ``last`` forward, however far away it is. Positions of other words leave the
    state as it is, so the pass is over those of the rule's words.
    """
    positions = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1), lambda here: F.array_contains(rule_words, F.get(words, here))
    )
    return F.aggregate(
        positions, _state(F.lit(0), F.lit(-1)), _step(words, rule_words, gap), lambda s: s["done"] == F.size(rule_words)
    )


def _after(words: Column, at: Column) -> Column:
    """The positions after ``at``; none after the last one."""
    return F.when(at + 1 < F.size(words), F.sequence(at + 1, F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def rest_matches(words: Column, rule_words: Column, gap: Column, done: int, at: Column) -> Column:
    """The same test taken up where the first ``done`` words of the rule have been met, the last of them at ``at``."""
    return F.aggregate(
        _after(words, at), _state(F.lit(done), at), _step(words, rule_words, gap), lambda s: s["done"] == F.size(rule_words)
    )


def next_place(words: Column, at: Column, own: Column, following: Column, gap: Column) -> Column:
    """Where the test meets the word ``following`` once it has met ``own`` at ``at``; null if nowhere."""
    step = _step(words, F.array(own, following), gap)
    return F.aggregate(
        _after(words, at), _state(F.lit(1), at),
        lambda s, here: F.when(s["done"] == 2, s).otherwise(step(s, here)),  # the first such place
        lambda s: F.when(s["done"] == 2, s["last"]),
    )
