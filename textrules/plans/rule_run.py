"""One run of all rules over what is new to each of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.operators.incremental import NO_MARK, advance_marks, incremental_matches
from textrules.operators.matching import KEYS, max_post_id
from textrules.operators.posts import filter_posts, posts_page
from textrules.operators.reports import counts_by_post_ruleset, counts_by_rule, zero_filled
from textrules.operators.rules import pack_rules
from textrules.session import checked_broadcast, written


@dataclass
class RuleRun:
    new_matches: DataFrame
    marks: DataFrame


def run_rules(
    sentences: DataFrame, rules: DataFrame, marks: DataFrame, stored: DataFrame, until: int
) -> RuleRun:
    """Match, leave out what is stored, advance the marks. Write the matches before the marks:
    a run that dies in between is repeated and stores nothing twice.

    Only matches above their rule's mark can be found again, and those exist only after such
    a death. So what is compared is little, and the new matches, unique already, stay put. The
    lowest mark is a literal that reaches the scan of what is stored; matches of rules without a mark
    are looked for by their rules.
    """
    found = incremental_matches(sentences, rules, marks, until)
    again = checked_broadcast(written(above_marks(stored, rules, marks), "matches-again"))
    new = written(found.join(again, list(KEYS), "left_anti"), "new-matches")  # matched once
    return RuleRun(new, advance_marks(rules, marks, until))


def above_marks(stored: DataFrame, rules: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored matches in posts that their rules have not seen yet, by the marks."""
    mine = marks.join(rules.select("rule_id"), "rule_id", "left_semi")
    low = mine.agg(F.min("last_post_id").alias("low")).first()["low"]
    fresh = written(rules.select("rule_id").join(marks.select("rule_id"), "rule_id", "left_anti"), "rules-without-mark")
    found = []
    if low is not None:
        late = stored.filter(F.col("post_id") > low).join(checked_broadcast(mine), "rule_id")
        found.append(late.filter("post_id > last_post_id").select(*KEYS))
    if low is None or not fresh.isEmpty():
        found.append(stored.join(checked_broadcast(fresh), "rule_id", "left_semi").select(*KEYS))
    return reduce(DataFrame.unionByName, found)


def analyze(
    posts: DataFrame,
    sentences: DataFrame,
    rules: DataFrame,
    rule_words: DataFrame,
    marks: DataFrame,
    stored: DataFrame,
    topic_id: int,
    source_ids: Sequence[int],
    from_date: str | None = None,
    to_date: str | None = None,
    page: int = 1,
) -> tuple[RuleRun, DataFrame, DataFrame]:
    """Run every rule up to the newest post of the filter's topic and sources, then count.

    Returns the run, the counts per rule (0 for rules without a match) and the counts per
    post and category of one page.
    """
    until = max_post_id(posts, topic_id, source_ids).first()["max_post_id"]
    until = NO_MARK if until is None else until
    run = run_rules(sentences, pack_rules(rules, rule_words), marks, stored, until)
    matches = stored.select(*KEYS).unionByName(run.new_matches)
    mine = rules.filter(F.col("topic_id") == topic_id)
    shown = filter_posts(posts, topic_id, source_ids, from_date, to_date)
    counts = zero_filled(counts_by_rule(matches, mine, shown), run.marks, mine)
    on_page = F.broadcast(  # one page of posts
        posts_page(shown, page).select("post_id", F.lit(topic_id).alias("topic_id"))
    )
    of_page = matches.join(on_page.select("post_id"), "post_id", "left_semi")
    return run, counts, counts_by_post_ruleset(of_page, mine, on_page)
