"""Everything the start page shows, from one filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.operators import posts as p
from textrules.operators import reports as r
from textrules.operators.rules import drop_stale_marks, pack_rules


@dataclass
class Dashboard:
    posts_count: DataFrame
    posts: DataFrame
    rulesets: DataFrame
    rules: DataFrame
    rule_counts: DataFrame
    post_counts: DataFrame

    def as_rows(self) -> DataFrame:
        """All parts in one long table, empty columns null."""
        shapes = [
            ("posts_count", self.posts_count, {"count": F.col("posts_count")}),
            ("post", self.posts, {"post_id": F.col("post_id"), "label": F.col("title")}),
            (
                "ruleset", self.rulesets,
                {"category_seq": F.col("category_seq"), "label": F.col("name")},
            ),
            (
                "rule", self.rules,
                {
                    "rule_id": F.col("rule_id"), "category_seq": F.col("category_seq"),
                    "label": F.array_join("words", " "),
                },
            ),
            ("rule_count", self.rule_counts, {"rule_id": F.col("rule_id"), "count": F.col("count")}),
            (
                "post_count", self.post_counts,
                {
                    "post_id": F.col("post_id"), "category_seq": F.col("category_seq"),
                    "count": F.col("count"),
                },
            ),
        ]
        kinds = {
            "post_id": "bigint", "rule_id": "bigint", "category_seq": "int",
            "label": "string", "count": "bigint",
        }
        rows = None
        for part, table, filled in shapes:
            columns = [
                filled.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()
            ]
            piece = table.select(F.lit(part).alias("part"), *columns)
            rows = piece if rows is None else rows.unionByName(piece)
        return rows


def dashboard(
    posts: DataFrame,
    rulesets: DataFrame,
    rules: DataFrame,
    rule_words: DataFrame,
    matches: DataFrame,
    marks: DataFrame,
    topic_id: int,
    source_ids: Sequence[int],
    from_date: str | None = None,
    to_date: str | None = None,
    page: int = 1,
) -> Dashboard:
    shown = p.filter_posts(posts, topic_id, source_ids, from_date, to_date)
    mine = rules.filter(F.col("topic_id") == topic_id)
    page_posts = p.posts_page(shown, page)
    page_keys = F.broadcast(  # one page of posts
        page_posts.select("post_id", F.lit(topic_id).alias("topic_id"))
    )
    counts = r.counts_by_rule(matches, mine, shown)
    return Dashboard(
        posts_count=p.posts_count(shown),
        posts=page_posts,
        rulesets=rulesets.filter(F.col("topic_id") == topic_id).select("category_seq", "name"),
        rules=pack_rules(mine, rule_words),
        rule_counts=r.zero_filled(counts, drop_stale_marks(marks, rules), mine),
        post_counts=r.counts_by_post_ruleset(
            matches.join(page_keys.select("post_id"), "post_id", "left_semi"), mine, page_keys
        ),
    )
