import pytest

from textrules.operators import posts as p
from textrules.operators import reports as r
from textrules.operators import rules as rl
from textrules.plans.dashboard import dashboard
from textrules.session import new_folder


@pytest.fixture(scope="module")
def store(spark):
    posts = spark.sql(
        """
        select * from values
          (1L, 1, 4, 'a', 'u', timestamp'2024-01-01 00:00:00'),
          (2L, 1, 5, 'b', 'u', timestamp'2024-01-02 23:59:59'),
          (3L, 1, 4, 'c', 'u', cast(null as timestamp)),
          (4L, 2, 4, 'd', 'u', timestamp'2024-01-02 10:00:00'),
          (5L, 1, 9, 'e', 'u', timestamp'2024-01-03 00:00:00')
        as t(post_id, topic_id, source_id, title, url, ts)"""
    )
    rules = spark.createDataFrame(
        [(1, 1, 1, "x"), (2, 1, 2, "y"), (3, 2, 1, "z"), (4, 1, 2, "no words"), (5, 1, 3, "new")],
        "rule_id long, topic_id int, category_seq int, full_text string",
    )
    words = spark.createDataFrame(
        [(1, 3, "b"), (1, 0, "a"), (2, 5, "c"), (3, 1, "a"), (5, 0, "q")],
        "rule_id long, word_seq int, word string",
    )
    rulesets = spark.createDataFrame(
        [(1, 1, "one"), (1, 2, "two"), (1, 3, "three"), (1, 4, "empty"), (2, 1, "other")],
        "topic_id int, category_seq int, name string",
    )
    sentences = spark.createDataFrame(
        [(1, 0, "s0"), (1, 1, "s1"), (2, 0, "t0"), (4, 0, "v0")],
        "post_id long, sentence_seq int, full_text string",
    )
    matches = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (3, 1, 1), (1, 2, 0), (3, 4, 0)],
        "rule_id long, post_id long, sentence_seq int",
    )
    marks = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (77, 9)], "rule_id long, last_post_id long")
    return dict(posts=posts, rules=rules, words=words, rulesets=rulesets, sentences=sentences,
                matches=matches, marks=marks)


def ids(df):
    return sorted(x.post_id for x in df.collect())


def test_filter(store):
    posts = store["posts"]
    assert ids(p.filter_posts(posts, 1, [4, 5])) == [1, 2]  # no time, no match
    assert ids(p.filter_posts(posts, 1, [4, 5, 9], "2024-01-02")) == [2, 5]
    assert ids(p.filter_posts(posts, 1, [4, 5, 9], None, "2024-01-02")) == [1, 2]
    assert ids(p.filter_posts(posts, 1, [4, 5, 9], "2024-01-02", "2024-01-02")) == [2]
    assert ids(p.filter_posts(posts, 3, [4])) == []


def test_stored_posts_are_pruned(store, spark):
    from textrules.sources.tables import write_posts

    stored = write_posts(store["posts"], new_folder(spark, "posts"))
    assert sorted(map(tuple, stored.select(*store["posts"].columns).collect())) == sorted(
        map(tuple, store["posts"].collect())
    )
    shown = p.filter_posts(stored, 1, [4, 5, 9], "2024-01-02", "2024-01-02")
    assert ids(shown) == [2]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "topic_id" in partition_filters and "month" in partition_filters
    assert "In(source_id" in plan and "GreaterThanOrEqual(ts" in plan


def test_pages(store):
    shown = p.filter_posts(store["posts"], 1, [4, 5, 9])
    first, second = p.posts_page(shown, 1, 2).collect(), p.posts_page(shown, 2, 2).collect()
    assert [x.post_id for x in first] == [1, 2]
    assert [(x.post_id, x.date) for x in second] == [(5, "2024/01/03")]
    count = p.posts_count(shown)
    assert count.select(p.last_page(count.posts_count, 2)).first()[0] == 2


def test_counts(store):
    shown = p.filter_posts(store["posts"], 1, [4, 5])
    mine = store["rules"].filter("topic_id = 1")
    counts = r.counts_by_rule(store["matches"], mine, shown)
    assert dict(counts.collect()) == {1: 2, 2: 1}
    marks = rl.drop_stale_marks(store["marks"], store["rules"])
    # rule 4 was analysed without a match; rule 5 never; rule 3 is of another topic
    assert dict(r.zero_filled(counts, marks, mine).collect()) == {1: 2, 2: 1, 4: 0}
    assert dict(r.zero_filled(counts, marks).collect()) == {1: 2, 2: 1, 3: 0, 4: 0}
    by_set = r.counts_by_ruleset(counts, store["rules"], store["rulesets"]).collect()
    assert {(x.name, x["count"]) for x in by_set} == {("one", 2), ("two", 1)}


def test_post_counts_use_rules_of_the_posts_topic(store):
    counts = r.counts_by_post_ruleset(store["matches"], store["rules"], store["posts"])
    got = {(x.post_id, x.category_seq): x["count"] for x in counts.collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (4, 1): 1}
    shares = {(x.post_id, x.category_seq): x.share for x in r.post_ruleset_share(counts).collect()}
    assert shares[1, 1] == 50.0 and shares[2, 1] == 100.0


def test_sentences(store):
    s, m = store["sentences"], store["matches"]
    listed = {(x.post_id, x.sentence_seq): x.rules for x in r.sentences_of_post(s, m).collect()}
    assert listed == {(1, 0): [1, 2], (1, 1): [3], (2, 0): [1], (4, 0): [3]}
    shown = p.filter_posts(store["posts"], 1, [4, 5])
    by_rule = {(x.rule_id, x.rnum): x.full_text for x in r.sentences_by_rule(m, shown, s).collect()}
    assert by_rule == {(1, 0): "s0", (1, 1): "t0", (2, 0): "s0", (3, 0): "s1"}
    strict = r.sentences_by_ruleset(m, store["rules"], shown, s)
    assert {(x.category_seq, x.full_text) for x in strict.collect()} == {(1, "s0"), (1, "t0"), (2, "s0")}
    loose = r.sentences_by_ruleset(m, store["rules"], shown, s, parity=True)
    assert (1, "s1") in {(x.category_seq, x.full_text) for x in loose.collect()}
    first = {(x.post_id, x.sentence_seq): x.category_seq
             for x in r.sentence_primary_ruleset(m, store["rules"]).collect()}
    assert first[1, 0] == 1


def test_dashboard_leaves_out_wordless_rules(store):
    board = dashboard(
        store["posts"], store["rulesets"], store["rules"], store["words"], store["matches"],
        store["marks"], 1, [4, 5],
    )
    assert {x.rule_id: (x.gap, x.words) for x in board.rules.collect()} == {
        1: (3, ["a", "b"]), 2: (0, ["c"]), 5: (0, ["q"])
    }
    assert board.posts_count.first()[0] == 2
    assert board.as_rows().count() == 1 + 2 + 4 + 3 + 3 + 3


def test_ruleset_numbers_go_on_per_topic(store, spark):
    new = spark.createDataFrame([(1, "p"), (1, "q"), (7, "r")], "topic_id int, name string")
    grown = rl.ruleset_add(store["rulesets"], new)
    added = {x.name: (x.topic_id, x.category_seq) for x in grown.collect() if x.name in "pqr"}
    assert added == {"p": (1, 5), "q": (1, 6), "r": (7, 1)}
    latest = {x.topic_id: x.name for x in rl.ruleset_latest(grown).collect()}
    assert latest == {1: "q", 2: "other", 7: "r"}


def test_deleting_cascades(store):
    tables = {"rules": store["rules"], "rule_words": store["words"], "matches": store["matches"],
              "marks": store["marks"], "rulesets": store["rulesets"]}
    left = rl.delete_ruleset(tables, 1, 1)
    assert {x.rule_id for x in left["rules"].collect()} == {2, 3, 4, 5}
    assert {x.rule_id for x in left["rule_words"].collect()} == {2, 3, 5}
    assert {x.rule_id for x in left["matches"].collect()} == {2, 3}
    assert 1 not in {x.rule_id for x in left["marks"].collect()}
    assert {(x.topic_id, x.category_seq) for x in left["rulesets"].collect()} == {
        (1, 2), (1, 3), (1, 4), (2, 1)
    }


def test_rules_add(store, spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "q")], "word_id long, word string")
    ids_of = {x.word: x.word_id for x in vocab.collect()}
    words = store["words"].join(vocab, "word").select("rule_id", "word_seq", "word_id")
    new = spark.createDataFrame(
        [(10, 1, 2, "text", [(0, "b"), (2, "new_Noun")]), (11, 2, 1, "more", [(1, "a")])],
        "new_key long, topic_id int, category_seq int, full_text string, chosen array<struct<seq:int,word:string>>",
    )
    rules, rule_words, grown = rl.rules_add(store["rules"], words, vocab, new)
    assert {(x.rule_id, x.full_text) for x in rules.filter("rule_id > 5").collect()} == {(6, "text"), (7, "more")}
    assert {x.word: x.word_id for x in grown.collect()} == {**ids_of, "new_Noun": 5}
    shown = {x.rule_id: x.words for x in rl.rules_with_words(rules, rule_words, grown).collect()}
    assert shown[6] == ["b", "new"] and shown[7] == ["a"] and 4 not in shown


def test_source_reset(store, spark):
    sources = spark.createDataFrame([(4, "s4"), (5, "s5")], "source_id int, name string")
    left = rl.reset_source(
        {"posts": store["posts"], "sentences": store["sentences"], "sources": sources,
         "sentence_words": store["sentences"]}, 1, 4,
    )
    assert ids(left["posts"]) == [2, 4, 5]
    assert sorted({x.post_id for x in left["sentences"].collect()}) == [2, 4]
    assert [x.source_id for x in left["sources"].collect()] == [5]


def test_months_agree_across_time_zones(spark):
    """Posts stored in one session's zone are read whole in another's."""
    from textrules.sources.tables import write_posts

    zone = spark.conf.get("spark.sql.session.timeZone")
    path = new_folder(spark, "zoned")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        rows = spark.sql(
            "SELECT id AS post_id, 1 AS topic_id, 2 AS source_id, "
            "timestamp'2024-01-31 00:00:00' + make_dt_interval(0, int(id)) AS ts FROM range(72)"
        )
        stored = write_posts(rows, path)
        for other in ("Asia/Seoul", "America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            for bounds in (("2024-02-01", None), (None, "2024-01-31"), ("2024-02-01", "2024-02-01")):
                plain = p.filter_posts(rows, 1, [2], *bounds).select("post_id").collect()
                assert sorted(plain) == sorted(p.filter_posts(stored, 1, [2], *bounds).select("post_id").collect())
                assert plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
