"""Incremental and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrules.catalog.ingest import INGESTED_SQL, MOMENT, article_files
from textrules.catalog.reports import FROM, SOURCES, TO, TOPIC, shown, topic_rules
from textrules.catalog.sql import sql
from textrules.catalog.text import sql_lines, sql_text_sentences
from textrules.fixtures import Corpus
from textrules.operators import counts as cn
from textrules.operators import incremental as op
from textrules.operators import reports as r
from textrules.operators.rules import delete_ruleset, reset_source
from textrules.plans.rule_run import analyze, run_rules
from textrules.session import checked_broadcast, new_folder
from textrules.sources.text_files import article_posts
from textrules.streaming import jobs
from textrules.streaming.reports import StreamTables, stream_reports

ROW_GROUP = 4 << 20


def last_post(c) -> int:
    return c.table("documents").agg(F.max("doc_id")).first()[0]


def stored_before(c):
    """What earlier runs have stored: matches up to each rule's mark."""
    return c.matches.join(checked_broadcast(c.watermark), "rule_id").filter(
        "post_id <= last_post_id"
    ).select("rule_id", "post_id", "sentence_seq")


def incremental(parity):
    def query(c):
        return op.incremental_matches(
            c.sentences, c.packed_rules, c.watermark, last_post(c), parity
        )

    return query


def rule_run_marks(c):
    run = run_rules(c.sentences, c.packed_rules, c.watermark, stored_before(c), last_post(c))
    return run.marks


def analyze_counts(c):
    """The answer to a request to analyse: counts by rule after the run it makes."""
    _, counts, _ = analyze(
        c.stored_posts, c.sentences, c.rules, c.rule_words, c.watermark, stored_before(c),
        TOPIC, SOURCES, FROM, TO,
    )
    return counts


def document_stream(c, slices: int = 4):
    """The documents arriving as a few files, one per micro-batch."""
    folder = new_folder(c.spark, "arriving")
    # small row groups: each is read by one task, and a batch is one file
    c.documents.repartition(slices, "doc_id").write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return (
        c.spark.readStream.schema(c.documents.schema)
        .option("maxFilesPerTrigger", "1")
        .parquet(folder)
    )


def finish(query):
    query.awaitTermination()


def stream_rule_matches(c):
    path, marks = new_folder(c.spark, "stream-matches"), new_folder(c.spark, "stream-state")
    posts = Corpus.posts_of(document_stream(c)).select("post_id", "text")
    finish(jobs.stream_rule_matches(posts, lambda: c.packed_rules, path, marks, once=True))
    return jobs.streamed(c.spark, path)


def stream_ingest_files(c):
    path, marks = new_folder(c.spark, "stream-ingest"), new_folder(c.spark, "stream-state")
    arriving = Corpus(c.spark, c.sf_dir)
    arriving.documents = document_stream(c)
    posts = article_posts(article_files(arriving))
    finish(jobs.stream_ingest_files(posts, path, marks, once=True))
    words = jobs.streamed(c.spark, f"{path}/words")
    return (
        jobs.streamed(c.spark, f"{path}/sentence_words")
        .join(words, "word_id")
        .join(jobs.streamed(c.spark, f"{path}/posts").select("post_id", "path"), "post_id")
        .select("path", "sentence_seq", "word_seq", "word")
    )


def arriving_files(c):
    """Documents as article files below ``posts/<topic>/<source>``, one slice after another."""
    docs = document_stream(c)
    stamp = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 8760))"), MOMENT)
    path = F.concat_ws("/", F.lit("posts"), "lang", "source", F.concat(stamp, F.lit("_"), F.col("doc_id"), F.lit(".txt")))
    files = article_posts(docs.select(path.alias("path"), F.col("text").alias("value")))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.withColumn("topic", part(-3)).withColumn("source", part(-2))


_reported: dict[tuple[str, str], str] = {}


def reported(c) -> StreamTables:
    """The whole stream from files to counts, run once an application.

    Half of the rules are there from the start; the others are added when two batches have gone.
    """
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _reported:
        path, marks = new_folder(c.spark, "stream-reports"), new_folder(c.spark, "stream-state")
        seen = []

        def rules():
            seen.append(1)
            return c.packed_rules.filter("rule_id % 2 = 1") if len(seen) <= 2 else c.packed_rules

        finish(stream_reports(arriving_files(c), rules, path, marks, once=True))
        _reported[key] = path
    return StreamTables(c.spark, _reported[key])


def file_report(c):
    """Matches by topic, source, day and rule, from the counts that the stream has kept."""
    tables = reported(c)
    names = lambda t: tables.table(t).withColumnRenamed("name", t[:-1])
    return (
        cn.folded(tables.counts.by_day, cn.DAY_KEYS)
        .join(F.broadcast(names("topics")), "topic_id").join(F.broadcast(names("sources")), "source_id")
        .select("topic", "source", F.date_format("day", "yyyy-MM-dd").alias("day"), "rule_id", "n")
    )


def file_matches(c):
    tables = reported(c)
    return tables.matches.join(tables.table("posts").select("post_id", "path"), "post_id").select(
        "path", "sentence_seq", "rule_id"
    )


# -- counts kept by deltas ----------------------------------------------------------------


def kept_counts(c) -> cn.MatchCounts:
    """Counts after two runs: what earlier runs have stored, then what a run finds above the marks."""

    def run_matches():
        return op.incremental_matches(c.sentences, c.packed_rules, c.watermark, last_post(c))

    def of_runs(name):
        def build():
            first = cn.deltas_of(stored_before(c), c.stored_posts)
            second = cn.deltas_of(c.stored("run-matches", run_matches), c.stored_posts)  # matched once
            return getattr(first.plus(second), name)

        return build

    return cn.MatchCounts(*(c.stored(f"counts-{n}", of_runs(n)) for n in ("by_day", "by_post")))


def deleted(c):
    """Counts, rules and posts after ruleset (1, 2) and source 3 of topic 1 are gone."""
    counts = kept_counts(c)
    rules = delete_ruleset({"rules": c.rules, "rulesets": c.rulesets}, 1, 2)["rules"]
    gone = c.rules.join(rules, "rule_id", "left_anti")
    counts = counts.plus(cn.deltas_without_rules(counts, gone))
    posts = reset_source({"posts": c.stored_posts, "sources": c.sources}, 1, 3)["posts"]
    return counts.plus(cn.deltas_without_source(counts, c.stored_posts, 1, 3)), rules, posts


def kept_by_rule(c):
    return cn.counts_by_rule(kept_counts(c), topic_rules(c), TOPIC, SOURCES, FROM, TO)


def kept_after_deletes(c):
    """All that is left of both tables of counts, as one list."""
    counts, _, _ = deleted(c)
    by_day = cn.folded(counts.by_day, cn.DAY_KEYS).select(
        "rule_id", "topic_id", "source_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.lit(None).cast("bigint").alias("post_id"), "n",
    )
    by_post = cn.folded(counts.by_post, cn.POST_KEYS)
    return by_day.unionByName(by_post, allowMissingColumns=True)


def incremental_sql(high):
    return sql("matches watermark posts", f"""
SELECT m.rule_id, m.post_id, m.sentence_seq FROM matches m LEFT JOIN watermark w USING (rule_id)
WHERE m.post_id > coalesce(last_post_id, -1) AND m.post_id {high} (SELECT max(post_id) FROM posts)""")


_FILE_POSTS = ("", f"""
SELECT doc_id AS post_id, lang, source, 'posts/' || lang || '/' || source || '/'
    || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 8760 AS INTEGER)), '%Y-%m-%d %H:%M:%S_') || doc_id || '.txt' AS path,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 8760 AS INTEGER)), '%Y-%m-%d') AS day,
  len({sql_lines('text')}) AS n_lines, array_to_string(({sql_lines('text')})[3:], chr(10)) AS body FROM documents""")
_FILE_SENTENCES = ("file_posts", f"""
WITH {sql_text_sentences('post_id', 'body', 'file_posts')} SELECT post_id, sentence_seq, full_text FROM spoken""")

# Sentences of whole posts as the ingest cuts them.
_POST_SENTENCES = ("posts", f"""
WITH {sql_text_sentences('post_id', 'text', 'posts')} SELECT post_id, sentence_seq, full_text FROM spoken""")


def file_sql(needs, body):
    """A query over posts and sentences as the ingest of article files cuts them."""
    return sql(f"file_posts {needs}", body, file_posts=_FILE_POSTS, sentences=_FILE_SENTENCES)


_BEFORE = """
before AS (SELECT m.rule_id, m.post_id, m.sentence_seq FROM matches m JOIN watermark w USING (rule_id)
  WHERE m.post_id <= last_post_id)"""

ENTRIES = {
    "incremental_matches": (incremental(False), incremental_sql("<=")),
    "incremental_matches_parity": (incremental(True), incremental_sql("<")),
    "advance_watermark": (
        rule_run_marks,
        sql("packed_rules watermark posts", """
SELECT rule_id, greatest((SELECT max(post_id) FROM posts), coalesce(last_post_id, -1)) AS last_post_id
FROM packed_rules LEFT JOIN watermark USING (rule_id)"""),
    ),
    "idempotent_append": (
        lambda c: op.append_new(stored_before(c), c.matches),
        sql("matches", "SELECT rule_id, post_id, sentence_seq FROM matches"),
    ),
    "rule_run": (
        lambda c: run_rules(
            c.sentences, c.packed_rules, c.watermark, stored_before(c), last_post(c)
        ).new_matches,
        sql("matches watermark", f"""{_BEFORE}
SELECT rule_id, post_id, sentence_seq FROM matches ANTI JOIN before USING (rule_id, post_id, sentence_seq)
LEFT JOIN watermark USING (rule_id) WHERE post_id > coalesce(last_post_id, -1)"""),
    ),
    "analyze": (
        analyze_counts,
        sql("matches watermark posts shown_posts packed_rules", """
known AS (SELECT max(post_id) AS until FROM posts WHERE topic_id = 1 AND source_id BETWEEN 0 AND 14),
run AS (SELECT rule_id, post_id FROM matches LEFT JOIN watermark USING (rule_id), known
  WHERE post_id <= last_post_id OR (post_id > coalesce(last_post_id, -1) AND post_id <= until)),
counts AS (SELECT rule_id, count(*) AS n FROM run JOIN shown_posts USING (post_id) GROUP BY rule_id)
SELECT rule_id, coalesce(n, 0) AS count FROM packed_rules LEFT JOIN counts USING (rule_id)
WHERE topic_id = 1"""),
    ),
    "stream_rule_matches": (
        stream_rule_matches,
        sql("matches", "SELECT rule_id, post_id, sentence_seq FROM matches", sentences=_POST_SENTENCES),
    ),
    "stream_ingest_files": (stream_ingest_files, INGESTED_SQL),
    "file_report": (
        file_report,
        file_sql("matches", """
SELECT lang AS topic, source, day, rule_id, count(*) AS n FROM matches JOIN file_posts USING (post_id)
GROUP BY ALL"""),
    ),
    "file_matches": (
        file_matches,
        file_sql("matches", "SELECT path, sentence_seq, rule_id FROM matches JOIN file_posts USING (post_id)"),
    ),
    "file_quarantine": (
        lambda c: reported(c).table("quarantine"),
        file_sql("", """
SELECT path, CASE WHEN n_lines = 0 THEN 'no title' ELSE 'no text' END AS reason FROM file_posts WHERE n_lines < 3"""),
    ),
    "kept_counts_by_rule": (
        kept_by_rule,
        sql("rule_counts", "SELECT rule_id, count FROM rule_counts"),
    ),
    "kept_counts_zero_filled": (
        lambda c: r.zero_filled(kept_by_rule(c), c.watermark, topic_rules(c)),
        sql("rule_counts watermark", """
SELECT rule_id, coalesce(count, 0) AS count FROM (
  SELECT rule_id FROM watermark JOIN rules USING (rule_id) WHERE topic_id = 1
  UNION SELECT rule_id FROM rule_counts) LEFT JOIN rule_counts USING (rule_id)"""),
    ),
    "kept_counts_by_ruleset": (
        lambda c: r.counts_by_ruleset(kept_by_rule(c), c.rules, c.rulesets),
        sql("rule_counts rules rulesets", """
SELECT r.topic_id, r.category_seq, any_value(s.name) AS name, CAST(sum(count) AS BIGINT) AS count
FROM rule_counts JOIN rules r USING (rule_id)
JOIN rulesets s ON s.topic_id = r.topic_id AND s.category_seq = r.category_seq
GROUP BY 1, 2 HAVING sum(count) > 0"""),
    ),
    "kept_counts_by_post_ruleset": (
        lambda c: cn.counts_by_post_ruleset(kept_counts(c), c.rules, shown(c)),
        sql("post_counts", "SELECT post_id, category_seq, count FROM post_counts"),
    ),
    "kept_counts_after_deletes": (
        kept_after_deletes,
        sql("matches rules posts", """
left_over AS (SELECT m.rule_id, m.post_id, p.topic_id, p.source_id, strftime(p.ts, '%Y-%m-%d') AS day
  FROM matches m JOIN rules r USING (rule_id) JOIN posts p USING (post_id)
  WHERE NOT (r.topic_id = 1 AND r.category_seq = 2) AND NOT (p.topic_id = 1 AND p.source_id = 3))
SELECT rule_id, topic_id, source_id, day, CAST(NULL AS BIGINT) AS post_id, count(*) AS n FROM left_over GROUP BY ALL
UNION ALL
SELECT rule_id, NULL, NULL, NULL, post_id, count(*) FROM left_over GROUP BY ALL"""),
    ),
}
