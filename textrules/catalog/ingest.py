"""Source, sink and ingest queries. Documents stand in for files: name from time, text as content."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrules.catalog.sql import sql
from textrules.catalog.text import sql_lines, sql_normal, sql_strip, sql_text_sentences
from textrules.operators.posts import day_range
from textrules.plans.ingest import give_post_ids, ingest
from textrules.schemas import TABLES
from textrules.session import new_folder
from textrules.sources import csv_files, pages, records
from textrules.sources import text_files as tf

MOMENT = "yyyy-MM-dd HH:mm:ss"


def article_files(c):
    """``posts/<time>_<id>.txt``."""
    name = F.concat(
        F.lit("posts/"), F.date_format("ts", MOMENT), F.lit("_"), F.col("post_id"), F.lit(".txt")
    )
    return c.posts.select(name.alias("path"), F.col("text").alias("value"))


_ARTICLES = """
files AS (SELECT 'posts/' || strftime(ts, '%Y-%m-%d %H:%M:%S_') || post_id || '.txt' AS path,
  text AS value FROM posts)"""


def span(c):
    later = F.col("ts") + F.expr("interval 1 day")
    return F.concat_ws(
        " ", F.date_format("ts", MOMENT), F.lit("-"), F.date_format(later, MOMENT),
        F.concat(F.lit("("), F.length("text"), F.lit(")")),
    )


def batch_files(c):
    """``posts/<min> - <max> (n).txt``: a range label, a blank line, then partly stamped lines."""
    stamped = F.regexp_replace("text", r"\n([A-M])", "\n[2024-05-01 10:00:00] $1")
    return c.posts.select(
        F.concat(F.lit("posts/"), span(c), F.lit(".txt")).alias("path"),
        F.concat(span(c), F.lit("\n\n"), stamped).alias("value"),
        "post_id",
    )


_BATCHES = """
labelled AS (SELECT post_id, text, strftime(ts, '%Y-%m-%d %H:%M:%S - ')
    || strftime(ts + to_days(1), '%Y-%m-%d %H:%M:%S') || ' (' || length(text) || ')' AS label FROM posts),
files AS (SELECT post_id, label, 'posts/' || label || '.txt' AS path, label || chr(10) || chr(10)
  || regexp_replace(text, '\\n([A-M])', chr(10) || '[2024-05-01 10:00:00] \\1', 'g') AS value FROM labelled),
lines AS (SELECT post_id, path, label, unnest(range(len(l))) AS line_no, unnest(l) AS raw
  FROM (SELECT *, string_split(regexp_replace(value, '\\n\\z', ''), chr(10)) AS l FROM files)),
starts AS (SELECT post_id, path, label, line_no, regexp_replace(raw, '^\\s+|\\s+\\z', '', 'g') AS line FROM lines),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line,
  '^\\[[0-9]{4}-[0-9]{2}-[0-9]{2}\\s[0-9]{2}:[0-9]{2}:[0-9]{2}\\]') THEN 1 ELSE 0 END)
  OVER (PARTITION BY post_id ORDER BY line_no) AS k FROM starts),
parts AS (SELECT post_id, any_value(path) AS path, any_value(label) AS label, k,
  string_agg(line, chr(10) ORDER BY line_no) AS part FROM numbered GROUP BY post_id, k)"""


def ingest_skip_existing(c):
    """Files of topic 1, source 3 that are not posts yet; the labelled ones already are."""
    done = c.posts.join(c.table("labels").select(F.col("doc_id").alias("post_id")), "post_id")
    titled = done.select(
        "topic_id", "source_id",
        F.concat(F.date_format("ts", MOMENT), F.lit("_"), F.col("post_id")).alias("title"),
    )
    return tf.new_files(article_files(c), titled, 1, 3).select("path")


def csv_source(c):
    """Documents written as CSV, line breaks and all, and read by position."""
    path = new_folder(c.spark, "csv")
    csv_files.csv_sink(c.documents.select("doc_id", "text", "lang", "n_chars"), path)
    return csv_files.csv_source(
        c.spark, path, "doc_id BIGINT, text STRING, lang STRING, n_chars BIGINT"
    )


def csv_sink(c):
    """Sentences written as CSV, over an earlier export, and read back."""
    path = new_folder(c.spark, "csv")
    csv_files.csv_sink(c.rules.select("category_seq", "full_text"), path)
    csv_files.csv_sink(c.sentences.select("post_id", "sentence_seq", "full_text"), path, update=True)
    return csv_files.csv_source(c.spark, path, "post_id BIGINT, sentence_seq INT, full_text STRING")


def predictions_round_trip(c):
    path = new_folder(c.spark, "labels")
    csv_files.predictions_sink(c.table("embeddings"), path)
    read = csv_files.csv_source(c.spark, path, "label INT")
    return read.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def ingested_words(c):
    """The whole ingest over article files, on an empty store, with words looked up again."""
    articles = tf.article_posts(article_files(c))
    done = ingest(give_post_ids(articles), c.spark.createDataFrame([], TABLES["words"]))
    return (
        done.sentence_words.join(done.new_words, "word_id")
        .join(done.posts.select("post_id", "path"), "post_id")
        .select("path", "sentence_seq", "word_seq", "word")
    )


# Pages with what the test pages lack: (html, title, date, body).
MADE_PAGES = (
    ('<h1>A</h1><p class="d" id="date_text">written : 2024.01.02</p><article class="x"><p>one</p>'
     "<div>pic</div><p>two three</p></article>after", "A", "2024.01.02", "onepictwo three"),
    ('<div id="a" class="wide par"><div><div>in</div>ner</div> end</div><div class="parts">no</div>', "", None, "inner end"),
    ("<article>caf&eacute; &#8217;&#x1F600; &amp;lt; &nope; &hellip;</article>", "", None, "café ’😀 &lt; &nope; …"),
    ("<div>nothing</div>", "", None, ""),
    (None, None, None, None),
)


def pages_and_made(c):
    made = [(-1 - k, "made", html) for k, (html, *_) in enumerate(MADE_PAGES)]
    rows = c.spark.createDataFrame(made, "page_id long, url string, html string")
    return c.pages.select("page_id", "url", "html").unionByName(rows)


def _made_sql():
    def text(value):
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    rows = [
        f"({-1 - k}, 'made', {text(title)}, {text(date)}, {text(body)})"
        for k, (_, title, date, body) in enumerate(MADE_PAGES) if body
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)})"


def event_batches(c):
    return records.chunk_batches(c.table("events"), "ts", "event_id", "event_type").select(
        "folder", F.date_format("day", "yyyy-MM-dd").alias("day"), "batch_no", "n", "label", "lines"
    )


def daily_range(c):
    return day_range(c.table("events"), "ts", "2024-01-02", "2024-01-09").select(
        "event_id", F.date_format("ts", MOMENT).alias("ts"), "event_type"
    )


_ENTITIES = "replace(" * 8 + "{}" + (
    ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"
    ", '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)


def sql_to_text(html):
    tagless = (
        f"regexp_replace(regexp_replace({html}, '(?i)<br\\s*/?>', chr(10), 'g'), "
        "'(?s)<[^>]*>', '', 'g')"
    )
    return _ENTITIES.format(tagless)


_VISIBLE = """seen AS (SELECT page_id, url, regexp_replace(html,
  '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS page FROM pages)"""

INGESTED_SQL = sql("posts", f"""{_ARTICLES},
bodies AS (SELECT path, array_to_string(l[3:], chr(10)) AS body
  FROM (SELECT path, {sql_lines('value')} AS l FROM files)),
{sql_text_sentences('path', 'body', 'bodies')},
worded AS (SELECT path, sentence_seq, regexp_extract_all(lower(full_text), '[\\p{{L}}\\p{{N}}]+') AS l
  FROM spoken)
SELECT path, sentence_seq, unnest(range(len(l)))::INTEGER AS word_seq, unnest(l) AS word FROM worded""")

ENTRIES = {
    "ingest_text_lines": (
        lambda c: tf.text_lines(article_files(c)),
        sql("posts", f"""{_ARTICLES}
SELECT path, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line
FROM (SELECT path, {sql_lines('value')} AS l FROM files)"""),
    ),
    "ingest_article_header": (
        lambda c: tf.article_posts(article_files(c)),
        sql("posts", f"""{_ARTICLES}
SELECT path, l[1] AS title, l[2] AS url,
  regexp_extract(path, '([^/_]+)_[^/]*$', 1) AS stamp, array_to_string(l[3:], chr(10)) AS text
FROM (SELECT path, {sql_lines('value')} AS l FROM files)"""),
    ),
    "ingest_batch_header": (
        lambda c: tf.batch_posts(batch_files(c)).drop("path"),
        sql("posts", f"""{_BATCHES}
SELECT {sql_strip('l[1]')} AS title, string_split(path, ' ')[4] || ' ' || string_split(path, ' ')[5]
  AS stamp, array_to_string(l[2:], chr(10)) AS text
FROM (SELECT path, {sql_lines('value')} AS l FROM files)"""),
    ),
    "ingest_skip_existing": (
        ingest_skip_existing,
        sql("posts", f"""{_ARTICLES},
done AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S_') || post_id AS title
  FROM posts JOIN labels ON doc_id = post_id WHERE topic_id = 1 AND source_id = 3)
SELECT path FROM files WHERE regexp_extract(path, '([^/]*)\\.txt$', 1) NOT IN (SELECT title FROM done)"""),
    ),
    "ingest_words": (
        ingested_words,
        INGESTED_SQL,
    ),
    "csv_source": (
        csv_source,
        sql("", f"SELECT doc_id, {sql_strip('text')} AS text, lang, n_chars FROM documents"),
    ),
    "csv_sink": (
        csv_sink,
        sql("sentences", f"""
SELECT post_id, sentence_seq, {sql_strip('full_text')} AS full_text FROM sentences"""),
    ),
    "predictions_sink": (
        predictions_round_trip,
        sql("", "SELECT label, count(*) AS n FROM embeddings GROUP BY label"),
    ),
    "limit_docs": (
        lambda c: tf.limit_docs(c.documents, "doc_id").select("doc_id", "text"),
        sql("", f"""
SELECT doc_id, text FROM documents WHERE {sql_normal('text')} <> '' ORDER BY doc_id LIMIT 75000"""),
    ),
    "html_articles": (
        lambda c: pages.html_articles(pages_and_made(c)),
        sql("", f"""{_VISIBLE},
made AS (SELECT page_id, url,
  {sql_strip(sql_to_text("regexp_extract(page, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"))} AS title,
  {sql_strip("array_to_string(list_transform(regexp_extract_all(page, "
             "'(?is)<(?:article|div class=\"par\")>(.*?)</(?:article|div)>', 1), lambda b: "
             + sql_to_text("b") + "), '')")} AS body FROM seen)
SELECT page_id, url, title, CAST(NULL AS VARCHAR) AS date, body FROM made WHERE body <> ''
UNION ALL {_made_sql()}"""),
    ),
    "html_links": (
        lambda c: pages.html_links(c.pages),
        sql("", f"""{_VISIBLE},
entries AS (SELECT page_id, list_filter(list_transform(
  regexp_extract_all(page, '(?is)<(?:li|dt)\\b[^>]*>(.*?)</(?:li|dt)>', 1),
  lambda e: regexp_extract(e, '(?i)href="([^"]*)"', 1)), lambda x: x <> '') AS l FROM seen)
SELECT page_id, unnest(range(len(l)))::INTEGER AS position, unnest(l) AS link FROM entries"""),
    ),
    "assemble_records": (
        lambda c: records.assemble_records(batch_files(c)),
        sql("posts", f"""{_BATCHES}
SELECT p.path, coalesce(h.part, '') AS header, CAST(p.k - 1 AS INTEGER) AS record_no, p.part AS record
FROM parts p LEFT JOIN parts h ON h.post_id = p.post_id AND h.k = 0 WHERE p.k > 0"""),
    ),
    # The header is the label and a blank line; name and header swap the label's ends.
    "reverse_records": (
        lambda c: records.reverse_records(batch_files(c)),
        sql("posts", f"""{_BATCHES},
turned AS (SELECT post_id, any_value(label) AS label,
    string_agg(part, chr(10) ORDER BY k DESC) FILTER (k > 0) AS records,
    any_value(part) FILTER (k = 0) AS header FROM parts GROUP BY post_id),
swapped AS (SELECT *, list_transform(string_split(header, chr(10)), lambda h: CASE
    WHEN length(h) >= 10 AND len(string_split(h, ' ')) >= 6 THEN array_to_string(
      list_transform([4, 5, 3, 1, 2, 6], lambda i: string_split(h, ' ')[i]), ' ') ELSE h END) AS head
  FROM turned)
SELECT array_to_string(list_transform([4, 5, 3, 1, 2, 6], lambda i: string_split(label || '.txt', ' ')[i]), ' ')
  AS name, concat_ws(chr(10), array_to_string(head, chr(10)), records) AS value FROM swapped"""),
    ),
    "chunk_batches": (
        event_batches,
        sql("", """
numbered AS (SELECT ts, event_id, event_type, CAST(ts AS DATE) AS day,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT strftime(any_value(day), 'posts_%Y_%m') AS folder, strftime(day, '%Y-%m-%d') AS day,
  CAST(n // 100 AS INTEGER) AS batch_no, count(*) AS n,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')
    || ' (' || count(*) || ')' AS label,
  string_agg(strftime(ts, '[%Y-%m-%d %H:%M:%S] ') || event_type, chr(10) ORDER BY numbered.n) AS lines
FROM numbered GROUP BY numbered.day, numbered.n // 100"""),
    ),
    "daily_range": (
        daily_range,
        sql("", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09'"""),
    ),
}
