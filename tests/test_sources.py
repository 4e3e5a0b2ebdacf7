import pytest
from pyspark.errors import AnalysisException

from textrules.schemas import TABLES, create_tables
from textrules.session import new_folder
from textrules.sources import csv_files, records
from textrules.sources import text_files as tf
from textrules.sources.pages import html_articles

# Invented rows: a glued stamp, a quoted cell with commas and bare jamo, a link with blanks.
SAMPLE = (
    '12,0,[2020-01-02 03:04 :05] 오늘은 비가 온다..\n'
    '12,2,"[2020-01-02 03:05 :06] @somebody 천천히 ㄱ ㅏ 세 요,,,"\n'
    '12,7,https: //ex .org /AbCdEf\n'
)


def test_article_files(spark, tmp_path):
    name = "2016-04-09 11:00:00_7.txt"
    (tmp_path / name).write_text("title\n\nhttp://u\nbody 1\n   \nbody 2\n", encoding="utf-8")
    files = tf.read_text_files(spark, str(tmp_path))
    post = tf.article_posts(files).first()
    assert post.path.endswith(name)
    assert (post.title, post.url, post.stamp, post.text) == (
        "title", "http://u", "2016-04-09 11:00:00", "body 1\nbody 2"
    )
    lines = [(r.line_no, r.line) for r in tf.text_lines(files).orderBy("line_no").collect()]
    assert lines == [(0, "title"), (1, "http://u"), (2, "body 1"), (3, "body 2")]


def test_batch_files_and_skipping(spark, tmp_path):
    old, new = "a b - 2016-10-01 08:00:00 (2).txt", "c+d e - 2016-10-02 09:30:00 (1).txt"
    for name in (old, new):
        (tmp_path / name).write_text(f" {name[:-4]} \n\n[x] one\n", encoding="utf-8")
    files = tf.read_text_files(spark, str(tmp_path))
    posts = spark.createDataFrame(
        [(1, 2, old[:-4]), (1, 3, new[:-4])], "topic_id int, source_id int, title string"
    )
    left = tf.batch_posts(tf.new_files(files, posts, 1, 2)).collect()
    assert [(r.title, r.stamp, r.text) for r in left] == [(new[:-4], "2016-10-02 09:30:00", "[x] one")]


def test_limit_docs(spark):
    docs = spark.createDataFrame([(3, "c"), (1, " \n"), (0, "?!"), (2, "b"), (4, None)], "id int, text string")
    assert [r.id for r in tf.limit_docs(docs, "id", n=1).collect()] == [2]
    assert sorted(r.id for r in tf.limit_docs(docs, "id", n=-1).collect()) == [2, 3]


def test_csv_sample(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SAMPLE, encoding="utf-8")
    rows = csv_files.csv_source(
        spark, str(tmp_path / "s.csv"), "post_id INT, sentence_seq INT, text STRING"
    ).collect()
    assert [(r.post_id, r.sentence_seq) for r in rows] == [(12, 0), (12, 2), (12, 7)]
    assert rows[1].text.endswith("세 요,,,")


def test_csv_sink_strips_and_refuses_to_overwrite(spark):
    path = new_folder(spark, "csv")
    df = spark.createDataFrame([(1, ' a,"b"\n c\t'), (2, "\\")], "id int, text string")
    csv_files.csv_sink(df, path)
    back = csv_files.csv_source(spark, path, "id INT, text STRING").collect()
    assert {r.id: r.text for r in back} == {1: 'a,"b"\n c', 2: "\\"}
    with pytest.raises(AnalysisException):
        csv_files.csv_sink(df, path)
    csv_files.csv_sink(df.limit(1), path, update=True)
    assert csv_files.csv_source(spark, path, "id INT, text STRING").count() == 1


FILE = (
    "2016-06-24 16:52:01 - 2016-06-24 17:00:00 (3)\n\n"
    "[2016-06-24 16:52:01] one\n  more \n[2016-06-24 16:53:58] two\n[2016-06-24 17:00:00] three\nend\n"
)


def test_records(spark):
    files = spark.createDataFrame([("d/a - b.txt", FILE), ("d/none.txt", "no record\n")], "path string, value string")
    rows = records.assemble_records(files).orderBy("record_no").collect()
    assert [(r.record_no, r.record) for r in rows] == [
        (0, "[2016-06-24 16:52:01] one\nmore"),
        (1, "[2016-06-24 16:53:58] two"),
        (2, "[2016-06-24 17:00:00] three\nend"),
    ]
    assert rows[0].header == "2016-06-24 16:52:01 - 2016-06-24 17:00:00 (3)\n"


def test_reversed_records(spark):
    name = "2016-06-24 16:52:01 - 2016-06-24 17:00:00 (3).txt"
    row = records.reverse_records(spark.createDataFrame([(f"d/{name}", FILE)], "path string, value string")).first()
    assert row.name == "2016-06-24 17:00:00 - 2016-06-24 16:52:01 (3).txt"
    assert row.value == (
        "2016-06-24 17:00:00 - 2016-06-24 16:52:01 (3)\n\n"
        "[2016-06-24 17:00:00] three\nend\n[2016-06-24 16:53:58] two\n[2016-06-24 16:52:01] one\nmore"
    )


def test_batches_written_by_month(spark, tmp_path):
    rows = spark.sql(
        "select id as key, timestamp'2016-09-30 23:00:00' + make_dt_interval(0, 0, int(id)) as ts, 't' as text "
        "from range(250)"
    )
    batches = records.chunk_batches(rows, "ts", "key", "text")
    got = {(str(r.day), r.batch_no): (r.folder, r.n, r.label) for r in batches.collect()}
    assert got["2016-09-30", 0][:2] == ("posts_2016_09", 60)
    assert got["2016-10-01", 0] == (
        "posts_2016_10", 100, "2016-10-01 00:00:00 - 2016-10-01 01:39:00 (100)"
    )
    assert got["2016-10-01", 1][1] == 90
    records.write_batches(batches, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {
        "folder=posts_2016_09", "folder=posts_2016_10"
    }


def test_pages_without_body_are_dropped(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article> <br> </article>"), (2, "v", "<article>x</article>")],
        "page_id long, url string, html string",
    )
    assert [(r.page_id, r.body) for r in html_articles(pages).collect()] == [(2, "x")]


def test_create_tables(spark, tmp_path):
    empty = create_tables(spark, str(tmp_path))
    assert set(empty) == set(TABLES)
    for name, table in empty.items():
        assert table.schema == TABLES[name]
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        assert stored.count() == 0
        assert [f.dataType for f in stored.schema] == [f.dataType for f in TABLES[name]]
