import re

import pytest
from pyspark.sql import functions as F

from textrules.functions import html as h
from textrules.functions import text as tx
from textrules.operators.sentences import scrub_rows, tag_tokens, tagged_text


def value(spark, function, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(function(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "pieces"),
    [
        ("자살 ㅠㅠ 각ㅋㅋㅋ", ["자살 ", "ㅠㅠ", " 각", "ㅋㅋㅋ"]),
        ("끝ㅋ", ["끝ㅋ"]),  # one lone jamo at the end is no run
        ("ㅋ끝", ["ㅋ", "끝"]),
        ("ㅋ", ["ㅋ"]),
        ("ㅋㅋ", ["ㅋㅋ"]),
        ("aㅋb", ["a", "ㅋ", "b"]),
        ("aㅤb", ["aㅤb"]),  # just past the last jamo
        ("", []),
    ],
)
def test_jamo_pieces(spark, line, pieces):
    assert value(spark, tx.jamo_pieces, line) == pieces


@pytest.mark.parametrize(
    ("line", "sentences"),
    [
        ("One. Two!  Three?", ["One.", "Two!", "Three?"]),
        ("  One. Two. ", ["  One.", "Two. "]),
        ("a " + "b" * 21 + ". c.", ["a " + "b" * 21 + ". c."]),  # a chunk of over 20 characters
        ("b" * 20 + ". c.", ["b" * 20 + ". c."]),  # 21 with its full stop
        ("b" * 19 + ". c.", ["b" * 19 + ".", "c."]),
        ("...", ["..."]),  # nothing to cut: stays whole
    ],
)
def test_line_sentences(spark, line, sentences):
    assert value(spark, tx.line_sentences, line) == sentences


def test_text_sentences_keeps_jamo_runs_apart(spark):
    assert value(spark, tx.text_sentences, "하나. 둘ㅋㅋ셋\n\n넷") == ["하나.", "둘", "ㅋㅋ", "셋", "넷"]


@pytest.mark.parametrize("text", ["", "   ", "\n \n"])
def test_empty_texts_have_no_sentences(spark, text):
    assert value(spark, tx.text_sentences, text) == []


PHONE = re.compile(r"(\+\d{1,2}\s)?\(?\d{2,3}\)?[\s.-]\d{3,4}[\s.-]\d{4}", re.ASCII)


@pytest.mark.parametrize(
    "text",
    ["call 010-1234-5678 now", "+82 (02) 123 4567", "02.123.4567x", "12-34-5678", "010 1234 5678"],
)
def test_scrub_phone(spark, text):
    assert value(spark, tx.scrub_phone, text) == PHONE.sub(" __PHONE__ ", text)


URL = re.compile(
    r"http[s]?:(?:\s?/)/(?:[a-zA-Z]|[0-9]|(?:\s?[$-_@.&+])|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F])|[…])+"
)


@pytest.mark.parametrize(
    "text",
    [
        "링크는 https: //ex .org /AbCdEf",
        "see http://a.b/c%20d… and more",
        "http: /x",
        "a http://x /y z",
        "http://t.co/Abc 가나다 http: //u .co",
        "HTTP://no",
        "x http://a b c",
        "http://" + "Ab/" * 20000,  # long links do not exhaust the stack
    ],
)
def test_scrub_url(spark, text):
    assert value(spark, tx.scrub_url, text) == URL.sub(" __URL__ ", text)


def test_phone_inside_a_link_is_marked_first(spark):
    text = "http://t.co/010-1234-5678/x"
    assert value(spark, tx.scrub, text) == URL.sub(" __URL__ ", PHONE.sub(" __PHONE__ ", text))


def test_scrub_rows_drops_broken_rows_and_lists_changes(spark):
    rows = [(1, "ok"), (2, "í ½ broken 010-1234-5678"), (3, "call 010-1234-5678")]
    kept, changed = scrub_rows(spark.createDataFrame(rows, "id int, text string"), "text")
    assert {r.id: r.text for r in kept.collect()} == {1: "ok", 3: "call  __PHONE__ "}
    assert [(r.id, r.before) for r in changed.collect()] == [(3, "call 010-1234-5678")]


def test_normalize(spark):
    text = "{(red apples 2020),(red apples),(green pears)}"
    assert value(spark, tx.normalize, text) == "red apples 2020 red apples green pears"
    assert value(spark, tx.normalize, "Über  naïve☃ straße😀!") == (
        "Uber naive _emoticon_ strasse _emoticon_"
    )


def test_match_key(spark):
    assert value(spark, tx.match_key, "[2020-01-02 03:04 :05] 곧 봄") == "곧봄"


def test_word_and_tag(spark):
    assert value(spark, tx.token_of, "a_b_Noun") == "a_b"
    assert value(spark, tx.tag_of, "a_b_Noun") == "Noun"


def test_classes(spark):
    text = "#태그 @name 자살 ㅋㅋ abc 12 ж !?"
    tagged = value(spark, tx.tagged_words, text)
    assert [w.rpartition("_")[2] for w in tagged] == [
        "Hashtag", "ScreenName", "Unknown", "KoreanParticle", "Alpha", "Number", "Foreign", "Punctuation",
    ]
    array = spark.createDataFrame([(["a_Noun", "b_Josa", "c_d_Verb"],)], "w array<string>")
    assert array.select(tx.keep_classes(F.col("w"))).first()[0] == ["a_Noun", "c_d_Verb"]


def test_lexicon_names_known_words(spark):
    sentences = spark.createDataFrame([(1, 0, "자살 각 12")], "post_id long, sentence_seq int, full_text string")
    lexicon = spark.createDataFrame([("자살", "Noun")], "token string, tag string")
    got = [(r.token, r.tag) for r in tag_tokens(sentences, lexicon).orderBy("word_seq").collect()]
    assert got == [("자살", "Noun"), ("각", "Unknown"), ("12", "Number")]


def test_rows_without_text_are_set_apart(spark):
    rows = spark.createDataFrame([(1, "a 1"), (2, None)], "id int, text string")
    good, bad = tagged_text(rows, "text")
    assert [(r.id, r.text) for r in good.collect()] == [(1, "a_Alpha 1_Number")]
    assert [r.id for r in bad.collect()] == [2]


def test_page(spark):
    page = (
        '<script>var t="</p>";</script><!-- <h1>no</h1> --><h1 id="news_title_text_id"> T &amp;lt; </h1>'
        '<p id="date_text">입력 : 2016.04.09 : 2016.04.10</p>'
        '<div class="par">one<BR>two<b>!</b></div><div class="par"> three</div>'
        '<dl><dt><a href="/a">x</a><a href="/b">y</a></dt><dt>none</dt><dt><a href="/c">z</a></dt></dl>'
    )
    assert value(spark, lambda t: h.page_title(h.visible(t)), page) == "T &lt;"
    assert value(spark, lambda t: h.page_date(h.visible(t)), page) == "2016.04.10"
    assert value(spark, lambda t: h.page_body(h.visible(t)), page) == "one\ntwo! three"
    assert value(spark, lambda t: h.entry_links(h.visible(t)), page) == ["/a", "/c"]


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("...wait what? 3.14 ok", ["...wait what?", " 3.14 ok"]),
        ("v1.2.3.4 is out. Yes!", ["v1.2.3.4 is out.", " Yes!"]),
        ("end.\n?!\n!start", ["end.", "?!", "!start"]),
        ("a.b 1.x 2.", ["a.", "b 1.", "x 2."]),
        ("1a" * 30000, ["1a" * 30000]),
    ],
)
def test_marks_and_numbers_in_sentences(spark, text, sentences):
    assert value(spark, tx.plain_sentences, text) == sentences


def test_characters_of_pages(spark):
    text = "&amp;lt; &#65;&#x42; &hellip; &nbsp;| &bogus; &#0; &#xD800; AT&T &#39;&quot;"
    assert value(spark, h.characters, text) == "&lt; AB …  | &bogus; &#0; &#xD800; AT&T '\""
