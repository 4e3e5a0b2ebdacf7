"""Text preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrules.catalog.sql import sql, sql_plain_sentences
from textrules.functions import text as tx
from textrules.operators import sentences as op

# Test documents hold no jamo, emoji or spaced links, so both sides derive them from syllables.
JAMO_SQL = "replace(replace(replace(text, 'th', 'ㅋㅋ'), 'que', 'ㅠ'), 'schen', 'ㅠㅠㅎ')"
EMOJI_SQL = "replace(replace(replace(text, 'en', '😀'), 'tion', '☃'), 'ch', '🚀')"
LINK_SQL = "regexp_replace(text, '\\. ([A-E])', '. https: //t .co /\\1')"


def sql_strip(text):
    return f"regexp_replace({text}, '^\\s+|\\s+\\z', '', 'g')"


def sql_lines(text):
    return f"list_filter(string_split({text}, chr(10)), lambda ln: {sql_strip('ln')} <> '')"


SQL_PIECES = """regexp_extract_all({}, '[^\\x{{3131}}-\\x{{3163}}]+[\\x{{3131}}-\\x{{3163}}]?\\z"""
SQL_PIECES += """|[^\\x{{3131}}-\\x{{3163}}]+|[\\x{{3131}}-\\x{{3163}}]+')"""


def sql_cut(line):
    return f"""list_filter(list_transform({sql_plain_sentences(line)},
      lambda s: {sql_strip('s')}), lambda s: s <> '')"""


def sql_framed(line, cut):
    return f"""CASE WHEN len(list_filter(string_split({line}, ' '), lambda ch: length(ch) > 20)) > 0
      OR len({cut}) = 0 THEN [{line}]
    ELSE list_transform({cut}, lambda s, i:
      (CASE WHEN i = 1 THEN regexp_extract({line}, '^(\\s*)', 1) ELSE '' END) || s
      || (CASE WHEN i = len({cut}) THEN regexp_extract({line}, '(\\s*)\\z', 1) ELSE '' END)) END"""


SURFACE_SQL = (
    "regexp_extract_all({}, '[#@][\\p{{L}}\\p{{N}}_]+|[\\x{{AC00}}-\\x{{D7A3}}]+"
    "|[\\x{{3131}}-\\x{{3163}}]+|[A-Za-z\\x{{C0}}-\\x{{24F}}]+|\\p{{N}}+|\\p{{L}}+|[^\\s\\p{{L}}\\p{{N}}]+')"
)
CLASS_SQL = """CASE WHEN regexp_matches({0}, '^#.') THEN 'Hashtag'
  WHEN regexp_matches({0}, '^@.') THEN 'ScreenName'
  WHEN regexp_matches({0}, '^[\\x{{3131}}-\\x{{3163}}]') THEN 'KoreanParticle'
  WHEN regexp_matches({0}, '^\\p{{N}}') THEN 'Number'
  WHEN regexp_matches({0}, '^[A-Za-z\\x{{C0}}-\\x{{24F}}]') THEN 'Alpha'
  WHEN regexp_matches({0}, '^[\\x{{AC00}}-\\x{{D7A3}}]') THEN 'Unknown'
  WHEN regexp_matches({0}, '^\\p{{L}}') THEN 'Foreign' ELSE 'Punctuation' END"""
TAGGED_SQL = (
    "list_transform(" + SURFACE_SQL.format("text") + ", lambda t: t || '_' || "
    + CLASS_SQL.format("t") + ")"
)
PHONE_SQL = "'(\\+\\d{1,2}\\s)?\\(?\\d{2,3}\\)?[\\s.-]\\d{3,4}[\\s.-]\\d{4}'"
_SPACE = (
    "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
URL_SQL = (
    f"'http[s]?:(?:{_SPACE}?/)/(?:[a-zA-Z]|[0-9]|(?:{_SPACE}?[$-_@.&+])|[!*\\(\\),]"
    "|(?:%[0-9a-fA-F][0-9a-fA-F])|[…])+'"
)


def sql_phone(text):
    return f"regexp_replace({text}, {PHONE_SQL}, ' __PHONE__ ', 'g')"


def sql_url(text):
    return f"regexp_replace({text}, {URL_SQL}, ' __URL__ ', 'g')"


def sql_ascii(text):
    folded = f"strip_accents({text})"
    for mark, plain in tx.LETTER_FOLDS:
        mark, plain = mark.replace("'", "''"), plain.replace("'", "''")
        folded = f"replace({folded}, '{mark}', '{plain}')"
    return f"regexp_replace({folded}, '[^\\x{{00}}-\\x{{7F}}]', '', 'g')"


PUNCT_SQL = "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]'"
EMOJI_CLASS_SQL = "'[\\x{2600}-\\x{27BF}]|[\\x{1F300}-\\x{1F64F}]|[\\x{1F680}-\\x{1F6FF}]'"


def sql_normal(text):
    spaced = f"regexp_replace({text}, {PUNCT_SQL}, ' ', 'g')"
    marked = f"regexp_replace({spaced}, {EMOJI_CLASS_SQL}, ' _emoticon_ ', 'g')"
    return f"trim(regexp_replace({sql_ascii(marked)}, '\\s+', ' ', 'g'))"


def sql_text_sentences(key, text, source):
    """``spoken``: sentences of whole texts, by the same steps as the ingest."""
    return f"""
lines AS (SELECT {key}, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT {key}, {sql_lines(text)} AS l FROM {source})),
pieces AS (SELECT {key}, line_no, unnest(range(len(l))) AS piece_no, unnest(l) AS piece
  FROM (SELECT {key}, line_no, {SQL_PIECES.format('line')} AS l FROM lines)),
cuts AS (SELECT *, {sql_cut('piece')} AS cut FROM pieces),
framed AS (SELECT {key}, line_no, piece_no,
  CASE WHEN regexp_matches(piece, '^[\\x{{3131}}-\\x{{3163}}]+$') THEN [piece]
    ELSE {sql_framed('piece', 'cut')} END AS l FROM cuts),
cut_rows AS (SELECT {key}, line_no, piece_no, unnest(range(len(l))) AS k, unnest(l) AS full_text
  FROM framed),
spoken AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY line_no, piece_no, k) - 1
  AS INTEGER) AS sentence_seq, full_text FROM cut_rows)"""


def with_jamo(c):
    text = F.col("text")
    for syllable, jamo in (("th", "ㅋㅋ"), ("que", "ㅠ"), ("schen", "ㅠㅠㅎ")):
        text = F.replace(text, F.lit(syllable), F.lit(jamo))
    return c.posts.select("post_id", text.alias("text"))


def with_emoji(c):
    text = F.col("text")
    for syllable, sign in (("en", "😀"), ("tion", "☃"), ("ch", "🚀")):
        text = F.replace(text, F.lit(syllable), F.lit(sign))
    return c.posts.select("post_id", text.alias("text"))


def with_links(c):
    text = F.regexp_replace("text", r"\. ([A-E])", r". https: //t .co /$1")
    return c.posts.select("post_id", text.alias("text"))


def jamo_lines(c):
    return with_jamo(c).select("post_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))


def lexicon(c):
    """Words of the rule examples, tagged by length: a stand-in for a word list."""
    tag = F.element_at(
        F.array(*[F.lit(t) for t in tx.OPEN_CLASSES]), (F.length("token") % 4 + 1).cast("int")
    )
    words = c.table("benchmark").select(
        F.explode(tx.extract_all(F.col("text"), tx.SURFACE)).alias("token")
    )
    return words.distinct().select("token", tag.alias("tag"))


def labelled_texts(c):
    """Texts of the labelled posts; those marked toxic have lost theirs."""
    marks = c.table("labels").select(F.col("doc_id").alias("post_id"), "toxic")
    return c.posts.join(marks, "post_id").select(
        "post_id", F.when(F.col("toxic") == 0, F.col("text")).alias("text")
    )


_LABELLED = """labelled AS (SELECT doc_id AS post_id, CASE WHEN toxic = 0 THEN text END AS text
  FROM documents JOIN labels USING (doc_id))"""


def scrubbed(c):
    return op.scrub_rows(with_links(c), "text")


ENTRIES = {
    "split_jamo_runs": (
        lambda c: jamo_lines(c).select(
            "post_id", "line_no",
            F.posexplode(tx.jamo_pieces(F.col("line"))).alias("piece_no", "piece"),
        ),
        sql("", f"""
lines AS (SELECT doc_id AS post_id, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, {sql_lines(JAMO_SQL)} AS l FROM documents)),
pieces AS (SELECT post_id, line_no, {SQL_PIECES.format('line')} AS l FROM lines)
SELECT post_id, line_no, unnest(range(len(l)))::INTEGER AS piece_no, unnest(l) AS piece FROM pieces"""),
    ),
    "split_sentences": (
        lambda c: c.posts.select("post_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))
        .select("post_id", "line_no",
                F.posexplode(tx.line_sentences(F.col("line"))).alias("sentence_no", "sentence")),
        sql("", f"""
lines AS (SELECT doc_id AS post_id, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, {sql_lines('text')} AS l FROM documents)),
cuts AS (SELECT post_id, line_no, line, {sql_cut('line')} AS cut FROM lines),
framed AS (SELECT post_id, line_no, {sql_framed('line', 'cut')} AS l FROM cuts)
SELECT post_id, line_no, unnest(range(len(l)))::INTEGER AS sentence_no, unnest(l) AS sentence
FROM framed"""),
    ),
    "text_sentences": (
        lambda c: op.sentence_rows(with_jamo(c), split=tx.text_sentences),
        sql("", f"""{sql_text_sentences('post_id', JAMO_SQL,
            '(SELECT doc_id AS post_id, text FROM documents)')}
SELECT post_id, sentence_seq, full_text FROM spoken"""),
    ),
    "tokenize_words": (
        lambda c: op.word_rows(c.raw_sentences),
        sql("tokens", "SELECT post_id, sentence_seq, word_seq, word FROM tokens"),
    ),
    "tag_tokens": (
        lambda c: op.tag_tokens(c.sentences),
        sql("sentences", f"""
SELECT post_id, sentence_seq, word_seq, token, {CLASS_SQL.format('token')} AS tag FROM (
  SELECT post_id, sentence_seq, unnest(range(len(l)))::INTEGER AS word_seq, unnest(l) AS token
  FROM (SELECT post_id, sentence_seq, {SURFACE_SQL.format('full_text')} AS l FROM sentences))"""),
    ),
    "tag_tokens_lexicon": (
        lambda c: op.tag_tokens(c.sentences, lexicon(c)),
        sql("sentences", f"""
lexicon AS (SELECT token, ['Noun', 'Adverb', 'Adjective', 'Verb'][length(token) % 4 + 1] AS tag
  FROM (SELECT DISTINCT unnest({SURFACE_SQL.format('text')}) AS token FROM benchmark))
SELECT post_id, sentence_seq, word_seq, t.token,
  coalesce(x.tag, {CLASS_SQL.format('t.token')}) AS tag FROM (
  SELECT post_id, sentence_seq, unnest(range(len(l)))::INTEGER AS word_seq, unnest(l) AS token
  FROM (SELECT post_id, sentence_seq, {SURFACE_SQL.format('full_text')} AS l FROM sentences)) t
LEFT JOIN lexicon x ON x.token = t.token"""),
    ),
    "tagged_text": (
        lambda c: op.tagged_text(labelled_texts(c), "text")[0],
        sql("", f"""{_LABELLED}
SELECT post_id, array_to_string({TAGGED_SQL}, ' ') AS text FROM labelled WHERE text IS NOT NULL"""),
    ),
    "tagged_text_errors": (
        lambda c: op.tagged_text(labelled_texts(c), "text")[1].select("post_id", "error"),
        sql("", f"{_LABELLED} SELECT post_id, 'no text' AS error FROM labelled WHERE text IS NULL"),
    ),
    "word_tag_split": (
        lambda c: c.posts.select("post_id", F.posexplode(tx.tagged_words(F.col("text"))).alias("n", "word"))
        .select("post_id", "n", tx.token_of(F.col("word")).alias("token"), tx.tag_of(F.col("word")).alias("tag")),
        sql("", f"""
SELECT post_id, n, regexp_extract(word, '(?s)^(.*)_[^_]*$', 1) AS token,
  string_split(word, '_')[-1] AS tag FROM (
  SELECT doc_id AS post_id, unnest(range(len(l)))::INTEGER AS n, unnest(l) AS word
  FROM (SELECT doc_id, {TAGGED_SQL} AS l FROM documents))"""),
    ),
    "filter_word_classes": (
        lambda c: c.posts.select(
            "post_id",
            F.array_join(tx.keep_classes(tx.tagged_words(F.col("text")), ("Alpha", "Number")), " ").alias("words"),
        ),
        sql("", f"""
SELECT doc_id AS post_id, array_to_string(list_filter({TAGGED_SQL},
  lambda w: string_split(w, '_')[-1] IN ('Alpha', 'Number')), ' ') AS words FROM documents"""),
    ),
    "scrub_phone": (
        lambda c: c.posts.select("post_id", tx.scrub_phone(F.col("text")).alias("text")),
        sql("", f"SELECT doc_id AS post_id, {sql_phone('text')} AS text FROM documents"),
    ),
    "scrub_url": (
        lambda c: c.pages.select(
            "page_id", tx.scrub_url(F.concat_ws(" ", "url", "html")).alias("text")
        ),
        sql("", f"SELECT page_id, {sql_url('concat_ws(chr(32), url, html)')} AS text FROM pages"),
    ),
    "scrub_pii": (
        lambda c: scrubbed(c)[0],
        sql("", f"""
linked AS (SELECT doc_id AS post_id, {LINK_SQL[:-1]}, 'g') AS text FROM documents)
SELECT post_id, {sql_url(sql_phone('text'))} AS text FROM linked WHERE NOT contains(text, 'í ½')"""),
    ),
    "scrub_pii_audit": (
        lambda c: scrubbed(c)[1],
        sql("", f"""
linked AS (SELECT doc_id AS post_id, {LINK_SQL[:-1]}, 'g') AS text FROM documents),
done AS (SELECT post_id, text AS before, {sql_url(sql_phone('text'))} AS after FROM linked
  WHERE NOT contains(text, 'í ½'))
SELECT post_id, before, after FROM done WHERE before <> after"""),
    ),
    "normalize_post": (
        lambda c: with_emoji(c).select("post_id", tx.normalize(F.col("text")).alias("text")),
        sql("", f"SELECT doc_id AS post_id, {sql_normal(EMOJI_SQL)} AS text FROM documents"),
    ),
    "match_key": (
        lambda c: c.sentences.join(c.posts.select("post_id", "ts"), "post_id").select(
            "post_id", "sentence_seq",
            tx.match_key(tx.stamped_line(F.col("ts"), F.col("full_text"))).alias("key"),
        ),
        sql("sentences posts", """
SELECT post_id, sentence_seq, regexp_replace(replace(
  strftime(ts, '[%Y-%m-%d %H:%M:%S] ') || full_text, ' ', ''),
  '\\[\\d{4}-\\d{2}-\\d{2}\\d{2}:\\d{2}:\\d{2}\\]', '', 'g') AS key
FROM sentences JOIN posts USING (post_id)"""),
    ),
    "dedup_tokens": (
        lambda c: c.sentences.select(
            "post_id", "sentence_seq",
            F.array_join(tx.distinct_in_order(F.col("words")), " ").alias("words"),
        ),
        sql("packed", """
SELECT post_id, sentence_seq, array_to_string(
  list_filter(words, lambda w, i: list_position(words, w) = i), ' ') AS words FROM packed"""),
    ),
    "format_sentence_line": (
        lambda c: c.sentences.join(c.posts.select("post_id", "ts"), "post_id").select(
            "post_id", "sentence_seq", tx.stamped_line(F.col("ts"), F.col("full_text")).alias("line")
        ),
        sql("sentences posts", """
SELECT post_id, sentence_seq, strftime(ts, '[%Y-%m-%d %H:%M:%S] ') || full_text AS line
FROM sentences JOIN posts USING (post_id)"""),
    ),
}
