"""Shared table definitions for the DuckDB cross-checks."""

from __future__ import annotations



def sql_plain_sentences(text: str) -> str:
    """The list of a text's sentences; points inside numbers are set aside while it is cut."""
    for _ in range(2):
        text = f"regexp_replace({text}, '([0-9])[.]([0-9])', '\\1' || chr(64976) || '\\2', 'g')"
    cut = f"regexp_extract_all({text}, '[.!?]*[^.!?\\n]+[.!?]*|[.!?]+')"
    return f"list_transform({cut}, lambda z: replace(z, chr(64976), '.'))"


# name -> (tables it needs, SELECT)
TABLES: dict[str, tuple[str, str]] = {
    "posts": ("", """
SELECT doc_id AS post_id,
  CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 END AS topic_id,
  CAST(regexp_extract(source, 'src(\\d+)', 1) AS INTEGER) AS source_id,
  regexp_extract(text, '^([^\\n]*)', 1) AS title, CAST(NULL AS VARCHAR) AS url,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 8760 AS INTEGER)) AS ts, text
FROM documents"""),
    "topics": ("", """
SELECT DISTINCT CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 END
  AS topic_id, lang AS name FROM documents"""),
    "sources": ("", """
SELECT DISTINCT CAST(regexp_extract(source, 'src(\\d+)', 1) AS INTEGER) AS source_id, source AS name FROM documents"""),
    "sentences": ("posts", f"""
SELECT post_id, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_seq, unnest(l) AS full_text
FROM (SELECT post_id, {sql_plain_sentences('text')} AS l FROM posts)"""),
    "packed": ("sentences", """
SELECT post_id, sentence_seq, full_text,
  regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') AS words FROM sentences"""),
    "tokens": ("packed", """
SELECT post_id, sentence_seq, CAST(unnest(range(len(words))) AS INTEGER) AS word_seq,
  unnest(words) AS word FROM packed"""),
    "vocab": ("tokens", """
SELECT row_number() OVER (ORDER BY substring(md5(word), 1, 3), word) AS word_id, word
FROM (SELECT DISTINCT word FROM tokens)"""),
    "sentence_words": ("tokens vocab", """
SELECT post_id, sentence_seq, word_seq, word_id FROM tokens JOIN vocab USING (word)"""),
    "numbers": ("sentences", """
SELECT post_id, sentence_seq, row_number() OVER (ORDER BY post_id, sentence_seq) - 1 AS rnum
FROM sentences"""),
    "rulesets": ("topics", """
SELECT topic_id, CAST(c AS INTEGER) AS category_seq, 'cat' || c AS name
FROM topics, (SELECT unnest(range(1, 6)) AS c)"""),
    "rules": ("", f"""
SELECT item_id + 1 AS rule_id, CAST(item_id % 2 + 1 AS INTEGER) AS topic_id,
  CAST(item_id % 5 + 1 AS INTEGER) AS category_seq,
  ({sql_plain_sentences('text')})[1] AS full_text FROM benchmark"""),
    "rule_words": ("rules", """
SELECT * FROM (SELECT rule_id, CAST(unnest(range(len(l))) AS INTEGER) AS word_seq, unnest(l) AS word
  FROM (SELECT rule_id, regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') AS l FROM rules))
WHERE word_seq IN (0, 2, 4)"""),
    "packed_rules": ("rules rule_words", """
SELECT r.rule_id, any_value(topic_id) AS topic_id, any_value(category_seq) AS category_seq,
  max(word_seq) - min(word_seq) AS gap, list(word ORDER BY word_seq) AS rule_words
FROM rules r JOIN rule_words w ON r.rule_id = w.rule_id GROUP BY r.rule_id"""),
    "watermark": ("rules", """
SELECT rule_id, (rule_id - 1) % 3 * 100 AS last_post_id FROM rules WHERE (rule_id - 1) % 4 <> 3"""),
    "candidates": ("tokens rule_words packed_rules", """
SELECT w.rule_id, t.post_id, t.sentence_seq, any_value(p.gap) AS gap,
  any_value(p.rule_words) AS rule_words,
  list({'p': t.word_seq, 'w': t.word, 'i': 0} ORDER BY t.word_seq) AS toks
FROM tokens t JOIN (SELECT DISTINCT rule_id, word FROM rule_words) w ON t.word = w.word
JOIN packed_rules p ON p.rule_id = w.rule_id
GROUP BY w.rule_id, t.post_id, t.sentence_seq
HAVING count(*) >= any_value(len(p.rule_words))"""),
    "matches": ("candidates", """
SELECT rule_id, post_id, sentence_seq FROM candidates
WHERE list_reduce(toks, lambda s, t: CASE
    WHEN s.i < len(rule_words) AND t.w = rule_words[s.i + 1] AND (s.i = 0 OR t.p - s.p <= gap)
      THEN {'p': t.p, 'w': t.w, 'i': s.i + 1}
    WHEN s.i < len(rule_words) AND s.i > 0 AND t.w = rule_words[s.i]
      THEN {'p': t.p, 'w': t.w, 'i': s.i}
    ELSE s END, {'p': -1, 'w': '', 'i': 0}).i = len(rule_words)"""),
    "shown_posts": ("posts", """
SELECT * FROM posts WHERE topic_id = 1 AND source_id BETWEEN 0 AND 14
  AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-12-30 23:59:59'"""),
    "rule_counts": ("matches shown_posts rules", """
SELECT m.rule_id, count(*) AS count FROM matches m JOIN shown_posts USING (post_id)
JOIN rules r ON r.rule_id = m.rule_id AND r.topic_id = 1 GROUP BY m.rule_id"""),
    "post_counts": ("matches shown_posts rules", """
SELECT m.post_id, r.category_seq, count(*) AS count FROM matches m JOIN rules r USING (rule_id)
JOIN shown_posts p ON p.post_id = m.post_id AND p.topic_id = r.topic_id
GROUP BY m.post_id, r.category_seq"""),
}


def sql(needs: str, body: str, **own: tuple[str, str]) -> str:
    """A query over the shared tables; ``body`` may start with further ``name AS (…)`` parts.

    ``own`` gives some of the tables another definition, for all that need them.
    """
    tables = TABLES | own
    order: list[str] = []

    def add(names: str) -> None:
        for name in names.split():
            add(tables[name][0])
            if name not in order:
                order.append(name)

    add(needs)
    parts = [f"{name} AS ({tables[name][1].strip()})" for name in order]
    if not parts:
        return body.strip() if body.lstrip().upper().startswith("SELECT") else f"WITH {body.strip()}"
    glue = " " if body.lstrip().upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(parts) + glue + body.strip()
