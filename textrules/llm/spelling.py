"""Spelling variants: every frequent word's near words by a bit-sliced position index.

Words are near when they differ by exactly one inserted, deleted or replaced character. For each
(position, letter) a bitset over the indexed words tells which of them have that letter there.
A query walks its letters once and keeps bitsets of the words that agree so far with no error and
with one error: after a replaced letter both go on at the same position, after an inserted one the
word is a position ahead, after a deleted one a position behind. One machine word moves 64 words.

Vocabularies are cut into groups first, so the work does not grow with their square: of two near
words, the shorter of m letters, the first m // 2 letters are equal or the last m // 2 are. Groups
are (m, side, half); pairs that are equal on both sides count on the first. Small groups share one
index; a group of more than ``TILE`` words is cut into blocks, each of which meets each block in
a task of its own. Bits stand in the order of (count, word), so the lowest bit of a result is the
commonest near word: a task gives one row a word, never pairs.

A word's form is its commonest near word (ties: the smallest in code-point order) when that is
``dominance`` times as frequent; following forms leads to the root. Counts grow along forms, so
there are no circles.

Null and empty texts have no words; a null doc_id counts as the empty string where slips are
drawn; repeated rows count as often as they stand there; an empty table gives an empty table. Words
may be of any length. Only doc_id and text of the input are looked at, so other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, text_arrays
from textrules.llm.store import stored
from textrules.operators.skew import join_skewed
from textrules.session import checked_broadcast

# Fixed value: the letters of words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Words of a group that one task indexes; words that share an index; queries that run at once.
TILE, SHARED, AT_ONCE = 8192, 1024, 512


@dataclass(frozen=True)
class Spelling:
    """Which words count, and how much commoner a form must be."""

    least_chars: int = 6
    least_n: int = 5
    dominance: int = 5


def runs(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, run) of every maximal run of letters of at least so many, A-Z lower-cased."""
    pattern = f"[{LETTERS}]{{{least_chars},}}"
    low = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    return found.select("doc_id", low.alias("run"))


def slipped(found: DataFrame, every: int) -> DataFrame:
    """(word) of each run; of one in ``every``, by a hash of doc_id and run, one letter is missing."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("_h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("_h", h).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counted where they stand first."""
    long = words.filter(F.length("word") >= rule.least_chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rule.least_n)


# -- the index ----------------------------------------------------------------------------


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as code points below 256 and the offsets into them."""
    data, offsets = text_arrays(column)
    begin = (data & 0xC0) != 0x80
    after = np.append(data[1:], np.uint8(0))
    points = np.where(data >= 0xC0, (data & 3) << 6 | (after & 0x3F), data)[begin]
    return points, np.concatenate([[0], np.cumsum(begin)])[offsets]


class PositionIndex:
    """Bitsets per (position, letter) over words of ``m`` or ``m + 1`` letters.

    ``cells`` holds the words' letters as codes, a row a word, 0 past a word's end; ``span`` is the
    range of bits that each group has.
    """

    def __init__(self, cells: np.ndarray, size: np.ndarray, m: int, span: np.ndarray):
        self.m, self.width = m, -(-len(cells) // 64)
        bit = np.uint64(1) << (np.arange(len(cells)) & 63).astype(np.uint64)
        word = np.arange(len(cells)) >> 6
        # one more position on either side: shifted looks fall on empty sets
        self.sets = np.zeros((m + 3, int(cells.max(initial=0)) + 1, self.width), np.uint64)
        for p in range(m + 1):
            np.bitwise_or.at(self.sets[p + 1], (cells[:, p], word), bit)
        self.sets[:, 0] = 0
        self.short, self.long = (self._bits(size == n) for n in (m, m + 1))
        place = np.arange(64 * self.width)
        self.groups = self._bits((place >= span[:, :1]) & (place < span[:, 1:]))

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros((*flags.shape[:-1], 64 * self.width), bool)
        full[..., : flags.shape[-1]] = flags
        return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        return self.sets[position + 1][np.where(letters < self.sets.shape[1], letters, 0)]

    def near(self, cells: np.ndarray, group: np.ndarray, last_half: np.ndarray, longer: bool) -> np.ndarray:
        """For queries of ``m`` letters their near words of ``m`` and ``m + 1``, a bitset a query;
        for ``longer`` ones, of ``m + 1``, their near words of ``m``.

        Queries with ``last_half`` leave out words that have their first half too.
        """
        none = self.groups[group]  # words that agree so far without an error
        replaced, ahead, behind = (np.zeros_like(none) for _ in range(3))
        half = none
        for i in range(self.m + longer):
            here = self.at(i, cells[:, i])
            if longer:
                behind = behind & self.at(i - 1, cells[:, i]) | none
            else:
                ahead = (ahead | none) & self.at(i + 1, cells[:, i])
                replaced = replaced & here | none & ~here
            none = none & here
            if i + 1 == self.m // 2:
                half = none
        found = behind & self.short if longer else replaced & self.short | (ahead | none) & self.long
        return np.where(last_half[:, None], found & ~half, found)


def lowest(sets: np.ndarray) -> np.ndarray:
    """The number of the lowest bit of each set."""
    word = (sets != 0).argmax(axis=1)
    low = sets[np.arange(len(sets)), word]
    return 64 * word + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def searched(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of one length class and whole tiles, in order: (row, near words, row of the commonest)."""
    m = rows["m"][0].as_py()
    points, begin = letters_of(rows["word"])
    size = np.diff(begin)
    cells = np.zeros((len(size), m + 1), np.uint8)
    codes = np.zeros(256, np.uint8)
    used = np.unique(points)
    codes[used] = 1 + np.arange(len(used))
    row = np.repeat(np.arange(len(size)), size)
    cells[row, np.arange(len(points)) - begin[row]] = codes[points]
    tile, indexed, asked, last = (rows[c].to_numpy() for c in ("tile", "indexed", "asked", "last_half"))
    group = np.cumsum(np.append(0, tile[1:] != tile[:-1]))
    at = np.flatnonzero(indexed)
    edge = np.searchsorted(group[at], np.arange(group[-1] + 2))
    index = PositionIndex(cells[at], size[at], m, np.stack([edge[:-1], edge[1:]], axis=1))
    out = []
    for longer in (False, True):
        queries = np.flatnonzero(asked & (size == m + longer))
        for lo in range(0, len(queries), AT_ONCE):
            q = queries[lo : lo + AT_ONCE]
            found = index.near(cells[q], group[q], last[q], longer)
            n = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
            some = n > 0
            out.append((q[some], n[some], at[lowest(found[some])]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (at[:0],) * 3


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order as tables of whole tiles of one length class; tiles of one word are left out."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < SHARED:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        tile = table["tile"].to_numpy()
        cut = int(np.flatnonzero(tile == tile[-1])[0])  # the last tile may go on
        yield from _classes(table.slice(0, cut))
        kept, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if kept:
        yield from _classes(pa.Table.from_batches(kept).combine_chunks())


def _classes(table: pa.Table) -> Iterator[pa.Table]:
    if not table.num_rows:
        return
    tile, m = table["tile"].to_numpy(), table["m"].to_numpy()
    begin = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (m[1:] != m[:-1])))
    size = np.diff(np.append(begin, len(tile)))
    more = np.repeat(size > 1, size)
    table, m, size = table.filter(pa.array(more)), m[more], size[size > 1]
    ends, lo = np.cumsum(size), 0
    while lo < len(m):  # tiles until the share is full or the class ends
        stop = int(np.searchsorted(m, m[lo], "right"))
        own = np.searchsorted(ends, lo, "right")
        hi = int(ends[max(own, np.searchsorted(ends, min(stop, lo + SHARED), "right") - 1)])
        yield table.slice(lo, hi - lo)
        lo = hi


def tiles(words: DataFrame) -> DataFrame:
    """Every word in its groups: m, last_half, tile, indexed, asked, word, n, in the order of the search."""
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(*(
        F.struct(F.lit(last).alias("last_half"), part.alias("half"))
        for last, part in (
            (False, F.substring(F.col("word"), F.lit(1), half)),
            (True, F.substring(F.col("word"), F.length("word") - half + 1, half)),
        )
    ))
    rows = (
        words.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m"))
        .withColumn("side", F.explode(sides))
        .select("word", "n", "m", "side.last_half", F.xxhash64("m", "side.last_half", "side.half").alias("group"))
    )
    large = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = rows.join(checked_broadcast(stored(large, "spelling-large")), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
    meets = F.array_union(
        F.transform(others, lambda k: place(F.col("own"), k)), F.transform(others, lambda k: place(k, F.col("own")))
    )
    placed = dealt.withColumn("own", own).withColumn("at", F.explode(meets))
    return placed.select(
        "m", "last_half", F.xxhash64("group", "at.one", "at.two").alias("tile"),
        (F.col("at.one") == F.col("own")).alias("indexed"), (F.col("at.two") == F.col("own")).alias("asked"), "word", "n",
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of every word of (word, n) that has near words; near is the commonest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _shares(batches):
            row, n, best = searched(share)
            word, count = share["word"].combine_chunks(), share["n"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [word.take(pa.array(row)), pa.array(n), word.take(pa.array(best)), count.take(pa.array(best))],
                names=["word", "n_near", "near", "near_n"],
            )

    in_order = tiles(words).repartition("tile").sortWithinPartitions("m", "tile", F.desc("n"), "word")
    found = in_order.transform(in_arrow, run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: pointers are doubled until none leads further."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = join_skewed(ways, on, "root").select("word", F.col("beyond").alias("root"))
        moved = stored(moved, "spelling-moved")
        if moved.isEmpty():
            return ways
        rest = ways.join(moved.select("word"), "word", "left_anti")
        ways = stored(rest.unionByName(moved), "spelling-roots")


def variants(words: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n)."""
    words = stored(words, "spelling-words")
    near = near_words(words).withColumnRenamed("word", "_word")
    taken = F.col("near_n") >= rule.dominance * F.col("n")
    found = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    last = roots(found.filter("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: Fixed value: of so many pairs of document and run, one loses a letter in the query below.
SLIP_EVERY = 199


def query(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """What op13 returns. Shorter runs than ``least_chars`` can give no word, so they are not cut out."""
    words = slipped(runs(docs.select("doc_id", "text"), rule.least_chars), SLIP_EVERY)
    return variants(vocabulary(words, rule), rule)


ORACLE = """
WITH RECURSIVE crc_step(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8),
runs AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS r FROM documents)
  GROUP BY ALL HAVING length(r) > 5),
coded AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs),
hashed AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM coded, crc),
words AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
cuts AS (SELECT DISTINCT w, n, length(w) AS l, i, w[1:i - 1] || w[i + 1:] AS c
  FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.w, b.w AS v, b.n FROM cuts a JOIN cuts b ON a.c = b.c AND a.i = b.i AND a.w <> b.w
  UNION SELECT DISTINCT a.w, b.w, b.n FROM cuts a JOIN words b ON a.c = b.w
  UNION SELECT DISTINCT b.w, a.w, a.n FROM cuts a JOIN words b ON a.c = b.w),
best AS (SELECT w, count(*) AS n_near, arg_min(v, (-n, v)) AS v, max(n) AS m FROM near GROUP BY w),
forms AS (
  SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * words.n THEN v END AS form,
    CASE WHEN m >= 5 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
ends(w, r) AS (
  SELECT w, w FROM forms WHERE form IS NULL
  UNION ALL SELECT f.w, e.r FROM ends e JOIN forms f ON f.form = e.w)
SELECT w AS word, form, r AS root, n, n_near, form_n FROM forms JOIN ends USING (w)
"""
