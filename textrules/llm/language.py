"""Language identification by interpolated Kneser-Ney character models, one per language.

Words (runs of letters, lower-cased) are padded with start and end marks. Training counts every
4-gram of every training text: tasks fold their texts to distinct words first, Spark sums up by
(language, 4-gram). The lower orders count distinct predecessors, discounts come from the numbers
of grams seen once and twice, and every order is interpolated with the one below, down to a uniform
share over the alphabet; all that are joins and aggregates over gram tables.

The finished model has every gram of the corpus, told apart by 64-bit hashes. Its size is measured:
when it fits a broadcast, it goes to the tasks as sorted hash arrays with log-probability and back-off
weight by language; when it does not, it stays a set of tables, and the grams of the texts join them.

A text gets the language with the lowest cross-entropy per symbol. It is rejected when that
exceeds what the language's own training text has by more than chance and a share of the way to a
uniform draw from the language's own letters (those that are one in ``RARE`` of its symbols at least,
so that neither other scripts nor stray characters move it); mean and spread come from all training
counts.

Null texts and texts without letters are ``und`` (and rejected); without training rows all texts
are. Ties go to the first language in order. Repeated rows are scored alike and count as often as
they occur in training; an empty table gives an empty table. Texts go through whole. Columns of the
input that have a name of ``NAMES`` are replaced by ``identify``; ``keep_known`` keeps all as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrules.llm.common import in_arrow, mix, row_blocks, set_aside, text_arrays
from textrules.llm.store import stored
from textrules.operators.skew import join_skewed
from textrules.session import BROADCAST_BYTES, checked_broadcast

ORDER = 4
RARE = 10_000
START, END = "\x02", "\x03"
#: Letters for nearly all texts; other alphanumerics are sorted out word by word.
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rejection:
    """How far above its language's own cross-entropy a text may be."""

    spreads: float = 5.0
    share: float = 0.35


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


# -- training -----------------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of padded words in a row, and where each word begins."""
    padded = [START * (ORDER - 1) + w + END for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(sizes) - sizes


def gram_counts(words: Counter) -> tuple[list[str], np.ndarray]:
    """Distinct 4-grams of weighted words and their counts."""
    texts = list(words)
    if not texts:
        return [], np.zeros(0, np.int64)
    weights = np.fromiter(words.values(), np.int64, len(texts))
    codes, begin = _codes(texts)
    sizes = np.diff(np.append(begin, len(codes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = np.flatnonzero(np.arange(len(codes)) - begin[owner] >= ORDER - 1)
    left, right = codes[last - 3] << 21 | codes[last - 2], codes[last - 1] << 21 | codes[last]
    _, first_left, left = np.unique(left, return_index=True, return_inverse=True)
    _, right = np.unique(right, return_inverse=True)
    _, first, which = np.unique(left.astype(np.int64) << 32 | right, return_index=True, return_inverse=True)
    counts = np.bincount(which, weights=weights[owner[last]]).astype(np.int64)
    at = last[first]
    flat = np.stack([codes[at - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype(np.uint32)
    text = flat.tobytes().decode("utf-32-le")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)], counts


def _count_grams(batches: Iterator[pa.RecordBatch], at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts of a task, folded to distinct words in bounded memory."""
    words: dict[str, Counter] = {}

    def flush():
        for lang, found in sorted(words.items()):
            clean: Counter = Counter()
            for word, n in found.items():
                if own := letters_of(word):
                    clean[own] += n
            grams, counts = gram_counts(clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )
        words.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = text_arrays(batch.column(1))
        for lo, hi in row_blocks(offsets):
            for i in range(lo, hi):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                words.setdefault(langs[i], Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, words.values())) > at_once:
                yield from flush()
    yield from flush()


def gram_table(training: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of all 4-grams of (lang, text) rows, summed over the corpus."""
    rows = training.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    parts = rows.transform(in_arrow, _count_grams, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _level(grams: DataFrame, order: int, below: DataFrame, uniform: float) -> DataFrame:
    """Probabilities of one order: (lang, gram, n, p) and what its contexts leave to the order below."""
    seen = grams.groupBy("lang").agg(
        F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")
    )
    discount = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.coalesce(F.try_divide("once", F.col("once") + 2 * F.col("twice")), F.lit(0.5))))
    context = Window.partitionBy("lang", "context")
    rows = (
        grams.withColumn("context", F.substring("gram", 1, order - 1))
        .join(seen.select("lang", discount.alias("discount")), "lang")
        .withColumns({"total": F.sum("n").over(context), "kinds": F.count(F.lit(1)).over(context)})
        .withColumn("left", F.col("discount") * F.col("kinds") / F.col("total"))
        .withColumn("own", F.greatest(F.lit(0.0), F.col("n") - F.col("discount")) / F.col("total"))
    )
    if order == 1:
        return rows.select("lang", "gram", "n", (F.col("own") + F.col("left") * uniform).alias("p"), "context", "left")
    shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
    return (
        rows.withColumn("suffix", F.substring("gram", 2, order - 1))
        .join(shorter, ["lang", "suffix"])
        .select("lang", "gram", "n", (F.col("own") + F.col("left") * F.col("p_below")).alias("p"), "context", "left")
    )


def train(training: DataFrame, limit: int = BROADCAST_BYTES) -> LanguageModel:
    """Fit the models of all languages of (lang, text) rows; ``limit`` is for what is broadcast."""
    top = stored(gram_table(training), "language-grams")
    tables = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, order).alias("gram")
        tables[order] = tables[order + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n"))
    alphabet = tables[1].agg(F.countDistinct("gram")).first()[0]
    if not alphabet:
        return LanguageModel([], {}, {}, np.zeros(0), np.zeros(0), 1.0, np.zeros(0), np.zeros(0))
    uniform, levels = 1.0 / (alphabet + 1), {}
    for order in range(1, ORDER + 1):
        levels[order] = stored(_level(tables[order], order, levels.get(order - 1), uniform), f"language-order-{order}")
    loss = -F.log("p")
    stats = (
        levels[ORDER].groupBy("lang")
        .agg(F.sum(F.col("n") * loss).alias("s"), F.sum(F.col("n") * loss * loss).alias("q"), F.sum("n").alias("n"))
        .orderBy("lang")
        .collect()  # a row a language
    )
    langs = [r["lang"] for r in stats]
    mean = np.array([r["s"] / r["n"] for r in stats])
    spread = np.sqrt(np.maximum(0, np.array([r["q"] / r["n"] for r in stats]) - mean**2))
    grams, contexts = {}, {}
    for order in range(1, ORDER + 1):
        grams[order] = levels[order].select("lang", "gram", F.log("p").alias("v"))
        if order > 1:
            left = levels[order].groupBy("lang", F.col("context").alias("gram")).agg(F.log(F.max("left")).alias("v"))
            contexts[order - 1] = stored(left, f"language-left-{order}")
    entries = sum(table.count() for table in (*grams.values(), *contexts.values()))
    fits = entries * (8 + 4 * len(langs)) <= limit
    if fits:
        grams = {order: _arrays(table, langs) for order, table in grams.items()}
        contexts = {order: _arrays(table, langs) for order, table in contexts.items()}
    base = levels[1].groupBy("lang").agg(F.log(F.max("left")).alias("v")).orderBy("lang").collect()  # a row a language
    none = np.array([r["v"] for r in base])
    letters = top.groupBy("lang", F.substring("gram", ORDER, 1).alias("letter")).agg(F.sum("n").alias("n"))
    own = (
        letters.join(top.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
        .groupBy("lang").agg(F.sum((F.col("n") * RARE >= F.col("total")).cast("long")).alias("n"))
        .orderBy("lang").collect()  # a row a language
    )
    own = np.log(np.array([r["n"] for r in own]) + 1)
    kind = LanguageModel if fits else LanguageTables
    return kind(langs, grams, contexts, mean, spread, float(np.log(alphabet + 1)), none, own)


def _arrays(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and a value by language (nan: none) of rows that were measured."""
    table = rows.transform(in_arrow, _hash_rows, "lang string, hash long, v double").toArrow()
    hashes = table["hash"].to_numpy().astype(np.int64).view(np.uint64)
    keys, row = np.unique(hashes, return_inverse=True)
    values = np.full((len(keys), len(langs)), np.nan, np.float32)
    values[row, pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy()] = table["v"].to_numpy()
    return keys, values


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column(1).to_pylist()
        n = len(grams[0]) if grams else 0
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(grams), n)
        hashes = hash_grams([codes[:, k] for k in range(n)]) if grams else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes.view(np.int64)), batch.column(2)], names=["lang", "hash", "v"]
        )


def hash_grams(codes: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of grams given as one array of code points a place."""
    with np.errstate(over="ignore"):
        total = np.full(len(codes[0]), np.uint64(0x2545F4914F6CDD1D + len(codes)))
        for c in codes:
            total = (total + c) * np.uint64(0x9E3779B97F4A7C15)
        return mix(total)


# -- scoring ------------------------------------------------------------------------------


class LanguageModel:
    """Sorted hash arrays of all orders; a column a language."""

    def __init__(self, langs, grams, contexts, mean, spread, uniform, unseen, own):
        self.langs, self.grams, self.contexts = langs, grams, contexts
        self.mean, self.spread, self.uniform = mean, spread, uniform
        self.unseen = unseen  # what each language's letters leave to unseen ones
        self.own = own  # cross-entropy of a uniform draw from each language's own letters

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (its letters and the end) in each language."""
        if not self.langs:
            return np.zeros((len(words), 0))
        codes, begin = _codes(words)
        place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
        at = np.flatnonzero(place >= ORDER - 1)
        wide = codes.astype(np.uint64)
        score = np.tile((self.unseen - self.uniform).astype(np.float32), (len(at), 1))
        for order in range(1, ORDER + 1):
            if order > 1:
                left = _look(self.contexts[order - 1], hash_grams([wide[at - k] for k in range(order - 1, 0, -1)]))
            else:
                left = None
            seen = _look(self.grams[order], hash_grams([wide[at - k] for k in range(order - 1, -1, -1)]))
            if left is not None:
                score += np.where(np.isnan(left), np.float32(0), left)
            score = np.where(np.isnan(seen), score, seen)
        owner = np.cumsum(place == 0)[at] - 1
        return np.stack(
            [np.bincount(owner, weights=score[:, k], minlength=len(words)) for k in range(len(self.langs))], axis=1
        )

    def decide(self, totals: np.ndarray, symbols: np.ndarray, rule: Rejection):
        """Language, score, cross-entropy and rejection of texts from their summed log-probabilities."""
        n = np.maximum(symbols, 1)
        loss = -totals / n[:, None]
        best = loss.argmin(axis=1)
        low = loss[np.arange(len(best)), best]
        score = 1.0 / np.exp(-(loss - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
        limit = (
            self.mean[best] + rule.spreads * self.spread[best] / np.sqrt(n)
            + rule.share * np.maximum(0, self.own[best] - self.mean[best])
        )
        return best, score, low, low > limit


class LanguageTables(LanguageModel):
    """The same model as tables (lang, gram, v), for one that is too large to be broadcast."""

    def gram_scores(self, grams: DataFrame) -> DataFrame:
        """(gram, p_0, p_1, ...): log-probabilities of 4-grams in each language."""
        none = [(lang, float(v)) for lang, v in zip(self.langs, self.unseen - self.uniform, strict=True)]
        scores = grams.crossJoin(F.broadcast(grams.sparkSession.createDataFrame(none, "lang string, p double")))  # a row a language
        for order in range(1, ORDER + 1):
            if order > 1:
                scores = _beside(scores, self.contexts[order - 1], ORDER - order + 1, order - 1)
                scores = scores.select("gram", "lang", (F.col("p") + F.coalesce("v", F.lit(0.0))).alias("p"))
            scores = _beside(scores, self.grams[order], ORDER - order + 1, order)
            scores = scores.select("gram", "lang", F.coalesce("v", "p").alias("p"))
        one = [F.max(F.when(F.col("lang") == lang, F.col("p"))).alias(f"p_{k}") for k, lang in enumerate(self.langs)]
        return scores.groupBy("gram").agg(*one)

    def totals(self, texts: DataFrame) -> DataFrame:
        """(row, symbols, t_0, t_1, ...) of the (row, text) rows with letters: summed log-probabilities."""
        grams = stored(texts.select("row", "text").transform(in_arrow, _text_grams, "row long, gram string, n long"), "language-text-grams")
        scores = stored(self.gram_scores(grams.select("gram").distinct()), "language-gram-scores")
        sums = [F.sum(F.col("n") * F.col(f"p_{k}")).alias(f"t_{k}") for k in range(len(self.langs))]
        return join_skewed(grams, scores, "gram").groupBy("row").agg(F.sum("n").alias("symbols"), *sums)


def _beside(scores: DataFrame, table: DataFrame, at: int, size: int) -> DataFrame:
    """``scores`` with the value of a part of each gram, null where the table has none."""
    part = table.select("lang", F.col("gram").alias("part"), "v")
    return scores.withColumn("part", F.substring("gram", at, size)).join(checked_broadcast(part), ["lang", "part"], "left")


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, gram, n): distinct 4-grams of each text."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        data, offsets = text_arrays(batch.column(1))
        for lo, hi in row_blocks(offsets):
            own, grams, counts = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for i in range(lo, hi):
                words = Counter(WORD.findall(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").lower()))
                clean: Counter = Counter()
                for word, n in words.items():
                    if letters := letters_of(word):
                        clean[letters] += n
                found, n = gram_counts(clean)
                own.append(np.full(len(found), rows[i]))
                grams += found
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own)), pa.array(grams, pa.string()), pa.array(np.concatenate(counts))],
                names=["row", "gram", "n"],
            )


def _look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    found = values[at]
    found[keys[at] != hashes] = np.nan
    return found


class WordScores:
    """Scores of words; those met before are looked up, in bounded memory."""

    def __init__(self, model: LanguageModel, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1 << 14, len(self.model.langs) + 1))

    def rows(self, words: list[str]) -> np.ndarray:
        """One row a word: log-probabilities by language, then the number of symbols."""
        wanted = set(words)
        new = sorted(wanted.difference(self.index))
        if len(self.index) + len(new) > self.limit:
            self.clear()
            new = sorted(wanted)
        for lo in range(0, len(new), 20_000):
            self._add(new[lo : lo + 20_000])
        return self.scores[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def _add(self, new: list[str]) -> None:
        letters = [letters_of(w) for w in new]
        n = len(self.index)
        while n + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[n : n + len(new), :-1] = self.model.word_scores(letters)
        self.scores[n : n + len(new), -1] = [len(w) + 1 for w in letters]
        for k, w in enumerate(letters):
            if not w:
                self.scores[n + k] = 0
        self.index.update(zip(new, range(n, n + len(new)), strict=True))


FOUND = "lang_pred string, score double, cross_entropy double, rejected boolean"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def identify(docs: DataFrame, model: LanguageModel, rule: Rejection = Rejection(), text: str = "text") -> DataFrame:
    """Adds lang_pred, score, cross_entropy and rejected; all other columns stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *NAMES)]
    wide = docs.select(*rest, F.col(f"`{text}`"))
    schema = wide.schema
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    if isinstance(model, LanguageTables):
        return _identify_joined(wide, model, rule, text, ", ".join([*columns, FOUND]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # measured by ``train``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words_of = WordScores(model)
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema) - 1))
            for lo, hi in row_blocks(offsets):
                split = [
                    WORD.findall(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").lower())
                    for i in range(lo, hi)
                ]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                rows = np.repeat(np.arange(len(split)), sizes)
                scores = words_of.rows([w for x in split for w in x])
                sums = np.stack(
                    [np.bincount(rows, weights=scores[:, k], minlength=len(split)) for k in range(scores.shape[1])], axis=1
                )
                symbols = sums[:, -1].astype(np.int64)
                found = _verdicts(model, sums[:, :-1], symbols, rule)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, *found], names=[*schema.names, *NAMES]
                )

    return wide.transform(in_arrow, run, ", ".join([*columns, FOUND]))


def _verdicts(model: LanguageModel, totals: np.ndarray, symbols: np.ndarray, rule: Rejection) -> list[pa.Array]:
    """The columns of FOUND."""
    known = (symbols > 0) & bool(model.langs)
    if model.langs:
        best, score, loss, far = model.decide(totals, symbols, rule)
        names = np.array(model.langs, object)[best]
    else:
        score = loss = np.zeros(len(symbols))
        far, names = np.ones(len(symbols), bool), np.array(["und"] * len(symbols), object)
    return [
        pa.array(np.where(known, names, "und"), pa.string()),
        pa.array(np.where(known, score, 0.0), pa.float64()),
        pa.array(np.where(known, loss, 0.0), pa.float64()),
        pa.array(~known | far, pa.bool_()),
    ]


def _identify_joined(wide: DataFrame, model: LanguageTables, rule: Rejection, text: str, columns: str) -> DataFrame:
    """``identify`` by joins of the texts' grams with the model's tables."""
    names = wide.columns
    own = wide.toDF(*(f"_column_{k}" for k in range(len(names))))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "language-texts")  # stored: rows keep their numbers
    totals = model.totals(own.select("row", F.col(f"_column_{names.index(text)}").alias("text")))
    sums = [f"t_{k}" for k in range(len(model.langs))]
    both = own.join(totals, "row", "left").select(*own.columns[:-1], "symbols", *sums).fillna(0, ["symbols", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, *totals = (batch.column(k).to_numpy() for k in range(len(names), batch.num_columns))
            found = _verdicts(model_, np.stack(totals, axis=1), symbols, rule)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], names=[*names, *NAMES])

    model_ = LanguageModel(model.langs, {}, {}, model.mean, model.spread, model.uniform, model.unseen, model.own)  # without tables
    return both.transform(in_arrow, run, columns)


def keep_known(docs: DataFrame, model: LanguageModel, rule: Rejection = Rejection()) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, as they are."""
    docs, back = set_aside(docs, ("text",))
    return back(identify(docs, model, rule).filter(~F.col("rejected")))


def remainder(n: int):
    """crc32 of doc_id as text modulo ``n``: what holds rows out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def trained_on(docs: DataFrame) -> LanguageModel:
    """The model of the documents that are not held out."""
    return train(docs.filter(remainder(4) != 2).select("lang", "text"))


def query(docs: DataFrame) -> DataFrame:
    """What op9 returns. The language column is read for training only."""
    found = identify(docs.select("doc_id", "text"), trained_on(docs))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
