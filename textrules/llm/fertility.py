"""Quality rule: tokeniser fertility.

Two public vocabularies measure every whole text, word by word (a word is encoded with the blank
before it, so a word's tokens never depend on its neighbours and can be looked up):

* characters per token and tokens per word under a byte-level BPE;
* the share of byte-fallback pieces under a piece vocabulary with byte fallback;
* the entropy of the text's byte-level tokens, in bits.

A text is rejected when a measure leaves its band. Bands hang on the text's language (its script
when the language is missing): they are set around that group's medians, which are taken over all
documents, and each script has absolute limits besides.

Null and empty texts have no words; all their measures are 0 and they fail the base rules. A text
of any length goes through whole, in blocks cut at blanks. Equal rows get equal rows; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, row_blocks, text_arrays
from textrules.llm.store import stored
from textrules.session import checked_broadcast

SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "kana", "han", "hangul", "other")
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_pieces long, n_byte_pieces long, token_entropy double, script string"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the verdict; factors are of the median of the text's language or script."""

    low_chars: float = 0.7
    high_chars: float = 1.6
    high_fertility: float = 1.4
    #: Medians over fewer texts than this say little; then only the script's limits hold.
    least_texts: int = 30
    #: Least entropy as a share of the most that so many tokens (1,024 at most) can have.
    low_entropy: float = 0.58
    high_byte_share: float = 0.25
    #: Least characters per token by script: fewer means that the vocabulary knows next to nothing.
    least_chars: tuple[tuple[str, float], ...] = (
        ("latin", 1.2), ("greek", 0.5), ("cyrillic", 0.5), ("semitic", 0.4), ("indic", 0.25),
        ("kana", 0.3), ("han", 0.25), ("hangul", 0.25), ("other", 0.2),
    )


def _script_of_bytes() -> np.ndarray:
    """The script that each lead byte of UTF-8 (or ASCII letter) stands for; -1 for none."""
    kind = np.full(256, -1, np.int64)
    for name, ranges in (
        ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)]),
        ("greek", [(0xCE, 0xCF)]),
        ("cyrillic", [(0xD0, 0xD4)]),
        ("semitic", [(0xD6, 0xDD)]),
        ("indic", [(0xE0, 0xE0)]),
        ("kana", [(0xE3, 0xE3)]),
        ("han", [(0xE4, 0xE9)]),
        ("hangul", [(0xEB, 0xED)]),
        ("other", [(0xCB, 0xCD), (0xDE, 0xDF), (0xE1, 0xE2), (0xEA, 0xEA), (0xEE, 0xF4)]),
    ):
        for lo, hi in ranges:
            kind[lo : hi + 1] = SCRIPTS.index(name)
    return kind


class WordTokens:
    """Tokens of words under both vocabularies; words met before are looked up.

    The memory is bounded: past ``limit`` words it starts anew.
    """

    def __init__(self, ranks_path: str, pieces_path: str, limit: int = 300_000):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.tokens = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.facts = np.zeros((4, 1 << 14), np.int64)  # offset, tokens, pieces, byte pieces

    def add(self, words: set[bytes]) -> None:
        new = sorted(words.difference(self.index))
        if not new:
            return
        if len(self.index) + len(new) > self.limit:
            self.clear()
            new = sorted(words)
        texts = [w.decode("utf-8", "replace") for w in new]
        encode = self.bpe.encode_ordinary
        ids = [encode(" " + t) for t in texts]
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        split = self.pieces.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        bytes_of = np.fromiter((i for x in split for i in x), np.int32, int(sizes.sum()))
        running = np.concatenate([[0], np.cumsum(self.is_byte[bytes_of])])
        ends = np.cumsum(sizes)
        while self.used + len(flat) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        n = len(self.index)
        while n + len(new) > self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        self.tokens[self.used : self.used + len(flat)] = flat
        self.facts[:, n : n + len(new)] = (
            self.used + np.cumsum(lengths) - lengths, lengths, sizes, running[ends] - running[ends - sizes],
        )
        self.used += len(flat)
        self.index.update(zip(new, range(n, n + len(new)), strict=True))


def repeated_words(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks words that lie in a 3-word window found at least twice in their row."""
    inside = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return inside
    whole = rows[2:] == rows[:-2]
    at = np.flatnonzero(whole)
    _, pair = np.unique(ids[at] << np.int64(32) | ids[at + 1], return_inverse=True)
    _, window = np.unique(pair.astype(np.int64) << np.int64(32) | ids[at + 2], return_inverse=True)
    _, key, count = np.unique(window.astype(np.int64) << np.int64(32) | rows[at], return_inverse=True, return_counts=True)
    again = at[count[key] > 1]
    for k in range(3):
        inside[again + k] = True
    return inside


def token_entropy(tokens: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Bits of entropy of each row's tokens."""
    if not len(tokens):
        return np.zeros(n_rows)
    keys, counts = np.unique(rows.astype(np.int64) << np.int64(32) | tokens, return_counts=True)
    row = keys >> np.int64(32)
    total = np.bincount(rows, minlength=n_rows)[row]
    share = counts / total
    return np.maximum(0.0, np.bincount(row, weights=-share * np.log2(share), minlength=n_rows))


SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _measure_block(texts: list[bytes], tokens: WordTokens, scripts: np.ndarray) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]  # bytes.split() cuts at 20 and 09 to 0D only
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for x in words for w in x]
    tokens.add(set(flat))
    ids = np.fromiter(map(tokens.index.__getitem__, flat), np.int64, len(flat))
    rows = np.repeat(np.arange(len(texts)), n_words)
    offset, n_tok, n_piece, n_byte = tokens.facts[:, ids]
    tok_rows = np.repeat(rows, n_tok)
    at = np.repeat(offset - (np.cumsum(n_tok) - n_tok), n_tok) + np.arange(int(n_tok.sum()))

    def per_row(values):
        return np.bincount(rows, weights=values, minlength=len(texts)).astype(np.int64)

    script = []
    for t in texts:
        kinds = scripts[np.frombuffer(t, np.uint8)]
        found = np.bincount(kinds[kinds >= 0], minlength=len(SCRIPTS))
        script.append(SCRIPTS[int(found.argmax())] if found.any() else "other")
    return {
        "n_words": n_words,
        "word_chars": np.array(
            [len(t.decode("utf-8", "replace")) - sum(map(t.count, BLANKS)) for t in texts], np.int64
        ),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": per_row(repeated_words(ids, rows)),
        "n_tokens": per_row(n_tok),
        "n_pieces": per_row(n_piece),
        "n_byte_pieces": per_row(n_byte),
        "token_entropy": token_entropy(tokens.tokens[at], tok_rows, len(texts)),
        "script": np.array(script, object),
    }


_memory: dict[tuple[str, str], WordTokens] = {}


def measure(docs: DataFrame, ranks_path: str, pieces_path: str, text: str = "text") -> DataFrame:
    """The measures of every row's whole text beside the row's other columns but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    schema = docs.select(*rest).schema
    names = [p.split()[0] for p in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pieces_path)
        tokens = _memory.get(key) or _memory.setdefault(key, WordTokens(*key))
        scripts = _script_of_bytes()
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                found = _measure_block(texts, tokens, scripts)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(found[n]) for n in names)], names=[*schema.names, *names]
                )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, run, f"{columns}, {MEASURES}")


def base_failed() -> Column:
    """The rule that holds whatever the vocabulary: too few words, or mostly repeated ones."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(measures: DataFrame, bands: Bands = Bands(), group: str = "lang") -> DataFrame:
    """Adds chars_per_token, fertility, byte_share, base_failed, in_band and kept.

    ``group`` names the language column; null languages go by their script. The measures are
    read twice (medians, then verdicts), so pass a written table.
    """
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    rows = measures.select(
        "*",
        (F.col("word_chars") / tokens).alias("chars_per_token"),
        (F.col("n_tokens") / F.greatest(F.col("n_words"), F.lit(1))).alias("fertility"),
        (F.col("n_byte_pieces") / F.greatest(F.col("n_pieces"), F.lit(1))).alias("byte_share"),
        base_failed().alias("base_failed"),
        F.coalesce(F.col(f"`{group}`").cast("string"), F.concat(F.lit("script "), F.col("script"))).alias("_group"),
    )
    medians = (
        rows.filter(~F.col("base_failed"))
        .groupBy("_group")
        .agg(
            F.count(F.lit(1)).alias("_texts"),
            F.percentile_approx("chars_per_token", 0.5).alias("_chars"),
            F.percentile_approx("fertility", 0.5).alias("_fertility"),
        )
        .filter(F.col("_texts") >= bands.least_texts)
    )
    least = F.create_map(*[F.lit(x) for pair in bands.least_chars for x in pair])[F.col("script")]
    bits = F.log2(F.least(tokens, F.lit(1024)).cast("double"))
    in_band = (
        (F.col("chars_per_token") >= least)
        & (F.col("byte_share") <= bands.high_byte_share)
        & (F.col("token_entropy") >= bits * bands.low_entropy)
        & F.coalesce(F.col("chars_per_token") >= F.col("_chars") * bands.low_chars, F.lit(True))
        & F.coalesce(F.col("chars_per_token") <= F.col("_chars") * bands.high_chars, F.lit(True))
        & F.coalesce(F.col("fertility") <= F.col("_fertility") * bands.high_fertility, F.lit(True))
    )
    return (
        rows.join(checked_broadcast(medians), "_group", "left")
        .withColumn("in_band", in_band)
        .withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
        .drop("_group", "_texts", "_chars", "_fertility")
    )


def fertility_rules(docs: DataFrame, ranks_path: str, pieces_path: str, bands: Bands = Bands()) -> DataFrame:
    """Measures and verdict of every document (doc_id, lang, text)."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    return verdict(stored(measure(own, ranks_path, pieces_path), "fertility"), bands)


def query(docs: DataFrame) -> DataFrame:
    """What op1 returns."""
    import public_tokenizers

    found = fertility_rules(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fertility", "byte_share", "token_entropy", "script", "in_band",
    )
