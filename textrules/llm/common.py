"""Helpers the operators share: text buffers as numpy arrays, word hashes, shared tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import textrules
from textrules.session import spread

#: Bytes of text that a task works on at a time (one longer text is a block of its own).
BLOCK_BYTES = 1 << 20

_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this library to the job's Python workers, once an application.

    Spark serves the archive to the executors, so they need not have the library installed.
    """
    app, package = spark.sparkContext.applicationId, Path(textrules.__file__).parent
    if app in _shipped or not package.is_dir():  # not a folder: it came as an archive itself
        return
    path = Path(tempfile.mkdtemp(prefix="textrules-")) / "textrules.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this library at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def set_aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all other columns renamed, so that none has a name an operator uses inside.

    The function given back turns a result into the columns that ``docs`` had.
    """
    names = {c: f"_column_{k}" for k, c in enumerate(docs.columns) if c not in used}
    back = [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(names), lambda result: result.select(*back)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder, dealt out over the cores when it has fewer splits than those."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the row offsets into them; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits (the public murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    ``letters`` tells which bytes belong to words; A-Z are lower-cased when ``fold`` is set. With
    ``alone``, characters of scripts without blanks are a word each, and their marks part words.
    A word's hash is a polynomial of its bytes' random values, taken apart at word starts.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, letters: np.ndarray, fold: bool = True, alone: bool = False):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if fold:
            values[0x41:0x5B] = values[0x61:0x7B]
        self.letters, self.alone = letters, alone
        self.values = np.where(letters, values, np.uint64(0))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                step = np.full(n, np.uint64(self.BASE))
                step[0] = 1
                self.power = np.cumprod(step, dtype=np.uint64)
                step[1:] = np.uint64(pow(self.BASE, -1, 1 << 64))
                self.inverse = np.cumprod(step, dtype=np.uint64)

    def _block(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask, marks = self.letters[data], np.zeros(0, np.int64)
        if self.alone and (data >= 0xE0).any():
            cuts, marks = lone_characters(data)
            breaks = np.concatenate([breaks, cuts])
            mask[marks] = False
        before = np.empty_like(mask)
        before[0] = False
        before[1:] = mask[:-1]
        before[breaks] = False
        starts = np.flatnonzero(mask & ~before)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        after = np.empty_like(mask)
        after[-1] = False
        after[:-1] = mask[1:]
        after[breaks[breaks > 0] - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        self._grow(len(data))
        with np.errstate(over="ignore"):
            terms = self.values[data]
            terms *= self.power[: len(data)]
            terms[marks] = 0
            hashes = np.add.reduceat(terms, starts) * self.inverse[starts]
            hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        return starts, ends, hashes

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Starts, ends and hashes of all words, and where each row's words begin.

        One long text goes through in pieces that are cut at separators.
        """
        parts, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + 2 * BLOCK_BYTES)
            while hi < len(data):
                cut = np.flatnonzero(~self.letters[data[lo:hi]])
                if len(cut):
                    hi = lo + int(cut[-1]) + 1
                    break
                hi = min(len(data), lo + 2 * (hi - lo))
            inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
            starts, ends, hashes = self._block(data[lo:hi], inside.astype(np.int64))
            parts.append((starts + lo, ends + lo, hashes))
            lo = hi
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return starts, ends, hashes, np.searchsorted(starts, offsets)


#: Scripts that are written without blanks: Thai and Lao, Tibetan, Myanmar, Khmer, kana and Bopomofo,
#: Han, Yi, further Myanmar letters, halfwidth kana, and the Han planes.
_LONE = np.array([
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
])
#: Ideographic and full-width punctuation.
_MARKS = np.array([
    (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F),
    (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
])


def _within(codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ranges[:, 0], codes, "right") - 1
    return (at >= 0) & (codes <= ranges[at, 1])


def lone_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in UTF-8 where characters of scripts without blanks begin and end, and the bytes of their marks."""
    at = np.flatnonzero(data >= 0xE0)
    size = np.where(data[at] >= 0xF0, 4, 3)
    whole = at + size <= len(data)
    at, size = at[whole], size[whole]
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F
    codes = (data[at].astype(np.int64) & 0x0F) << 12 | byte(1) << 6 | byte(2)
    codes = np.where(size == 4, (codes & 0x7FFF) << 6 | byte(3), codes)
    lone, mark = _within(codes, _LONE), _within(codes, _MARKS)
    cuts = np.concatenate([at[lone], at[lone] + size[lone]])
    marks = np.concatenate([at[mark] + k for k in range(3)])
    return cuts[cuts < len(data)], marks


def blank_words() -> np.ndarray:
    """Bytes of words that are cut at blanks only: all but 20 and 09 to 0D."""
    letters = np.ones(256, bool)
    letters[list(_SEPARATORS)] = False
    return letters


def letter_words() -> np.ndarray:
    """Bytes of words that are cut at ASCII punctuation too; bytes from 80 on are letters."""
    letters = np.zeros(256, bool)
    letters[0x30:0x3A] = letters[0x41:0x5B] = letters[0x61:0x7B] = letters[0x80:] = True
    return letters


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words: position i has the words i to i+n-1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total = (total ^ hashes[k : k + len(total)]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
        return mix(total)
