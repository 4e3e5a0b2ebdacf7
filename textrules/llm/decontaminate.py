"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified by edit distance.

Texts are words (lower-cased, cut at ASCII, ideographic and full-width punctuation and blanks; each
character of a script without blanks is a word). A text holds an item of L words when some run of
its words is within k = floor((1 - similarity) * L) word edits of the item.

* Windows: of an item cut into k + 1 pieces, one piece stays whole under k edits, so every window
  that could pass starts within k words of where one of the pieces' first words say. Only such
  windows are embedded; this loses none.
* Embedding: a random walk goes through the window; at step j it emits the word it stands on and
  a random bit of (j, word) tells whether it moves on. Few edits change few emitted words, so edit
  distance becomes Hamming distance.
* LSH: each repetition has its own walk and samples a few of the 2L coordinates; windows and
  items of equal length that agree on them are candidates. The number of repetitions doubles until
  edited copies of the items themselves are found with the target recall.
* Verification: the exact edit distance between the item and the best run of words around the
  candidate windows.
* Items of fewer than ``least_words`` words are found as whole runs, by their hashes.

Items go to the tasks in blocks of bounded size; texts pass each block in place, so nothing is
shuffled and no document meets another. Null and empty texts hold nothing, null item ids are kept
as they are, items without words match nothing, repeated documents or items give repeated rows, and empty tables give an empty table. Texts go
through whole. ``contaminated`` replaces columns of the input that have a name of ``FOUND``; all others,
and all columns in ``clean_documents``, may have any names. Of runs at the same distance the first counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import WordHasher, in_arrow, letter_words, mix, row_blocks, shingle_hashes, text_arrays
from textrules.session import measured_bytes

#: Bytes of items that one pass over the documents carries to the tasks.
ITEM_BYTES = 8 << 20
#: Windows that are embedded at a time.
WINDOWS = 1 << 17

PAD = np.uint64(0x5851F42D4C957F2D)
_FILTER_BITS = 20


@dataclass(frozen=True)
class Search:
    similarity: float = 0.8
    least_words: int = 5
    samples: int = 2
    recall: float = 0.99
    trials: int = 400
    seed: int = 7


def allowed(n_words: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n_words + 1e-9)


def distances(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Edit distances between ``item`` and the best run of ``region`` that ends before each place."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_run(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least distance and the run [start, end) of ``region`` that has it; the first one of those."""
    ends = distances(item, region)
    end = int(ends.argmin())
    back = distances_of_prefixes(item[::-1], region[:end][::-1])
    return int(ends[end]), end - int(back.argmin()), end


def distances_of_prefixes(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Edit distances between ``item`` and each prefix of ``region``."""
    steps = np.arange(len(region) + 1)
    row = steps.copy()
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


class ItemIndex:
    """One block of items: anchors of their pieces, and their LSH keys by length."""

    def __init__(self, ids: list, texts: list[str], search: Search):
        self.search = search
        hasher = WordHasher(letter_words(), alone=True)
        kept, self.words, short = [], [], []
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words = hasher.words(data, np.array([0, len(data)]))[2]
            if len(words) >= search.least_words:
                kept.append(item)
                self.words.append(words)
            elif len(words):
                short.append((item, words))
        self.ids = kept
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array([allowed(n, search.similarity) for n in self.length], np.int64)
        self._anchors()
        self.kinds = np.unique(self.length)  # the window sizes
        self.kind_of = np.searchsorted(self.kinds, self.length)
        self._repetitions()
        self._short(short)

    def _short(self, items: list[tuple]) -> None:
        """Items that no edit is allowed in, numbered after the others: sorted hashes by length."""
        first = len(self.ids)
        self.ids = self.ids + [item for item, _ in items]
        size = np.array([len(words) for _, words in items], np.int64)
        self.length = np.concatenate([self.length, size])
        self.whole = {}
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            keys = np.concatenate([shingle_hashes(items[i][1], n) for i in at])
            order = np.argsort(keys, kind="stable")
            self.whole[n] = keys[order], first + at[order]

    def short_matches(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """What ``matches`` gives, for the items of ``_short``: the first run of each row."""
        found = []
        for n, (keys, items) in self.whole.items():
            runs = shingle_hashes(words, n)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
            row = np.searchsorted(rows, at, "right") - 1
            inside = at + n <= rows[row + 1]
            at, row = at[inside], row[inside]
            _, once = np.unique(np.stack([row.astype(np.uint64), runs[at]]), axis=1, return_index=True)
            at, row = at[once], row[once]
            lo, hi = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            which, key = expand(lo, hi)
            begin = at[which] - rows[row[which]]
            found += zip(
                row[which].tolist(), items[key].tolist(), [0] * len(which), begin.tolist(), (begin + n).tolist(), strict=True
            )
        return found

    def _anchors(self) -> None:
        """For q = 2 and 3: sorted hashes of the first q words of each piece, and whose they are."""
        found: dict[int, list[tuple[int, int, int]]] = {2: [], 3: []}
        for n, words in enumerate(self.words):
            bounds = np.linspace(0, len(words), int(self.slack[n]) + 2).astype(int)
            q = 3 if np.diff(bounds).min() >= 3 else 2
            runs = shingle_hashes(words, q)
            found[q] += [(int(runs[at]), n, int(at)) for at in bounds[:-1]]
        self.anchors = {}
        for q, rows in found.items():
            if rows:
                rows.sort()
                keys = np.array([r[0] for r in rows], np.uint64)
                bits = np.zeros(1 << _FILTER_BITS, bool)
                bits[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
                self.anchors[q] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), bits)

    def _repetitions(self) -> None:
        s = self.search
        rng = np.random.default_rng(s.seed)
        steps = int(2 * self.kinds.max()) if len(self.kinds) else 0
        self.odd = np.zeros((0, steps), np.uint64)
        self.coords = np.zeros((0, len(self.kinds), s.samples), np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        if not steps:
            return
        edited = self._edited(rng)
        found = np.zeros(len(edited), bool)
        want = 8
        while found.mean() < s.recall and want <= 512:
            more = want - len(self.odd)
            odd = rng.integers(0, 1 << 63, (more, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            coords = np.stack(
                [np.sort(rng.integers(0, 2 * n, (more, s.samples)), axis=1) for n in self.kinds], axis=1
            )
            old = len(self.odd)
            self.odd = np.concatenate([self.odd, odd])
            self.coords = np.concatenate([self.coords, coords])
            for r in range(old, want):
                self.tables.append(self._table(r))
            for t, (item, words) in enumerate(edited):
                if not found[t]:
                    slack = int(self.slack[item])
                    starts = np.arange(0, max(1, min(2 * slack + 1, len(words))))
                    kind = np.full(len(starts), self.kind_of[item])
                    hits = self.lookup(words, starts, np.full(len(starts), len(words)), kind, old)
                    found[t] = (hits[1] == item).any()
            want *= 2
        self.measured = float(found.mean())

    def _edited(self, rng) -> list[tuple[int, np.ndarray]]:
        """Items with as many random word edits as they may have, to measure recall on."""
        out = []
        for t in range(self.search.trials):
            item = t % len(self.words)
            words = list(self.words[item])
            for _ in range(int(self.slack[item])):
                kind, at = rng.integers(0, 3), int(rng.integers(0, max(1, len(words))))
                new = np.uint64(rng.integers(0, 1 << 63))
                if kind == 0:
                    words[at] = new
                elif kind == 1:
                    words.insert(at, new)
                elif len(words) > 1:
                    del words[at]
            out.append((item, np.array(words, np.uint64)))
        return out

    def embed(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, r: int) -> np.ndarray:
        """Keys of windows under repetition ``r``: the sampled coordinates of their walks.

        Windows begin at ``starts`` and have the length of their kind or end at ``ends``.
        """
        n = self.kinds[kind]
        stop = np.minimum(starts + n, ends)
        at, coords = starts.copy(), self.coords[r][kind]
        keys = kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for j in range(int(coords.max()) + 1):
                inside = at < stop
                word = np.where(inside, words[np.minimum(at, len(words) - 1)], PAD)
                for k in range(coords.shape[1]):
                    here = coords[:, k] == j
                    if here.any():
                        keys[here] = mix(keys[here] ^ (word[here] * np.uint64(2 * k + 3)))
                at += inside & ((word * self.odd[r, j]) >> np.uint64(63)).astype(bool)
        return keys

    def _table(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate(self.words)
        starts = np.cumsum(self.length) - self.length
        keys = self.embed(words, starts, starts + self.length, self.kind_of, r)
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def lookup(self, words, starts, ends, kind, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all windows and items that share a key in some repetition."""
        wins, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(first, len(self.odd)):
            keys = self.embed(words, starts, ends, kind, r)
            table, order = self.tables[r]
            lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            win, at = expand(lo, hi)
            wins.append(win)
            items.append(order[at])
        both = np.unique(np.concatenate(wins) * max(1, len(self.ids)) + np.concatenate(items))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))

    def anchored(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, kind) of the windows that some anchor allows; rows[i]: i's row begins there."""
        starts, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (keys, items, offsets, bits) in self.anchors.items():
            runs = shingle_hashes(words, q)
            at = np.flatnonzero(bits[runs & np.uint64((1 << _FILTER_BITS) - 1)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            hit, key = expand(lo, hi)
            place, item = at[hit], items[key]
            row = np.searchsorted(rows, place, "right") - 1
            inside = place + q <= rows[row + 1]
            place, item, row, offset = place[inside], item[inside], row[inside], offsets[key][inside]
            slack = self.slack[item]
            which, shift = expand(-slack, slack + 1)
            start = np.clip(place[which] - offset[which] + shift, rows[row[which]], rows[row[which] + 1] - 1)
            starts.append(start)
            kinds.append(self.kind_of[item[which]])
        n = max(1, len(self.kinds))
        both = np.unique(np.concatenate(starts) * n + np.concatenate(kinds))
        return both // n, both % n

    def matches(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, word after the last) of every item that a row holds."""
        starts, kinds = self.anchored(words, rows)
        row = np.searchsorted(rows, starts, "right") - 1
        near: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(starts), WINDOWS):
            part = slice(lo, lo + WINDOWS)
            win, item = self.lookup(words, starts[part], rows[row[part] + 1], kinds[part])
            for w, i in zip((win + lo).tolist(), item.tolist(), strict=True):
                near.setdefault((int(row[w]), i), []).append(int(starts[w]))
        found = []
        for (r, i), places in sorted(near.items()):
            n, k, best = int(self.length[i]), int(self.slack[i]), None
            for lo, hi in _clusters(sorted(places), n):
                begin, end = max(int(rows[r]), lo - k), min(int(rows[r + 1]), hi + n + k)
                distance, a, b = best_run(self.words[i], words[begin:end])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, begin + a - int(rows[r]), begin + b - int(rows[r]))
            if best:
                found.append((r, i, *best))
        return found


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, x) with lo[i] <= x < hi[i]."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _clusters(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    lo = hi = places[0]
    for p in places[1:]:
        if p - hi > gap:
            yield lo, hi
            lo = p
        hi = p
    yield lo, hi


#: Words of rows with an anchored window that are searched at a time, and bytes of a batch's part.
HELD_WORDS, PART_BYTES = 1 << 18, 4 << 20


def _batch_matches(index: ItemIndex, hasher: WordHasher, column) -> list[tuple[int, int, int, int, int]]:
    """Matches in one batch of texts. Only rows with an anchored window go on to the longer items, many at once."""
    data, offsets = text_arrays(column)
    kept, sizes, numbers, found = [], [], [], []

    def search() -> None:
        if kept:
            rows = np.concatenate([[0], np.cumsum(sizes)])
            found.extend((numbers[r], *rest) for r, *rest in index.matches(np.concatenate(kept), rows))
        for held in (kept, sizes, numbers):
            held.clear()

    for lo, hi in row_blocks(offsets):
        begin, end = offsets[lo], offsets[hi]
        _, _, words, rows = hasher.words(data[begin:end], offsets[lo : hi + 1] - begin)
        found += [(lo + r, *rest) for r, *rest in index.short_matches(words, rows)]
        starts, _ = index.anchored(words, rows)
        for r in np.unique(np.searchsorted(rows, starts, "right") - 1).tolist():
            kept.append(words[rows[r] : rows[r + 1]].copy())
            sizes.append(len(kept[-1]))
            numbers.append(lo + r)
        if sum(sizes) >= HELD_WORDS:
            search()
    search()
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to parts of bounded bytes (one row at least); what they leave goes back at the end."""
    for batch in batches:
        rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def item_blocks(items: DataFrame, search: Search, limit: int = ITEM_BYTES) -> Iterator[ItemIndex]:
    """The items (item_id, text) as indexes of bounded size."""
    n = max(1, math.ceil(measured_bytes(items) / limit))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n):
        rows = (items.filter(part == i) if n > 1 else items).collect()  # at most about ``limit`` bytes
        index = ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], search)
        if index.ids:
            yield index


def _scan(docs: DataFrame, index: ItemIndex, text: str, clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEM_BYTES of items
    if clean:
        at = docs.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher(letter_words(), alone=True)
            for batch in _parts(batches):
                held = np.ones(batch.num_rows, bool)
                held[[m[0] for m in _batch_matches(shared.value, hasher, batch.column(at))]] = False
                yield batch.filter(pa.array(held))

        return docs.transform(in_arrow, keep, docs.schema)

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in FOUND]
    schema = docs.select(*rest).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letter_words(), alone=True)
        for batch in _parts(batches):
            index = shared.value
            found = _batch_matches(index, hasher, batch.column(len(schema)))
            part = batch.take(pa.array([m[0] for m in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:-1],
                    pa.array([index.ids[m[1]] for m in found], pa.int64()),
                    *(pa.array([m[k] for m in found], pa.int64()) for k in (3, 4, 2)),
                    pa.array([int(index.length[m[1]]) for m in found], pa.int64()),
                ],
                names=[*schema.names, *FOUND],
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, find, ", ".join([*columns, *(f"{n} long" for n in FOUND)]))


FOUND = ("item_id", "first_word", "end_word", "distance", "item_words")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), text: str = "text") -> DataFrame:
    """One row per document and item that it holds, with the best run of words and its distance."""
    found = [_scan(docs, index, text, False) for index in item_blocks(_items(benchmark), search)]
    if not found:
        rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text and c not in FOUND)).limit(0)
        return rest.select("*", *(F.lit(None).cast("long").alias(n) for n in FOUND))
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def clean_documents(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for index in item_blocks(_items(benchmark), search):
        docs = _scan(docs, index, text, True)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What op6 returns."""
    return contaminated(docs.select("doc_id", "text"), benchmark)
