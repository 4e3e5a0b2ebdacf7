"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is a position; its label is good or bad. Features say how a line and its two
neighbours look (shares of capitals, digits, symbols, repeated words and so on, each cut into bins),
transition weights tie neighbouring labels together. A text's quality is the mean of its lines'
probabilities of being good, from forward-backward marginals, weighted by the lines' lengths.

The weights are fitted to labelled texts, whose lines all get the text's label: at most
``sample_rows`` rows (those with the smallest hash of their id) of at most ``sample_chars``
characters each, so fitting is bounded; scoring covers all texts whole, in blocks.

Null and empty texts, and texts without a word, are scored as one empty line. With no labelled
rows, or one label only, every text gets the share of good rows (1/2 if there are none). Null
labels are not learned from; rows labelled twice count twice; an empty table gives an empty table.
A column ``score`` of the input is replaced; all others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import WordHasher, blank_words, in_arrow, mix, row_blocks, shingle_hashes, text_arrays
from textrules.llm.language import remainder
from textrules.session import checked_broadcast


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 4000
    sample_chars: int = 200_000
    #: Bin borders of a feature, as quantiles of its values above 0; 0 has a bin of its own.
    borders: tuple[float, ...] = (0.02, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 0.98)
    rounds: int = 200
    rate: float = 0.1
    decay: float = 1e-4


N_FEATURES = 15
_CLASSES = (
    range(0x41, 0x5B),  # capitals
    range(0x61, 0x7B),
    range(0x30, 0x3A),
    b"#*$%&|<>",
    b".,;:?",
    b"!",
    range(0x80, 0x100),
    b"|",
    b"\"'()[]{}@/\\=+_~^`-",
)


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES), 256), bool)
    for k, chars in enumerate(_CLASSES):
        tables[k, list(chars)] = True
    return tables


class LineFeatures:
    """Raw features of all lines of a block of texts."""

    def __init__(self):
        self.hasher = WordHasher(blank_words())
        self.tables = _class_tables()

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, weight in bytes, row) of the lines; each row has one line at least."""
        n_rows = len(offsets) - 1
        starts, ends, hashes, _ = self.hasher.words(data, offsets)
        breaks = np.flatnonzero(data == 0x0A) + 1
        begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
        if not len(starts):
            return np.zeros((n_rows, N_FEATURES)), np.ones(n_rows), np.arange(n_rows)
        line_of = np.searchsorted(begin, starts, "right") - 1
        kept, line = np.unique(line_of, return_inverse=True)  # lines with a word
        lo = begin[kept]
        hi = np.append(begin, len(data))[kept + 1]
        row = np.searchsorted(offsets, lo, "right") - 1
        size = (hi - lo).astype(float)
        n_lines = len(kept)
        counts = []
        for table in self.tables:
            sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            counts.append((sums[hi] - sums[lo]).astype(float))
        upper, lower, digit, symbol, stop, shout, wide, pipe, other = counts
        words = np.bincount(line, minlength=n_lines).astype(float)
        word_bytes = np.bincount(line, weights=ends - starts, minlength=n_lines)
        mean = lambda marks: np.bincount(line, weights=marks, minlength=n_lines) / words
        in_row = row[line].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = _first_of(hashes ^ mix(in_row + np.uint64(1)))
        fresh = _first_of(hashes ^ mix(line.astype(np.uint64) + np.uint64(1)))
        again = np.zeros(len(hashes), bool)
        runs = shingle_hashes(hashes, 3)
        if len(runs):
            whole = row[line][2:] == row[line][:-2]
            keys = runs[whole] ^ mix(in_row[: len(runs)][whole] + np.uint64(2))
            _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
            at = np.flatnonzero(whole)[n[which] > 1]
            for k in range(3):
                again[at + k] = True
        with np.errstate(over="ignore"):
            bounds = np.flatnonzero(np.diff(line, prepend=-1))
            content = np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - bounds[line]).astype(np.uint64)), bounds)
        _, which, n = np.unique(content ^ mix(row.astype(np.uint64) + np.uint64(3)), return_inverse=True, return_counts=True)
        letters = np.maximum(1.0, upper + lower + wide)
        features = np.stack(
            [
                np.log1p(words), word_bytes / words, upper / letters, digit / size, symbol / size, stop / words,
                shout / words, wide / size, pipe / words, other / size, mean(~first), mean(fresh), mean(again),
                (n[which] > 1).astype(float), (symbol > words / 2).astype(float),
            ],
            axis=1,
        )
        bare = np.setdiff1d(np.arange(n_rows), row)
        if len(bare):
            features = np.concatenate([features, np.zeros((len(bare), N_FEATURES))])
            size = np.concatenate([size, np.ones(len(bare))])
            row = np.concatenate([row, bare])
            order = np.argsort(row, kind="stable")
            features, size, row = features[order], size[order], row[order]
        return features, size, row


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Marks the first place of each key."""
    mark = np.zeros(len(keys), bool)
    mark[np.unique(keys, return_index=True)[1]] = True
    return mark


class LineField:
    """Bins, weights and transitions of a fitted field (state 1 is good)."""

    def __init__(self, edges: np.ndarray, prior: float):
        self.edges, self.prior = edges, prior
        self.n_bins = edges.shape[1] + 1
        self.weights = np.zeros(3 * N_FEATURES * self.n_bins + 3)
        self.moves = np.zeros((2, 2))

    def active(self, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Indexes of each line's active weights: its own bins, its neighbours', bias and borders."""
        own = np.stack(
            [np.searchsorted(self.edges[k], features[:, k], "right") + k * self.n_bins for k in range(N_FEATURES)], axis=1
        )
        block = N_FEATURES * self.n_bins
        none = 3 * block
        before = np.full_like(own, none)
        after = np.full_like(own, none)
        same = row[1:] == row[:-1]
        before[1:][same] = own[:-1][same] + block
        after[:-1][same] = own[1:][same] + 2 * block
        return np.concatenate([own, before, after, np.full((len(own), 1), none + 1)], axis=1)

    def pull(self, active: np.ndarray) -> np.ndarray:
        """How much each line leans to good."""
        w = self.weights.copy()
        w[3 * N_FEATURES * self.n_bins] = 0  # stands for a missing neighbour
        return w[active].sum(axis=1)

    def marginals(self, pull: np.ndarray, row: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` also the expected moves and the log-partition."""
        good, moves, total = np.zeros(len(pull)), np.zeros((2, 2)), 0.0
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(begin, len(row)))
        level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for k in np.unique(level):  # texts of like length go together
            b, n = begin[level == k], size[level == k]
            for lo in range(0, len(b), max(1, (1 << 18) >> k)):
                part = slice(lo, lo + max(1, (1 << 18) >> k))
                found = self._chain(pull, b[part], n[part])
                good_at, at, m, z = found
                good[at] = good_at
                moves += m
                total += z
        return (good, moves, total) if pairs else good

    def _chain(self, pull, begin, size):
        steps = int(size.max())
        at = np.minimum(begin[:, None] + np.arange(steps), len(pull) - 1)
        real = np.arange(steps) < size[:, None]
        score = np.zeros((len(begin), steps, 2))
        score[..., 1] = np.where(real, pull[at], 0.0)
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, steps):
            new = _logsum(forward[:, t - 1, :, None] + self.moves[None], 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        back = np.zeros_like(score)
        for t in range(steps - 2, -1, -1):
            new = _logsum(self.moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], new, back[:, t + 1] * 0)
        total = _logsum(forward[:, -1], 1)
        both = forward + back - total[:, None, None]
        joint = forward[:, :-1, :, None] + self.moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        moves = (np.exp(np.minimum(joint, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
        return np.exp(np.minimum(both[..., 1], 0))[real], at[real], moves, float(total.sum())

    def scores(self, features: np.ndarray, size: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Length-weighted share of good lines of each row."""
        good = self.marginals(self.pull(self.active(features, row)), row)
        top = np.bincount(row, weights=good * size, minlength=n_rows)
        return np.clip(top / np.maximum(1e-9, np.bincount(row, weights=size, minlength=n_rows)), 0.0, 1.0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit_field(features: np.ndarray, row: np.ndarray, label: np.ndarray, fit: Fit = Fit()) -> LineField | None:
    """Maximum likelihood of line labels (``label`` is by row) by Adam; None without both labels."""
    if not len(label) or label.min() == label.max():
        return None
    edges = np.full((N_FEATURES, len(fit.borders) + 1), 1e-9)
    for k in range(N_FEATURES):
        above = features[:, k][features[:, k] > 0]
        if len(above):
            edges[k, 1:] = np.quantile(above, fit.borders)
    field = LineField(edges, float(label.mean()))
    active = field.active(features, row)
    lines = label[row].astype(float)
    n = len(row)
    same = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[row][:-1][same], label[row][1:][same]), 1.0)
    size = len(field.weights) + 4
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, fit.rounds + 1):
        good, moves, _ = field.marginals(field.pull(active), row, pairs=True)
        slope = np.bincount(active.ravel(), weights=np.repeat(good - lines, active.shape[1]), minlength=len(field.weights))
        slope = np.concatenate([slope, (moves - seen).ravel()]) / n
        slope += fit.decay * np.concatenate([field.weights, field.moves.ravel()])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = fit.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        field.weights -= move[:-4]
        field.moves -= move[-4:].reshape(2, 2)
    return field


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the lines of (label, text) rows: one row a text, flat."""
    maker = LineFeatures()
    for batch in batches:
        data, offsets = text_arrays(batch.column(1))
        for lo, hi in row_blocks(offsets):
            features, _, row = maker.block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cuts = np.append(np.searchsorted(row, np.arange(hi - lo)), len(row)) * N_FEATURES
            flat = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(features.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], names=["label", "lines"])


def train(docs: DataFrame, marks: DataFrame, fit: Fit = Fit()) -> tuple[LineField | None, float]:
    """Fit to the texts of ``docs`` (doc_id, text) that ``marks`` (doc_id, label) label.

    Gives the field, and the share of good rows in the sample. The sample is drawn from the labels
    by a hash of the id, so only the texts it takes are moved.
    """
    marks = marks.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    share = min(1.0, 1.2 * fit.sample_rows / max(1, marks.count()))
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = docs.select("doc_id", "text").join(checked_broadcast(drawn), "doc_id")
    rows = rows.filter(F.length("text") <= fit.sample_chars)
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.sample_rows).select(F.col("label").cast("int"), "text")
    table = sample.transform(in_arrow, _line_rows, "label int, lines array<double>").toArrow()
    if not table.num_rows:
        return None, 0.5
    label = np.array(table["label"].to_pylist())
    lines = table["lines"].combine_chunks()
    flat = lines.flatten().to_numpy().reshape(-1, N_FEATURES)
    row = np.repeat(np.arange(len(label)), np.array([len(x) // N_FEATURES for x in lines]))
    return fit_field(flat, row, label, fit), float(label.mean())


def score(docs: DataFrame, field: LineField | None, prior: float, text: str = "text") -> DataFrame:
    """Adds ``score``, the quality of each row's whole text; other columns stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "score")]
    schema = docs.select(*rest).schema
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, maker = shared.value, LineFeatures()
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                if field is None:
                    found = np.full(hi - lo, prior)
                else:
                    block = maker.block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    found = field.scores(*block, hi - lo)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found, pa.float64())], names=[*schema.names, "score"]
                )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, run, ", ".join([*columns, "score double"]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op8 returns."""
    marks = labels.filter(remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    field, prior = train(docs, marks)
    held = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    found = score(docs.select("doc_id", "text"), field, prior)
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
