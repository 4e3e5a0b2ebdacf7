"""Fill-in-the-middle by piece tables: texts are never edited, only their descriptors are.

A document is a list of pieces (buffer, start, length) over two immutable buffers: its own text
and the sentinels. Starts and lengths count code points. Cutting splits a descriptor in two,
an arrangement permutes descriptors and puts sentinels between them, and the inverse permutation
takes the sentinels out again. All that is expressions over an array column; a text's bytes are
touched only when an output is written or hashed, and hashes stream the descriptors one by one.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is
the text itself. The cuts and the form of a document come from sha256 of ``<seed>:<doc_id>`` alone,
so any run, partitioning or repeated task gives the same.

Null and empty texts are plain with no code points; so is a text that holds a sentinel, since it
could not be restored from its output. A null doc_id counts as the empty string. Rows with the
same id are cut by the same draws, repeated rows give equal rows, an empty table an empty table.
Texts go through whole. Columns of the input that have a name of the result are replaced in
``transformed`` (``NAMES``); all others stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, row_blocks, text_arrays

# The sentinels and their buffer.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
BUFFER = "".join(SENTINELS)
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Arrangements: pieces of the text by number (0 prefix, 1 middle, 2 suffix) between sentinels.
ORDERS: dict[str, tuple[int | str, ...]] = {
    PLAIN: (0,),
    PSM: (PREFIX, 0, SUFFIX, 2, MIDDLE, 1),
    SPM: (SUFFIX, 2, PREFIX, 0, MIDDLE, 1),
}
TEXT, SENTINEL = "text", "sentinel"
PIECES = "array<struct<buffer:string,start:bigint,length:bigint>>"
NAMES = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256")


@dataclass(frozen=True)
class Rates:
    """How many documents of a hundred are rearranged, and how many of those as spm."""

    seed: int = 1
    rearranged: int = 90
    spm: int = 20


# -- descriptors --------------------------------------------------------------------------


def _piece(buffer: str, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def whole(length: Column) -> Column:
    """A text that nothing has been done to: one piece."""
    return F.array(_piece(TEXT, F.lit(0), length))


def cut(pieces: Column, number: int, at: Column) -> Column:
    """``pieces`` with one of them split after its first ``at`` code points."""
    one = F.get(pieces, F.lit(number))
    left = F.struct(one["buffer"].alias("buffer"), one["start"].alias("start"), at.cast("long").alias("length"))
    right = F.struct(
        one["buffer"].alias("buffer"), (one["start"] + at).alias("start"), (one["length"] - at).alias("length")
    )
    return F.concat(F.slice(pieces, 1, number), F.array(left, right), F.slice(pieces, number + 2, F.size(pieces)))


def arrange(pieces: Column, order: tuple[int | str, ...]) -> Column:
    """The pieces in another order, with sentinels where ``order`` names one."""
    sentinel = lambda s: _piece(SENTINEL, F.lit(BUFFER.index(s)), F.lit(len(s)))
    return F.array(*(sentinel(x) if isinstance(x, str) else F.get(pieces, F.lit(x)) for x in order))


def inverse(order: tuple[int | str, ...]) -> list[int]:
    """Places in an arrangement at which the pieces 0, 1, … of the text stand."""
    at = {x: k for k, x in enumerate(order) if not isinstance(x, str)}
    return [at[k] for k in range(len(at))]


def described(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``docs`` (doc_id, text, …) with n, form, prefix_chars, middle_chars and the arranged pieces."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{rates.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long")
    held = F.lit(False)
    for s in SENTINELS:
        held = held | text.contains(s)
    drawn = docs.drop(*NAMES).withColumn("_digest", digest).withColumn("n", F.length(text).cast("long"))
    one, two = draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)
    form = (
        F.when((F.col("n") == 0) | held | (draw(2) % 100 >= rates.rearranged), F.lit(PLAIN))
        .when(draw(3) % 100 < rates.spm, F.lit(SPM))
        .otherwise(F.lit(PSM))
    )
    drawn = drawn.withColumn("form", form).withColumn("_lo", F.least(one, two)).withColumn("_hi", F.greatest(one, two))
    thirds = cut(cut(whole(F.col("n")), 0, F.col("_lo")), 1, F.col("_hi") - F.col("_lo"))
    rearranged = F.col("form") != PLAIN
    return (
        drawn.withColumn("prefix_chars", F.when(rearranged, F.col("_lo")))
        .withColumn("middle_chars", F.when(rearranged, F.col("_hi") - F.col("_lo")))
        .withColumn(
            "pieces",
            F.when(F.col("form") == PSM, arrange(thirds, ORDERS[PSM]))
            .when(F.col("form") == SPM, arrange(thirds, ORDERS[SPM]))
            .otherwise(arrange(whole(F.col("n")), ORDERS[PLAIN])),
        )
        .drop("_digest", "_lo", "_hi")
    )


# -- bytes --------------------------------------------------------------------------------


class Places:
    """Byte offsets of the code points of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(starts, offsets[:-1])
        self.starts = np.append(starts, len(data))

    def bytes_of(self, row: np.ndarray, point: np.ndarray) -> np.ndarray:
        return self.starts[self.first[row] + point]


def stream(pieces: list[tuple[memoryview, int, int]]) -> Iterator[memoryview]:
    """The bytes of (buffer, from, to) descriptors, one slice after another."""
    for buffer, lo, hi in pieces:
        yield buffer[lo:hi]


def hashed(pieces: list[tuple[memoryview, int, int]]) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces):
        digest.update(part)
    return digest.hexdigest()


def transformed(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``described`` rows with their output text and its sha256, both streamed from the pieces."""
    rows = described(docs, rates)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    text_at, pieces_at = rows.columns.index("text"), rows.columns.index("pieces")
    sentinels = BUFFER.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(text_at))
            for lo, hi in row_blocks(offsets):
                part = batch.slice(lo, hi - lo)
                block, begin = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lists = part.column(pieces_at)
                cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                buffer, start, length = lists.flatten().flatten()
                own = buffer.to_numpy(zero_copy_only=False) == TEXT
                start, length = start.to_numpy(), length.to_numpy()
                row = np.repeat(np.arange(hi - lo), np.diff(cuts))
                a, b = start.copy(), start + length
                places = Places(block, begin)
                a[own], b[own] = places.bytes_of(row[own], a[own]), places.bytes_of(row[own], b[own])
                views = {True: memoryview(np.ascontiguousarray(block)), False: memoryview(sentinels)}
                flat = [(views[o], i, j) for o, i, j in zip(own.tolist(), a.tolist(), b.tolist(), strict=True)]
                outputs, digests = [], []
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    outputs.append(b"".join(stream(flat[i:j])))
                    digests.append(hashed(flat[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                    names=[*part.schema.names, "output", "output_sha256"],
                )

    return rows.transform(in_arrow, run, ", ".join([*columns, "output string", "output_sha256 string"]))


def recovered(output: bytes, form: str) -> list[tuple[memoryview, int, int]]:
    """The pieces of the text, in its own order, over an output that has been written.

    The text holds no sentinel, so each is found where it was put: none can begin in a piece and
    end in a sentinel, or the other way round, since < only begins and > only ends one.
    """
    order, view = ORDERS[form], memoryview(output)
    pieces, at = [], 0
    for k, x in enumerate(order):
        if isinstance(x, str):
            end = at + len(x)
        else:
            end = output.index(order[k + 1].encode(), at) if k + 1 < len(order) else len(output)
        pieces.append((view, at, end))
        at = end
    return [pieces[k] for k in inverse(order)]


def restored(outputs: DataFrame) -> DataFrame:
    """Rows with ``form`` and ``output``, and the text they were made from, with its sha256.

    Only the output and its form are looked at. A null output is as an empty one.
    """
    rest = outputs.drop("restored", "restored_sha256")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    form_at, output_at = rest.columns.index("form"), rest.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(output_at))
            forms = batch.column(form_at)
            for lo, hi in row_blocks(offsets):
                texts, digests = [], []
                for k in range(lo, hi):
                    pieces = recovered(data[offsets[k] : offsets[k + 1]].tobytes(), forms[k].as_py())
                    texts.append(b"".join(stream(pieces)))
                    digests.append(hashed(pieces))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                    names=[*part.schema.names, "restored", "restored_sha256"],
                )

    return rest.transform(in_arrow, run, ", ".join([*columns, "restored string", "restored_sha256 string"]))


def query(docs: DataFrame) -> DataFrame:
    """What op12 returns: each text's digests after writing its output and after restoring it from that."""
    made = transformed(docs.select("doc_id", "text")).drop("text", "pieces")
    return restored(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


ORACLE = """
WITH draws AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM draws),
forms AS (
  SELECT doc_id, text, n, least(a, b) AS lo, greatest(a, b) AS hi, CASE
    WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
    WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
outputs AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || text[1:lo] || '<S>' || text[hi + 1:] || '<M>' || text[lo + 1:hi]
    ELSE '<S>' || text[hi + 1:] || '<P>' || text[1:lo] || '<M>' || text[lo + 1:hi] END AS output FROM forms),
marks AS (SELECT *, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS m FROM outputs)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN output[p + 3:s - 1] || output[m + 3:] || output[s + 3:m - 1]
    ELSE output[p + 3:m - 1] || output[m + 3:] || output[s + 3:p - 1] END) AS restored_sha256
FROM marks
"""
