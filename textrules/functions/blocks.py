"""Arrow code of blocks of rows, used inside tasks: a block's words are told apart once.

A block is some rows as they lie: its distinct words, and a body with all other columns in which
the column of words holds their places among the distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block is closed when it has so many words or bytes.
WORDS, BYTES = 1 << 20, 32 << 20


def packed(column: str, words: int = WORDS, size: int = BYTES) -> Callable:
    """Batches of rows to one row (words, body) a block; ``column`` has words or lists of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = taken = 0
        for batch in batches:
            held.append(batch)
            n += _count(batch.column(column))
            taken += batch.nbytes
            if n >= words or taken >= size:
                yield _block(pa.Table.from_batches(held), column)
                held, n, taken = [], 0, 0
        if held:
            yield _block(pa.Table.from_batches(held), column)

    return run


def unpacked(column: str, out: str, names: list[str]) -> Callable:
    """A block (words, n, body) and the ids (code, word_id) of its n words to its rows with ``names``.

    A row with an unknown word goes; an unknown word of a list leaves a null.
    """

    def run(block: pa.Table, ids: pa.Table) -> pa.Table:
        words, n = _one(block["words"]).flatten(), block["n"][0].as_py()
        rows = pa.ipc.open_stream(block["body"][0].as_buffer()).read_all().combine_chunks()
        known = pa.nulls(n, pa.int64())
        if ids.num_rows:
            found = ids.sort_by("code").combine_chunks()
            known = found["word_id"].take(_places(found["code"], n)).combine_chunks()
        codes = _one(rows[column])
        if pa.types.is_list(codes.type):
            inside = lambda values: pa.ListArray.from_arrays(codes.offsets, values.take(codes.values))
            rows = rows.append_column(out, inside(known))
            if column in names:
                rows = rows.set_column(rows.schema.get_field_index(column), column, inside(words))
        else:
            rows = rows.append_column(out, known.take(codes)).filter(pc.field(out).is_valid())
        return rows.select(names)

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _count(column: pa.Array) -> int:
    return len(column.flatten()) if pa.types.is_list(column.type) else len(column)


def _places(codes: pa.ChunkedArray, n: int) -> pa.Array:
    """Where each of n codes stands in ``codes``, null if nowhere."""
    return pc.index_in(pa.array(np.arange(n), codes.type), value_set=_one(codes))


def _block(rows: pa.Table, column: str) -> pa.RecordBatch:
    found = _one(rows[column])
    if pa.types.is_list(found.type):
        coded = found.flatten().dictionary_encode()
        codes = pa.ListArray.from_arrays(pc.subtract(found.offsets, found.offsets[0]), coded.indices)
    else:
        coded = found.dictionary_encode()
        codes = coded.indices
    body = rows.set_column(rows.schema.get_field_index(column), column, codes).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(body.combine_chunks())
    words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    return pa.RecordBatch.from_arrays([words, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["words", "body"])
