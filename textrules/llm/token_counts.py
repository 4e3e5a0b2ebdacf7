"""Token counts: texts go to the tokenizer in batches, and only lengths come back.

Inside a task texts are cut into pieces at safe boundaries (a blank run starts a new match of the
vocabulary's own splitting pattern whatever stands before it), pieces not met before are encoded
in batches balanced by bytes, and a text's length is the sum over its pieces. Special strings are
cut out first and count as the library counts them. So a text of any length goes through whole
while no batch holds more than ``batch_bytes`` (one piece without blanks may).

Null and empty texts have 0 bytes and 0 tokens; equal rows get equal rows; an empty table gives
an empty table; other columns of the input stay beside the counts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, row_blocks, text_arrays

# White space as the vocabulary's pattern has it (the Unicode property), not as str.isspace().
_WS = r"\t-\r \x85\xa0  -     　"
#: Whole matches of the vocabulary's pattern, or several in a row, that never depend on neighbours.
PIECE = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _rank_encoding(path: str):
    """The vocabulary of a byte-level BPE file as ranks, or None if it is of another kind.

    Merging by rank equals merging by the file's list of merges when the list makes the tokens
    in the order of their ids; then the faster rank encoder gives the library's lengths.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    if (
        model.get("type") != "BPE"
        or spec.get("normalizer")
        or splitter.get("type") != "ByteLevel"
        or splitter.get("add_prefix_space")
        or not splitter.get("use_regex", True)
        or model.get("dropout")
        or model.get("end_of_word_suffix")
        or model.get("continuing_subword_prefix")
    ):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(set(made)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    specials = {t["content"] for t in spec["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in specials
    }
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


class PieceLengths:
    """Token counts of pieces, with a bounded memory of those met before."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.by_rank = _rank_encoding(path)
        self.batch_bytes, self.limit = batch_bytes, limit
        self.known: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        """Lengths of the pieces, encoded in batches of about ``batch_bytes``."""
        if self.by_rank is not None:
            return list(map(len, map(self.by_rank, pieces)))
        lengths: list[int] = []
        batch: list[str] = []
        size = 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece)
            if size >= self.batch_bytes:
                lengths += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
        lengths += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
        return lengths

    def counts(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                split.append([p for part in parts for p in PIECE.findall(part)])
                extra.append(len(parts) - 1)
            else:
                split.append(PIECE.findall(text))
                extra.append(0)
        wanted: set[str] = set()
        for pieces in split:
            wanted.update(pieces)
        new = sorted(wanted.difference(self.known))
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = sorted(wanted)
        self.known.update(zip(new, self.encode(new), strict=True))
        known = self.known.__getitem__
        found = [sum(map(known, pieces)) + n for pieces, n in zip(split, extra, strict=True)]
        if len(self.known) > self.limit:  # one block with more pieces than that
            self.known.clear()
        return found


_memory: dict[str, PieceLengths] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_bytes and n_tokens of each row's whole text, beside its other columns but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    schema = docs.select(*rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _memory.get(path) or _memory.setdefault(path, PieceLengths(path))
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                sizes = offsets[lo + 1 : hi + 1] - offsets[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(lengths.counts(texts), pa.int64())],
                    names=[*schema.names, "n_bytes", "n_tokens"],
                )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, 
        run, ", ".join([*columns, "n_bytes long", "n_tokens long"])
    )


def query(docs: DataFrame) -> DataFrame:
    """What op4 returns."""
    import public_tokenizers

    found = token_counts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
