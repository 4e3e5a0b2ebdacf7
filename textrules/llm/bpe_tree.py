"""Byte-level BPE as a monoid: a text is encoded in halves, and neighbours are joined.

An element is the encoding of a stretch of text. To join two neighbours, a window around the
seam is decoded, encoded again and put in the place of its tokens. The window grows, twice as many
tokens a time, until the tokens outside provably stay: on either side it must end at a seam of the
splitting pattern that holds whatever stands before it (a single blank between two other
characters starts a match), or at the end of the text. Matches of the pattern are encoded
separately, so nothing on one side of such a seam changes a token on the other.

Decoding concatenates the bytes of tokens up the same tree.

Null and empty texts have no tokens; equal rows get equal rows; an empty table gives an empty
table. Long texts only make the tree higher.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, row_blocks, text_arrays
from textrules.llm.token_counts import PIECE

#: Characters of text that a leaf of the tree encodes at once.
LEAF = 4096
#: Tokens on each side of a seam that the first window holds.
WINDOW = 8

Element = tuple[str, list[int]]


class BpeTree:
    def __init__(self, ranks_path: str, leaf: int = LEAF, window: int = WINDOW, limit: int = 200_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.leaf, self.window, self.limit = leaf, window, limit
        self.known: dict[str, list[int]] = {}

    # -- encoding -------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _leaf(self, text: str) -> list[int]:
        """Encodes a short stretch piece by piece; pieces met before are looked up."""
        known, ids = self.known, []
        for piece in PIECE.findall(text):
            found = known.get(piece)
            if found is None:
                found = self.encoding.encode_ordinary(piece)
                if len(known) >= self.limit:
                    known.clear()
                known[piece] = found
            ids += found
        return ids

    @staticmethod
    def _starts_match(text: str, at: int) -> bool:
        """Whether a match starts at ``at`` for certain: one blank between other characters."""
        return (
            text[at] == " "
            and at + 1 < len(text)
            and not text[at - 1].isspace()
            and not text[at + 1].isspace()
        )

    def _seam_before(self, text: str, lo: int, at: int) -> int:
        """The last certain seam of text[lo:at] at or before ``at``, or ``lo``."""
        while at > lo:
            at = text.rfind(" ", lo, at)
            if at <= lo:
                return lo
            if self._starts_match(text, at):
                return at
        return lo

    def _seam_after(self, text: str, at: int, hi: int) -> int:
        """The first certain seam of text[at:hi] after ``at``, or ``hi``."""
        while True:
            at = text.find(" ", at + 1, hi)
            if at < 0 or at + 1 >= hi:
                return hi
            if self._starts_match(text, at):
                return at

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of its parts at ``mid``."""
        take = self.window
        while True:
            a, b = max(0, len(left) - take), min(len(right), take)
            n_left = sum(len(self.bytes_of[t]) for t in left[a:])
            n_right = sum(len(self.bytes_of[t]) for t in right[:b])
            start = lo if a == 0 else self._seam_before(text, self._back(text, lo, mid, n_left), mid)
            end = hi if b == len(right) else self._seam_after(text, mid, self._on(text, mid, hi, n_right))
            # the window must hold a certain seam on each side, or reach the end there
            left_cut = self._cut_left(text, lo, start, mid, left) if a else 0
            right_cut = self._cut_right(text, mid, end, hi, right) if b < len(right) else len(right)
            if left_cut is not None and right_cut is not None:
                new = self._leaf(text[start:end])
                return left[:left_cut] + new + right[right_cut:]
            take *= 2

    @staticmethod
    def _back(text: str, lo: int, mid: int, n_bytes: int) -> int:
        """Where a window of ``n_bytes`` before ``mid`` begins (never inside a character)."""
        at = mid
        while at > lo and n_bytes > 0:
            at -= 1
            n_bytes -= len(text[at].encode())
        return at

    @staticmethod
    def _on(text: str, mid: int, hi: int, n_bytes: int) -> int:
        at = mid
        while at < hi and n_bytes > 0:
            n_bytes -= len(text[at].encode())
            at += 1
        return at

    def _cut_left(self, text: str, lo: int, start: int, mid: int, left: list[int]) -> int | None:
        """How many tokens of ``left`` stay when it is cut at ``start``; None without a seam."""
        if start == lo:
            return 0
        if text[start] != " " or not self._starts_match(text, start):
            return None
        n, k = len(text[start:mid].encode()), len(left)
        while n > 0:
            k -= 1
            n -= len(self.bytes_of[left[k]])
        return k if n == 0 else None

    def _cut_right(self, text: str, mid: int, end: int, hi: int, right: list[int]) -> int | None:
        """How many tokens of ``right`` go when it is cut at ``end``; None without a seam."""
        if end == hi:
            return len(right)
        if text[end] != " " or not self._starts_match(text, end):
            return None
        n, k = len(text[mid:end].encode()), 0
        while n > 0:
            n -= len(self.bytes_of[right[k]])
            k += 1
        return k if n == 0 else None

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens: leaves are looked up, parents concatenate."""
        return self._bytes(ids, 0, len(ids))

    def _bytes(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return self.encoding.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return self._bytes(ids, lo, mid) + self._bytes(ids, mid, hi)


_memory: dict[str, BpeTree] = {}
_numerals: list[str] = []

OWN = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, ranks_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, the digests of the ids and of the bytes decoded from them, and the ids.

    Other columns stay; columns of the input with one of these names are replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in OWN]
    schema = docs.select(*rest).schema
    names = [*schema.names, text, *(OWN if with_ids else OWN[1:])]
    keep_text = with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _memory.get(ranks_path) or _memory.setdefault(ranks_path, BpeTree(ranks_path))
        if not _numerals:
            _numerals.extend(map(str, range(len(tree.bytes_of))))
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                ids, counts, digests, decoded = [], [], [], []
                for i in range(lo, hi):
                    found = tree.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                    counts.append(len(found))
                    digests.append(hashlib.sha256(",".join(map(_numerals.__getitem__, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tree.decode(found)).hexdigest())
                    if with_ids:
                        ids.append(found)
                part = batch.slice(lo, hi - lo)
                kept = part.columns if keep_text else part.columns[:-1]
                own = [pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                if with_ids:
                    own.insert(0, pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*kept, *own], names=[n for n in names if keep_text or n != text])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    columns += [f"`{text}` string", "ids array<int>"] if with_ids else []
    columns += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, run, ", ".join(columns))


def query(docs: DataFrame) -> DataFrame:
    """What op5 returns."""
    import public_tokenizers

    return encode(
        docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False
    )
