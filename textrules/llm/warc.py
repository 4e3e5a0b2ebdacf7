"""WARC files: writing records with revisits, and reading them back by boundary chains.

Writing is a text sink whose line separator is the two line ends that close a record, so Spark
writes the archives to any store. Equal payloads are kept once: the others are revisit records.

Reading cuts the files at the magic ``WARC/1.0`` line, wherever it stands: Spark's text reader
splits files at a separator across block borders, so every task emits candidates from its part of
a file, each with the offset of the record and of its successor (from Content-Length). Payloads
may hold the magic too. A chain of successors from the file's start tells true records: pointer
jumping first inside zones of a few MB of a file, then over the zones, retains only candidates
that are reachable. Records whose payload holds magic are put together from their pieces.

Null payloads are empty ones; null ids never are or have revisits; repeated rows with the smallest
id are all responses (a tie on the smallest id makes no revisit); an empty table gives empty archives.
One record (page) must fit a task. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textrules.llm.common import in_arrow, ship
from textrules.llm.store import folder, stored
from textrules.operators.skew import join_skewed
from textrules.session import checked_broadcast

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Bytes of a file whose candidates one task chains.
ZONE = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 8 groups of 20 bits, 4 letters each."""
    digits = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload an earlier id has too."""
    own = pages.filter(F.col("page_id").isNotNull() & (F.col("n_bytes") >= least_bytes)).select("page_id", "digest")
    first = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").drop("n")
    return join_skewed(own, first, "digest").filter("page_id > refers_to").distinct()


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of (page_id, url, payload): one archive per task."""
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.coalesce(F.col("payload"), F.lit("")).alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload")})
    seen = checked_broadcast(stored(revisits(rows, least_bytes), "revisits"))
    rows = rows.join(seen, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"), F.lit(END),
    )
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(
            again,
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)


# -- candidates ---------------------------------------------------------------------------

FIELDS = (
    ("warc_type", rb"WARC-Type:[ \t]*([^\r\n]*)"),
    ("record_id", rb"WARC-Record-ID:[ \t]*([^\r\n]*)"),
    ("target_uri", rb"WARC-Target-URI:[ \t]*([^\r\n]*)"),
    ("refers_to", rb"WARC-Refers-To:[ \t]*([^\r\n]*)"),
    ("header_digest", rb"WARC-Payload-Digest:[ \t]*(?:sha1:)?([^\r\n]*)"),
)
_FIELDS = [(n, re.compile(rb"(?:^|\r\n)" + p, re.I)) for n, p in FIELDS]
_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.I)
RECORD = (
    "warc_type string, record_id string, target_uri string, refers_to string, header_digest string, "
    "http_length long, payload_bytes long, payload_digest string, payload binary"
)
RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def parse_record(piece: bytes, with_payload: bool) -> tuple[int | None, bool, dict]:
    """Length of the record after the magic, whether the piece holds all of it, and its fields."""
    cut = piece.find(b"\r\n\r\n")
    length = _LENGTH.search(piece[:cut]) if cut >= 0 else None
    if length is None:
        return None, False, {}
    head, n = piece[:cut], int(length[1])
    size = cut + 4 + n + 4
    if len(piece) < cut + 4 + n:
        return size, False, {}
    block = piece[cut + 4 : cut + 4 + n]
    fields: dict = {}
    for name, pattern in _FIELDS:
        m = pattern.search(head)
        fields[name] = m[1].decode("utf-8", "replace") if m else None
    http, _, payload = block.partition(b"\r\n\r\n")
    of = _LENGTH.search(http)
    fields |= {
        "http_length": int(of[1]) if of else None,
        "payload_bytes": len(payload),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "payload": payload if with_payload else None,
    }
    return size, True, fields


_RECORD_TYPES = {"http_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}


def _record_arrays(found: list[dict]) -> list[pa.Array]:
    return [pa.array([x.get(n) for x in found], _RECORD_TYPES.get(n, pa.string())) for n in RECORD_NAMES]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at the magic: file, block (where the reader's part begins) and the bytes."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )


def _candidates(spark: SparkSession, path: str, with_payload: bool, raw: bool = False) -> DataFrame:
    """Each piece with its place in its block; ``raw`` gives the bytes instead of the fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            place, size, whole, found = [], [], [], []
            pieces = batch.column(2)
            for i, where in enumerate(zip(files, blocks, strict=True)):
                if where != at:
                    at, rel = where, 0
                place.append(rel)
                rel += len(pieces[i].as_buffer()) + len(MAGIC)
                if not raw:
                    n, complete, fields = parse_record(pieces[i].as_py(), with_payload)
                    size.append(n)
                    whole.append(complete)
                    found.append(fields)
            ends = [p + len(pieces[i].as_buffer()) + len(MAGIC) for i, p in enumerate(place)]
            own = [pa.array(place, pa.int64()), pa.array(ends, pa.int64())]
            if raw:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own, pieces], names=["file", "block", "rel", "rel_end", "piece"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], *own, pa.array(size, pa.int64()), pa.array(whole, pa.bool_()), *_record_arrays(found)],
                    names=["file", "block", "rel", "rel_end", "size", "complete", *RECORD_NAMES],
                )

    place = "file string, block long, rel long, rel_end long"
    return _pieces(spark, path).transform(in_arrow, run, f"{place}, piece binary" if raw else f"{place}, size long, complete boolean, {RECORD}")


def _bases(candidates: DataFrame) -> DataFrame:
    """Where each block's first piece begins in its file: sums of the blocks before."""
    blocks = candidates.groupBy("file", "block").agg(F.max("rel_end").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


# -- boundary chains ----------------------------------------------------------------------


def _next_in_zone(off: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among the zone's candidates; -1 if there is none."""
    if not len(off):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(off, succ), len(off) - 1)
    return np.where(off[at] == succ, at, -1)


def zone_exits(zone: pd.DataFrame, size: int = ZONE) -> pd.DataFrame:
    """Pointer jumping inside one zone: ``leave`` is where each candidate's chain goes beyond it."""
    zone = zone.sort_values("off", ignore_index=True)
    off, succ = zone["off"].to_numpy(), zone["succ"].to_numpy()
    border = (off[0] // size + 1) * size
    jump = _next_in_zone(off, succ)
    last = np.where(jump < 0, np.arange(len(off)), jump)
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    leave = succ[last]
    return pd.DataFrame({"file": zone["file"], "off": off, "leave": np.where(leave >= border, leave, -1)})


def zone_marks(zone: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one zone that a chain from an entry reaches."""
    zone = zone.sort_values("off", ignore_index=True)
    off = zone["off"].to_numpy()
    jump = _next_in_zone(off, zone["succ"].to_numpy())
    mark = zone["entry"].to_numpy().copy()
    jump = np.where(jump < 0, np.arange(len(off)), jump)
    while True:
        before = mark.sum()
        mark[jump[mark]] = True
        jump = jump[jump]
        if mark.sum() == before and (jump[jump] == jump).all():
            break
    return pd.DataFrame({"file": zone["file"], "off": off, "reached": mark})


def reachable(candidates: DataFrame, zone_bytes: int = ZONE) -> DataFrame:
    """(file, off) of the candidates on the chain from their file's start.

    ``candidates`` has file, off and succ. A zone's candidates are chained in one task; chains
    over zones double their stride each round, so a file of n zones takes log2(n) rounds.
    """
    ship(candidates.sparkSession)
    rows = candidates.select("file", "off", F.coalesce("succ", F.lit(-1)).alias("succ"), F.expr(f"off div {zone_bytes}").alias("zone"))
    exits = stored(
        rows.groupBy("file", "zone").applyInPandas(lambda z: zone_exits(z, zone_bytes), "file string, off long, leave long"),
        "warc-exits",
    )
    marked = exits.select("file").distinct().withColumn("off", F.lit(0).cast("long"))
    zones = (exits.agg(F.max("off")).first()[0] or 0) // zone_bytes + 1
    if zones > 1:
        targets = exits.filter("leave >= 0").select("file", F.col("leave").alias("off")).unionByName(marked).distinct()
        jumps = exits.join(targets, ["file", "off"], "left_semi")
        for _ in range(int(zones).bit_length()):
            step = jumps.filter("leave >= 0")
            marked = stored(
                marked.unionByName(marked.join(step, ["file", "off"]).select("file", F.col("leave").alias("off"))).distinct(),
                "warc-marked",
            )
            far = step.select("file", F.col("off").alias("leave"), F.col("leave").alias("_next"))
            jumps = stored(
                jumps.join(far, ["file", "leave"], "left").select("file", "off", F.coalesce("_next", F.lit(-1)).alias("leave")),
                "warc-jumps",
            )
    entries = marked.withColumn("entry", F.lit(True))
    flagged = rows.join(entries, ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    found = flagged.groupBy("file", "zone").applyInPandas(zone_marks, "file string, off long, reached boolean")
    return found.filter("reached").select("file", "off")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, zone_bytes: int = ZONE) -> DataFrame:
    """The true records of the archives in ``path``: file, off and the fields of RECORD.

    Payloads themselves come along only when asked for; their sizes and digests always do.
    """
    table = stored(_candidates(spark, path, with_payload), "warc-candidates")
    bases = _bases(table)
    placed = (
        table.join(bases, ["file", "block"])
        .withColumn("off", F.col("base") + F.col("rel") - len(MAGIC))
        .filter("off >= 0")
        .withColumn("succ", F.col("off") + len(MAGIC) + F.col("size"))
    )
    true = stored(reachable(placed, zone_bytes), "warc-reachable")
    records = placed.join(true, ["file", "off"])
    whole = records.filter("complete").select("file", "off", *RECORD_NAMES)
    broken = records.filter(~F.col("complete") & F.col("size").isNotNull()).select("file", "off", "succ")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_joined(spark, path, bases, placed, true, broken, with_payload))


def _joined(spark, path, bases, placed, true, broken, with_payload) -> DataFrame:
    """Records whose payload holds magic, put together from the pieces up to their end."""
    owner = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = (
        placed.select("file", "block", "rel", "off")
        .join(true.withColumn("true_off", F.col("off")), ["file", "off"], "left")
        .withColumn("owner", F.last("true_off", ignorenulls=True).over(owner))
        .join(broken.select("file", F.col("off").alias("owner"), "succ"), ["file", "owner"])
        .filter("off < succ")
        .select("file", "block", "rel", "owner")
    )
    pieces = _candidates(spark, path, False, raw=True).select("file", "block", "rel", "piece")
    parts = pieces.join(checked_broadcast(stored(owned, "warc-parts")), ["file", "block", "rel"])
    in_order = F.sort_array(F.collect_list(F.struct("block", "rel", F.col("piece").cast("string").alias("piece"))))
    texts = parts.groupBy("file", "owner").agg(
        F.array_join(F.transform(in_order, lambda x: x["piece"]), MAGIC).cast("binary").alias("piece")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_record(x.as_py(), with_payload) for x in batch.column(2)]
            keep = [i for i, x in enumerate(found) if x[1]]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], *_record_arrays([found[i][2] for i in keep])], names=["file", "off", *RECORD_NAMES]
            )

    return texts.transform(in_arrow, run, f"file string, off long, {RECORD}")


def query(pages: DataFrame) -> DataFrame:
    """What op2 returns: archives are written to the shared folder and read back."""
    path = folder(pages, "warc")
    write_warc(pages.select("page_id", "url", F.col("html").alias("payload")), path)
    records = read_warc(pages.sparkSession, path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    again = F.col("warc_type") == "revisit"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(again, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("header_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(again, number(F.col("refers_to"))).alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
groups AS (
  SELECT page_id, body, unnest(range(8)) AS g, d FROM p),
digests AS (
  SELECT page_id, body, string_agg(part, '' ORDER BY g) AS payload_digest FROM (
    SELECT page_id, body, g,
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS INTEGER) + 1, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INTEGER) + 1, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INTEGER) + 1, 1) ||
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INTEGER) + 1, 1) AS part
    FROM (SELECT page_id, body, g, CAST('0x' || substr(d, g * 5 + 1, 5) AS BIGINT) AS v FROM groups))
  GROUP BY page_id, body),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM digests)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
