"""Secret scans: candidates in every text, told apart by who else has them.

One pass finds the candidate spans of each whole text. Their hashes are then counted over the
whole corpus by distinct repositories and owners: a value that many owners share is an example
that people copied; one that a single owner (or very few) has and that looks random is a live
credential. Counting goes over (value, owner, repository), then (value, owner), then (value), so
no value's rows meet in one task; the verdicts come back by a join that deals common values apart.

Besides the base kinds the method finds ``opaque`` spans, long mixed tokens that only ownership
can judge: they are spans of a document when live.

Null and empty texts have no spans; null owners and repositories count as one of their own;
repeated rows are judged alone but count once as a place; an empty table gives an empty table.
Texts go through whole, whatever their length. Only hashes of values leave the scan. Spans that begin at
one place go by kind; a value at the limits of owners and repositories counts as an example. Other
columns may have any names: ``redact`` sets them aside, the scan gives those it is told to keep.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import in_arrow, row_blocks, set_aside, text_arrays
from textrules.llm.store import stored
from textrules.operators.skew import join_skewed

# The base patterns. Minimum lengths are in the patterns where a run is maximal.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "opaque")
LEAST = {"assign": 8, "access": 16}

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int, str]  # start, kind, end, value


@dataclass(frozen=True)
class Ownership:
    """When a value counts as an example, and what a live one looks like."""

    example_owners: int = 3
    example_repositories: int = 4
    least_bits: float = 2.5  # entropy of the value's characters


def find_spans(text: str) -> list[Span]:
    """Candidate spans in the order of their start, then kind; offsets are code points."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST["access"]:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    if _DIGIT.search(text):
        base = [(s, e) for s, _, e, _ in found]
        for m in OPAQUE.finditer(text):
            v = m[0]
            mixed = _DIGIT.search(v) and v != v.lower() and v != v.upper()
            if mixed and not any(s < m.end() and m.start() < e for s, e in base):
                found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


CANDIDATES = "array<struct<kind:string,start:int,end:int,digest:string,bits:double>>"
_CANDIDATE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string()), ("bits", pa.float64())])
)
SCAN = f"n_assign long, n_access long, n_hex long, base_sha256 string, candidates {CANDIDATES}"
SCANNED = ("n_assign", "n_access", "n_hex", "base_sha256", "candidates")


def scan(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Candidates of every row beside its other columns (and its text if asked for)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in SCANNED]
    schema = docs.select(*rest).schema
    kept = [*schema.names, *([text] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                counts: list[list[int]] = [[], [], []]
                digests, candidates = [], []
                for i in range(lo, hi):
                    spans = find_spans(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                    base = [x for x in spans if x[1] < 3]
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                    candidates.append([
                        {
                            "kind": KINDS[k], "start": s, "end": e, "bits": entropy(v),
                            "digest": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(),
                        }
                        for s, k, e, v in spans
                    ])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(kept)],
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array(digests, pa.string()),
                        pa.array(candidates, _CANDIDATE),
                    ],
                    names=[*kept, *SCANNED],
                )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    columns += [f"`{text}` string"] if keep_text else []
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, run, ", ".join([*columns, SCAN]))


def ownership(candidates: DataFrame) -> DataFrame:
    """n_owners and n_repositories of every digest (digest, owner, repository)."""
    places = candidates.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = places.groupBy("digest", "owner").agg(F.count("one").alias("n"))
    return owners.groupBy("digest").agg(
        F.count("n").alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def secret_scan(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    rule: Ownership = Ownership(),
    keep_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its counts, base digest and judged candidates.

    ``judged`` holds kind, start, end, verdict (live, example or weak), n_owners and
    n_repositories of each candidate in order; it is empty, not null, where there are none.
    """
    scanned = stored(
        scan(docs, keep_text=keep_text).withColumn("_row", F.monotonically_increasing_id()), "secret-scan"
    )
    rows = scanned.filter(F.size("candidates") > 0).select(
        "_row",
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.col(f"`{repository}`").cast("string").alias("repository"),
        F.explode("candidates").alias("c"),
    ).select("_row", "owner", "repository", "c.*")
    verdict = (
        F.when(
            (F.col("n_owners") >= rule.example_owners) & (F.col("n_repositories") >= rule.example_repositories),
            "example",
        )
        .when(F.col("bits") < rule.least_bits, "weak")
        .otherwise("live")
    )
    order = F.transform(
        F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "verdict", "n_owners", "n_repositories"))),
        lambda x: F.struct(*(x[n].alias(n) for n in ("kind", "start", "end", "verdict", "n_owners", "n_repositories"))),
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank")
    judged = (
        join_skewed(rows, ownership(rows), "digest")
        .select("*", rank, verdict.alias("verdict"))
        .groupBy("_row")
        .agg(order.alias("judged"))
    )
    found = scanned.join(judged, "_row", "left").drop("_row", "candidates")
    empty = F.array().cast(judged.schema["judged"].dataType)
    return found.withColumn("judged", F.coalesce("judged", empty))


def span_line(only_live: bool = False):
    """The judged spans as kind:start:end joined by commas: all base spans, and live opaque ones."""
    wanted = F.filter(
        F.col("judged"),
        lambda x: (x["verdict"] == "live") if only_live else (x["kind"] != "opaque") | (x["verdict"] == "live"),
    )
    return F.concat_ws(",", F.transform(wanted, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def query(docs: DataFrame) -> DataFrame:
    """What op10 returns."""
    found = secret_scan(docs.select("doc_id", "source", "text"))
    count = lambda verdict: F.size(F.filter("judged", lambda x: x["verdict"] == verdict)).cast("long")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_line().alias("spans"),
        span_line(True).alias("live_spans"), count("live").alias("n_live"), count("example").alias("n_example"),
    )


def redact(docs: DataFrame, rule: Ownership = Ownership(), mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every live span of their texts replaced by ``mark``.

    All columns stay as they are, n_chars (if there) follows the text.
    """
    docs, back = set_aside(docs, ("doc_id", "text", "source", "n_chars"))
    found = secret_scan(docs, rule=rule, keep_text=True)
    live = F.filter("judged", lambda x: x["verdict"] == "live")
    # Left to right; a span that begins inside the one before only moves the end.
    pieces = F.aggregate(
        live,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("done"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(s["done"].alias("done"), F.greatest(s["at"], x["end"]).alias("at"))),
    )
    rest = lambda s: F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    text = F.when(F.size(live) > 0, rest(pieces)).otherwise(F.col("text"))
    changed = found.withColumn("_live", F.size(live)).withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.col("_live") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return back(changed)
