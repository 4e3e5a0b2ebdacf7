"""Dense numbers over large tables without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAD_BITS = 14
# Blocks of blocks: a prefix sum runs over at most 2^21 of them, and over 256 at the top.
UPPER_BITS = 21
TAIL_BLOCK = 1 << 16


def _before(counts: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in all earlier cells, as ``_before``."""
    window = (
        Window.partitionBy(*part) if part else Window.partitionBy()
    ).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))


def number_rows(
    df: DataFrame,
    lead: str = "post_id",
    tail: str = "sentence_seq",
    by: Sequence[str] = (),
    start: int = 0,
    out: str = "rnum",
    lead_bits: int = LEAD_BITS,
    tail_block: int = TAIL_BLOCK,
) -> DataFrame:
    """Number rows from ``start`` in (lead, tail) order, separately for each ``by`` group.

    (by, lead, tail) must be unique and both order columns integral. Rows are sorted only
    within a cell of at most ``tail_block`` tail values of one lead value, so neither one
    hot group nor one hot lead value ends in a single task. Offsets come from prefix sums of
    counts: cells within a block of lead values, blocks within blocks of blocks, and so on up to
    at most 256 of a group. So however sparse the lead values are, no sum runs over all of them.
    """
    by = list(by)
    celled = df.withColumn("_cell", F.expr(f"`{tail}` div {tail_block}"))
    cells = celled.groupBy(*by, lead, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_block0", F.shiftright(F.col(lead).cast("long"), lead_bits))
    levels, shift = [], lead_bits
    below = cells
    while True:
        k = len(levels)
        level = below.groupBy(*by, f"_block{k}").agg(F.sum("_n").alias("_n"))
        shift += UPPER_BITS
        if shift < 64:
            level = level.withColumn(f"_block{k + 1}", F.shiftright(f"_block{k}", UPPER_BITS))
        levels.append(level)
        if shift >= 64:
            break
        below = level
    above = None
    for k in range(len(levels) - 1, -1, -1):
        part = [*by, f"_block{k + 1}"] if k + 1 < len(levels) else by
        level = _before(levels[k], part, [f"_block{k}"])
        if above is not None:
            level = level.join(above, part, "left")
        total = F.col("_before") + (F.col("_above") if above is not None else F.lit(0))
        above = level.select(*by, f"_block{k}", total.alias("_above"))
    cells = _before(cells, [*by, "_block0"], [lead, "_cell"]).drop("_n")
    # Every key is found; left joins add no null checks, so the counts are computed once.
    cells = cells.join(above, [*by, "_block0"], "left").select(
        *by, lead, "_cell", (F.col("_before") + F.col("_above")).alias("_offset")
    )
    within = F.row_number().over(Window.partitionBy(*by, lead, "_cell").orderBy(tail))
    numbered = celled.withColumn("_row", within).join(cells, [*by, lead, "_cell"], "left")
    return numbered.withColumn(
        out, (F.col("_offset") + F.col("_row") + F.lit(start - 1)).cast("long")
    ).select(*df.columns, out)


WORD_BUCKET_CHARS = 3


def number_words(words: DataFrame, word: str = "word", out: str = "word_id", start: int = 1) -> DataFrame:
    """Number distinct strings densely, in the order (hash prefix, string).

    Alphabetical ranges can be badly uneven; prefixes of a hash are even for any set of
    distinct strings, so each task sorts about the same small share.
    """
    bucketed = words.withColumn("_bucket", F.substring(F.md5(word), 1, WORD_BUCKET_CHARS))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = _before(counts, [], ["_bucket"]).select("_bucket", "_before")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(word))
    return (
        bucketed.withColumn("_row", within)
        # at most 16 ** WORD_BUCKET_CHARS rows; a left join puts no null check, and with it
        # the hash, on the rows that the distinct strings come from
        .join(F.broadcast(counts), "_bucket", "left")
        .withColumn(out, (F.col("_before") + F.col("_row") + F.lit(start - 1)).cast("long"))
        .select(*words.columns, out)
    )
