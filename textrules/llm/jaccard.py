"""N-gram Jaccard join: sets of 5-word shingles, joined through count vectors, verified exactly.

Words are cut at blanks, A-Z lower-cased. Two texts link when 100 * intersection >= 80 * union of
their shingle sets. The result is each text's component under these links; it is exact, up to
collisions of 64-bit shingle hashes (sets are told apart by 128 bits).

The join bounds overlaps by summed coordinate minima of count vectors, twice:

* Over all shingle hashes as coordinates (a sparse vector of ones): in any fixed order of the
  coordinates, two sets that share none of their first n - ceil(0.8 n) + 1 coordinates have a sum
  of minima, and so an overlap, below 0.8 n. So texts meet in the tiles of those coordinates only.
  The order puts coordinates that a sample of texts has often last, so hot shingles (a line or
  passage that very many texts have) are tiles only of texts that consist of little else. The
  order changes cost, never results.
* Over groups of shingles as coordinates (dense vectors, about as many groups as shingles, and a
  power of two of them so that two vectors fold to one length): pairs in a tile are dropped when
  the sum of minima over the groups is too small. So few shingles share a group by chance that
  hardly any pair below the limit survives. In tiles with many texts the vectors stand in a
  packed R-tree, whose leaves' maxima bound all pairs of two leaves at once.

Equal sets are one node throughout. Links are searched in two rounds so that a tile of m copies
does not give m * m pairs: first each node meets its neighbours in its tiles, in an order by
min-hashes that puts like sets side by side; verified links make components. Then every pair of
nodes of *different* components in a tile is bounded. The survivors are verified in two goes: first the
likest that make a spanning forest of the components that a task has at hand, m - 1 pairs at most, which
joins nearly all that links; then, in the tiles that have more and whose components are still apart, all
pairs, each in one of the tiles that its sets share.
Pairs inside a component need no look: they change nothing.

Null and empty texts, and texts without words, have an empty set and link with nothing. Texts of
fewer than five words have one shingle, the whole sequence. Null ids never are a component's name
unless all its ids are null. Repeated rows are in one component. Empty tables give empty tables.
``jaccard_join`` takes the columns it is given; ``one_of_each`` sets all others aside, so they may have
any names and come back as they were. Of equal ids and texts one row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrules.llm.common import WordHasher, blank_words, in_arrow, mix, row_blocks, set_aside, shingle_hashes, text_arrays
from textrules.llm.components import components
from textrules.llm.store import stored
from textrules.operators.skew import join_skewed
from textrules.session import checked_broadcast

SHINGLE = 5
#: Least groups of a count vector, and groups that the tree and its leaves work with.
GROUPS, COARSE = 64, 64
LEAF = 32
#: Tiles of so many sets are searched pair by pair, larger ones by a tree.
SMALL = 24
#: One text in so many is looked at for the order of coordinates; at most so many go last.
SAMPLE, LATE = 16, 300_000
#: Orders by min-hash, dealt to the tiles.
SIGNS = 4
#: Nodes that a task remembers to have given; a node given twice does no harm.
REMEMBERED = 50_000
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """Shingle sets of the rows of a block of texts, as sorted arrays of hashes."""

    def __init__(self):
        self.hasher = WordHasher(blank_words())

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        _, _, words, rows = self.hasher.words(data, offsets)
        runs = shingle_hashes(words, SHINGLE)
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if hi - lo >= SHINGLE:
                yield np.unique(runs[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield shingle_hashes(words[lo:hi], hi - lo)
            else:
                yield runs[:0]


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = mix(shingles ^ _SALT).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix_length(n: int) -> int:
    """So many first coordinates must share one with any set of similarity 0.8."""
    return n - (4 * n + 4) // 5 + 1


def tile_keys(shingles: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The coordinates of a set's tiles: its first ones, those in ``late`` after all others."""
    hashes, place = late
    n = prefix_length(len(shingles))
    if not len(hashes):
        return shingles[:n]
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    rank = np.where(hashes[at] == shingles, place[at], 0)
    return shingles[np.argsort(rank, kind="stable")[:n]]


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """Sizes of the groups that a set's shingles fall into, each below 16, two in a byte."""
    n = max(GROUPS, 1 << int(round(np.log2(max(1, len(shingles))))))
    while True:
        counts = np.bincount((shingles >> np.uint64(20)) & np.uint64(n - 1), minlength=n)
        if counts.max() < 16:
            return (counts[0::2] | counts[1::2] << 4).astype(np.uint8)
        n *= 2


def unpacked(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of counts."""
    flat = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    return np.stack([flat & 15, flat >> 4], axis=2).reshape(len(vectors), -1).astype(np.uint16)


def fold(counts: np.ndarray, n: int) -> np.ndarray:
    """Count vectors (rows) over ``n`` groups, fewer than they have."""
    while counts.shape[1] > n:
        half = counts.shape[1] // 2
        counts = counts[:, :half] + counts[:, half:]
    return counts


def folded(vectors: list[bytes], most: int = 1 << 62) -> np.ndarray:
    """Vectors of any lengths as rows over the fewest groups that one of them has, or ``most``."""
    size = np.array([len(v) for v in vectors])
    n = min(2 * int(size.min()), most)
    out = np.zeros((len(vectors), n), np.uint16)
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        out[at] = fold(unpacked([vectors[i] for i in at]), n)
    return out


def may_link(n1: np.ndarray, n2: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    return 9 * overlap >= 4 * (n1 + n2)


def overlaps(vectors: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sums of minima of the pairs (x, y) of sets."""
    size = np.array([len(v) for v in vectors])
    groups = 2 * np.minimum(size[x], size[y])
    sums = np.zeros(len(x), np.int64)
    for g in np.unique(groups):  # pairs of like length go together, some MB at a time
        pairs = np.flatnonzero(groups == g)
        for at in np.array_split(pairs, 1 + len(pairs) * int(g) // (1 << 22)):
            used, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            rows = folded([vectors[i] for i in used], int(g))
            sums[at] = np.minimum(rows[place[: len(at)]], rows[place[len(at) :]]).sum(axis=1, dtype=np.int64)
    return sums


def bounded(n: np.ndarray, vectors: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of sets have a sum of minima that leaves room for a link."""
    return may_link(n[x], n[y], overlaps(vectors, x, y))


def _signs(shingles: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        salts = (np.arange(1, SIGNS + 1, dtype=np.uint64) * _SALT)[:, None]
        return (mix(shingles[None] ^ salts).min(axis=1) >> np.uint64(33)).astype(np.int64).tolist()


_NODE = pa.struct([("a", pa.int64()), ("b", pa.int64())])
TABLE = "n_shingles long, node struct<a:long,b:long>, keys array<long>, signs array<int>, counts binary"


def _node_array(nodes: list[tuple[int, int] | None]) -> pa.Array:
    return pa.array([None if x is None else {"a": x[0], "b": x[1]} for x in nodes], _NODE)


def late_coordinates(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample has often, with ranks that put the commonest last. Bounded by LATE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles()
        for batch in batches:
            data, offsets = text_arrays(batch.column(0))
            for lo, hi in row_blocks(offsets):
                sets = list(maker.sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                flat, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"]
                )

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.transform(in_arrow, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2")
    table = counts.orderBy(F.desc("n"), "key").limit(LATE).toArrow()
    keys = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], 1 + np.floor(np.log2(table["n"].to_numpy()[order])).astype(np.int64)


def set_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row's set: its size, node, tiles, signs and group counts, beside its other columns.

    A task gives the tiles of a node once; later rows of the same node have null there.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    schema = docs.select(*rest).schema
    late = docs.sparkSession.sparkContext.broadcast(late_coordinates(docs.select(F.col(f"`{text}`").alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, given = Shingles(), set()
        for batch in batches:
            data, offsets = text_arrays(batch.column(len(schema)))
            for lo, hi in row_blocks(offsets):
                sizes, nodes, keys, signs, counts = [], [], [], [], []
                for shingles in maker.sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    node = node_of(shingles) if len(shingles) else None
                    new = node is not None and node not in given
                    sizes.append(len(shingles))
                    nodes.append(node)
                    keys.append(tile_keys(shingles, late.value).view(np.int64) if new else None)
                    signs.append(_signs(shingles) if new else None)
                    counts.append(group_counts(shingles).tobytes() if new else None)
                    if new:
                        if len(given) >= REMEMBERED:
                            given.clear()
                        given.add(node)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], pa.array(sizes, pa.int64()), _node_array(nodes),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int32())),
                        pa.array(counts, pa.binary()),
                    ],
                    names=[*schema.names, "n_shingles", "node", "keys", "signs", "counts"],
                )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return docs.select(*rest, F.col(f"`{text}`")).transform(in_arrow, run, ", ".join([*columns, TABLE]))


# -- pairs --------------------------------------------------------------------------------


def _tiles(sets: DataFrame) -> DataFrame:
    """(key, half, next, three), one row for each node of a tile that has two nodes or more.

    ``next`` is the neighbour by min-hash, null for the last node; ``three`` tells whether the tile
    has three rows or more. Nodes go by the first half of their 128 bits here, as most of these
    rows are met by none; ``_bounded`` and ``_tile_rows`` look up all nodes that have it. Rows of
    one node lie side by side; the last of them stays.
    """
    rows = sets.filter(F.col("keys").isNotNull()).select(
        F.col("node.a").alias("half"), "signs", F.explode("keys").alias("key")
    )
    rows = rows.select("key", "half", F.element_at("signs", (F.pmod("key", F.lit(SIGNS)) + 1).cast("int")).alias("sign"))
    order = Window.partitionBy("key").orderBy("sign", "half")
    at = lambda k: F.lead("half", k).over(order) if k > 0 else F.lag("half", -k).over(order)
    there = lambda k: F.col(f"at_{k}").isNotNull()
    near = rows.select(
        "key", "half", F.first("half").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("begin"),
        at(-2).alias("at_-2"), at(-1).alias("at_-1"), at(1).alias("next"), at(2).alias("at_2"),
    ).withColumn("at_1", F.col("next"))
    last = F.coalesce(F.col("next") != F.col("half"), F.lit(True))
    several = F.col("next").isNotNull() | (F.col("begin") != F.col("half"))
    three = (there(-2) & there(-1)) | (there(-1) & there(1)) | (there(1) & there(2))
    return near.filter(last & several).select("key", "half", "next", three.alias("three"))


def _vectors(sets: DataFrame) -> DataFrame:
    given = sets.filter(F.col("keys").isNotNull())
    return given.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("counts").alias("counts"))


def _bounded(halves: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (x, y) of nodes with halves (half_x, half_y) whose group counts leave room for a link."""
    side = lambda name, c, short: vectors.select(F.col("node").alias(name), F.col(c).alias(f"{short}_{name}"))
    named = lambda name: vectors.select(
        F.col("node.a").alias(f"half_{name}"), F.col("node").alias(name), F.col("n").alias(f"n_{name}")
    )
    # Sizes first: they drop most pairs, so that few vectors are moved.
    sized = halves.join(named("x"), "half_x").join(named("y"), "half_y").select("x", "y", "n_x", "n_y")
    sized = stored(sized.filter("9 * least(n_x, n_y) >= 4 * (n_x + n_y)"), "jaccard-sized")
    wide = sized.join(side("x", "counts", "c"), "x").join(side("y", "counts", "c"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(k).to_numpy() for k in (2, 3)])
            vectors = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            at = np.arange(batch.num_rows)
            keep = pa.array(bounded(n, vectors, at, at + batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["x", "y"])

    node = "struct<a:long,b:long>"
    return wide.select("x", "y", "n_x", "n_y", "c_x", "c_y").transform(in_arrow, run, f"x {node}, y {node}")


def _wanted_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs``, read from one text of each."""
    nodes = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    texts = sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    hashes = stored(nodes.join(texts, "node").select("text_hash").distinct(), "jaccard-texts")
    own = docs.select("text").withColumn("text_hash", F.xxhash64("text"))
    own = own.join(checked_broadcast(hashes), "text_hash", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, given = Shingles(), set()
        for batch in batches:
            data, offsets = text_arrays(batch.column(0))
            for lo, hi in row_blocks(offsets):
                nodes, values = [], []
                for shingles in maker.sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    node = node_of(shingles)
                    if len(shingles) and node not in given:
                        if len(given) >= REMEMBERED:
                            given.clear()
                        given.add(node)
                        nodes.append(node)
                        values.append(shingles.tobytes())
                yield pa.RecordBatch.from_arrays([_node_array(nodes), pa.array(values, pa.binary())], names=["node", "shingles"])

    found = own.transform(in_arrow, run, "node struct<a:long,b:long>, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, sets: DataFrame, left: DataFrame, name: str) -> DataFrame:
    """The pairs (x, y) that link, by their whole sets."""
    whole = stored(_wanted_sets(docs, sets, left), f"{name}-sets")
    side = lambda c: whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    wide = left.join(side("x"), "x").join(side("y"), "y").select("x", "y", "s_x", "s_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["x", "y"]
            )

    node = "struct<a:long,b:long>"
    return stored(wide.transform(in_arrow, run, f"x {node}, y {node}"), f"{name}-links")


def tree_pairs(n: np.ndarray, counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of different groups whose sum of minima leaves room for a link.

    The points are packed into leaves in the order of their size, then of their largest spread;
    two leaves meet when the sum of minima of their maxima could do for their smallest sets.
    """
    order = np.lexsort((counts[:, int(counts.var(axis=0).argmax())], n))
    begin = np.arange(0, len(n), LEAF)
    n, counts, group = n[order], counts[order], group[order]
    top = np.maximum.reduceat(counts, begin, axis=0)
    small, large = np.minimum.reduceat(n, begin), np.maximum.reduceat(n, begin)
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(begin)):
        # sizes of linked sets differ by a quarter at most; leaves are in the order of sizes
        stop = int(np.searchsorted(small, large[i] * 5 / 4 + 1, "right"))
        leaves = np.arange(i, max(stop, i + 1))
        bound = np.minimum(top[i], top[leaves]).sum(axis=1, dtype=np.int64)
        leaves = leaves[may_link(small[i], small[leaves], bound)]
        a = np.arange(begin[i], min(begin[i] + LEAF, len(n)))
        for j in leaves.tolist():
            b = np.arange(begin[j], min(begin[j] + LEAF, len(n)))
            overlap = np.minimum(counts[a][:, None], counts[b][None]).sum(axis=2, dtype=np.int64)
            fits = may_link(n[a][:, None], n[b][None], overlap) & (group[a][:, None] != group[b][None])
            if i == j:
                fits &= a[:, None] < b[None]
            x, y = np.nonzero(fits)
            one.append(order[a[x]])
            two.append(order[b[y]])
    return np.concatenate(one), np.concatenate(two)


def _tile_runs(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their tile as batches of whole tiles, some thousand rows at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < rows:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        tile = whole.column(0).to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
        if cut:
            yield whole.slice(0, cut)
        kept = [whole.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def tile_pairs(
    tile: np.ndarray, n: np.ndarray, vectors: list[bytes], group: np.ndarray, upper: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile, of different groups, whose counts leave room for a link, the likest first.

    ``upper`` marks rows that stand in the band above their own: two of them meet elsewhere.
    """
    begin = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
    size = np.diff(np.append(begin, len(tile)))
    of_tile = np.repeat(size, size)
    one, two = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero((tile[step:] == tile[:-step]) & (of_tile[step:] <= SMALL))
        if not len(at):
            break
        one.append(at)
        two.append(at + step)
    for k in np.flatnonzero(size > SMALL).tolist():
        rows = slice(begin[k], begin[k] + size[k])
        x, y = tree_pairs(n[rows], folded(vectors[rows], COARSE), group[rows])
        one.append(begin[k] + x)
        two.append(begin[k] + y)
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(one), np.concatenate(two)
    near = (group[x] != group[y]) & ~(upper[x] & upper[y])
    near &= may_link(n[x], n[y], np.minimum(n[x], n[y]))
    x, y = x[near], y[near]
    sums = overlaps(vectors, x, y)
    keep = np.flatnonzero(may_link(n[x], n[y], sums))
    keep = keep[np.argsort(-sums[keep] / (n[x[keep]] + n[y[keep]]), kind="stable")]
    return x[keep], y[keep]


def spanning(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of rows make a spanning forest of the groups that they join; early pairs go first."""
    up: dict[int, int] = {}

    def top(g: int) -> int:
        while (above := up.get(g, g)) != g:
            up[g] = up.get(above, above)
            g = above
        return g

    keep = np.zeros(len(x), bool)
    _, once = np.unique(np.sort(np.stack([group[x], group[y]]), axis=0), axis=1, return_index=True)
    for k in np.sort(once).tolist():
        a, b = top(int(group[x[k]])), top(int(group[y[k]]))
        if a != b:
            up[b] = a
            keep[k] = True
    return keep


def _tile_rows(tiles: DataFrame, names: DataFrame) -> DataFrame:
    """(tile, a, b, n, root, upper) of the nodes a, b in tiles of like sizes that hold several components.

    ``names``: a, b, n, root. A tile is cut by size: linked sets are in the same or in neighbouring
    bands of a quarter. Most sets that share a tile by chance stand alone in their bands.
    """
    rows = tiles.filter("three").select("key", F.col("half").alias("a")).join(names, "a")  # two in a tile are neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    banded = rows.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        F.xxhash64("key", band + F.col("upper").cast("int")).alias("tile"), "a", "b", "n", "root", "upper"
    )
    return _apart(banded)


def _apart(banded: DataFrame) -> DataFrame:
    """The rows of tiles that hold several components, not only rows of the band below."""
    of = Window.partitionBy("tile")
    several = (F.min("root").over(of) != F.max("root").over(of)) & ~F.min("upper").over(of)
    return banded.withColumn("met", several).filter("met").drop("met")


_PAIRS = "x struct<a:long,b:long>, y struct<a:long,b:long>, tile long"


def _nodes_at(part: pa.RecordBatch, at: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([part.column(k).take(pa.array(at)) for k in (1, 2)], ["a", "b"])


def _part_pairs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``tile_pairs`` of rows (tile, a, b, root, n, upper, counts, …)."""
    tile, root, n = (part.column(k).to_numpy() for k in (0, 3, 4))
    upper = part.column(5).to_numpy(zero_copy_only=False)
    return tile_pairs(tile, n.astype(np.int64), part.column(6).to_pylist(), root, upper)


def _in_tiles(rows: DataFrame, vectors: DataFrame, *more: str) -> DataFrame:
    """The rows with their counts, tile by tile."""
    counts = vectors.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "counts")
    wide = rows.join(counts, ["a", "b"]).select("tile", "a", "b", "root", "n", "upper", "counts", *more)
    return wide.repartition("tile").sortWithinPartitions("tile")


def _forest_pairs(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Likest pairs (x, y) that join the components of a task's tiles; and, alone, each ``tile`` with pairs left out.

    All pairs of the other tiles, whose counts leave room for a link, are among the given ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tile_runs(batches):
            x, y = _part_pairs(part)
            if not len(x):
                continue
            half = part.column(1).to_numpy()
            ends = np.sort(np.stack([half[x], half[y]]), axis=0)
            _, same = np.unique(ends, axis=1, return_inverse=True)
            same = same.ravel()
            keep = spanning(part.column(3).to_numpy(), x, y)
            left = part.column(0).to_numpy()[x[~np.isin(same, same[keep])]]
            x, y, left = x[keep], y[keep], np.unique(left)
            nodes = [pa.concat_arrays([_nodes_at(part, at), pa.nulls(len(left), _NODE)]) for at in (x, y)]
            yield pa.RecordBatch.from_arrays(
                [*nodes, pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(left, pa.int64())])], names=["x", "y", "tile"]
            )

    return _in_tiles(rows, vectors).transform(in_arrow, run, _PAIRS)


#: So many of a node's tiles, the least ones, tell in which of them it meets another node.
TOLD = 32


def _rest_pairs(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """All pairs (x, y) of different components that meet in a tile and whose counts leave room for a link.

    A pair is given in the least of the tiles that both have. As far as the lists of least tiles have
    one in common, it is the least of all; a pair without one there may be given several times.
    """
    of = Window.partitionBy("a", "b", "upper")
    told = rows.withColumn("told", F.slice(F.array_sort(F.collect_list("tile").over(of)), 1, TOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tile_runs(batches):
            x, y = _part_pairs(part)
            tile, told = part.column(0).to_numpy(), part.column(7)
            used = np.unique(np.concatenate([x, y])).tolist()
            sets = {i: frozenset(told[i].values.to_pylist()) for i in used}
            first = np.zeros(len(x), bool)
            for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                both = sets[i] & sets[j]
                first[k] = not both or min(both) == tile[i]
            x, y = x[first], y[first]
            half = part.column(1).to_numpy()
            keep = _once(half[x], half[y])
            if len(keep):
                nodes = [_nodes_at(part, at[keep]) for at in (x, y)]
                yield pa.RecordBatch.from_arrays([*nodes, pa.nulls(len(keep), pa.int64())], names=["x", "y", "tile"])

    return _in_tiles(told, vectors, "told").transform(in_arrow, run, _PAIRS)


def _once(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first of equal pairs: tiles of the same nodes have the same pairs."""
    return np.unique(np.sort(np.stack([x, y]), axis=0), axis=1, return_index=True)[1]


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct()


def _names(vectors: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, n, root) of every node a, b; components go by 64 bits of their root."""
    root = F.xxhash64(F.coalesce("root", "node"))
    rooted = vectors.select("node", "n").join(roots, "node", "left")
    return rooted.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("n").cast("int").alias("n"), root.alias("root"))


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set table of (…, text) rows, and (node, root) of the nodes that link with others."""
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    sets = stored(set_table(own), "jaccard-sets")
    vectors = stored(_vectors(sets), "jaccard-vectors")
    tiles = stored(_tiles(sets), "jaccard-tiles")
    ends = F.least("half", "next").alias("half_x"), F.greatest("half", "next").alias("half_y")
    near = tiles.filter(F.col("next").isNotNull()).select(*ends).distinct()
    seen = stored(_bounded(near, vectors), "jaccard-bounded")
    links = verified(docs, sets, seen, "jaccard-near")
    roots = components(links, "jaccard-roots")

    rows = stored(_tile_rows(tiles, _names(vectors, roots)), "jaccard-apart")
    found = stored(_forest_pairs(rows, vectors), "jaccard-forest")
    for forest in (True, False):
        rest = found.filter("tile is null")
        rest = stored(_ordered(rest).join(seen, ["x", "y"], "left_anti"), "jaccard-rest")
        if not rest.isEmpty():
            seen = seen.unionByName(rest)
            links = links.unionByName(verified(docs, sets, rest, "jaccard-rest"))
            roots = components(links, "jaccard-roots")
        if forest:  # all pairs, in the tiles that have more than the forest took
            left = found.filter("tile is not null").select("tile").distinct()
            rows = rows.join(left, "tile", "left_semi").drop("root")
            rows = rows.join(_names(vectors, roots).select("a", "b", "root"), ["a", "b"])
            found = stored(_rest_pairs(stored(_apart(rows), "jaccard-apart"), vectors), "jaccard-found")
    return sets, roots


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, …, text) without its text, with n_shingles, component_id and text_hash."""
    sets, roots = linked_sets(docs)
    rows = sets.drop("keys", "signs", "counts")
    ids = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = ids.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("rows").alias("members"))
    several = several.filter("members > 1").select("root", "component_id")
    named = join_skewed(ids.select("node", "root"), several, "root").select("node", "component_id")
    named = stored(named, "jaccard-names")
    in_groups = join_skewed(rows, named, "node")
    alone = rows.join(named, "node", "left_anti").withColumn("component_id", F.col("doc_id"))
    return in_groups.unionByName(alone).drop("node")


def query(docs: DataFrame) -> DataFrame:
    """What op7 returns."""
    return jaccard_join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component: that with the least id.

    Components are told apart by their root node, so null or repeated ids join nothing.
    """
    docs, back = set_aside(docs, ("doc_id", "text"))
    sets, roots = linked_sets(docs.select("doc_id", "text"))
    full = sets.filter(F.col("node").isNotNull()).select("doc_id", "text_hash", "node")
    first = F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")
    keep = full.groupBy("node").agg(F.min(F.struct(*first)).alias("k")).join(roots, "node", "left")
    keep = keep.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    texts = keep.select(F.col("k.id").alias("doc_id"), F.col("k.hash").alias("text_hash"))
    others = full.select("doc_id", "text_hash").distinct().exceptAll(texts)
    others = checked_broadcast(stored(others, "jaccard-gone")).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")
    )
    own = docs.withColumn("_hash", F.xxhash64("text"))
    gone = own["doc_id"].eqNullSafe(others["_gone_id"]) & (own["_hash"] == others["_gone_hash"])
    left = own.join(others, gone, "left_anti")
    again = stored(
        full.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash")),
        "jaccard-again",
    )
    if not again.isEmpty():  # the same row several times: keep one
        same = left["doc_id"].eqNullSafe(again["_again_id"]) & (left["_hash"] == again["_again_hash"])
        twice = left.join(checked_broadcast(again), same, "left_semi").dropDuplicates(["doc_id", "_hash"])
        left = left.join(checked_broadcast(again), same, "left_anti").unionByName(twice)
    return back(left)


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM (SELECT * FROM shingles SEMI JOIN rare USING (s)) a JOIN (SELECT * FROM shingles SEMI JOIN rare USING (s)) b
    ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (
  WITH RECURSIVE reach(x, id) AS (
    SELECT x, x FROM ways UNION SELECT w.y, r.id FROM reach r JOIN ways w ON w.x = r.x AND w.y > r.id)
  SELECT x AS doc_id, min(id) AS id FROM reach GROUP BY x) c USING (doc_id)
"""
