"""MinHash near-dedup with circulant signatures: two permutations make all coordinates.

Words are cut at blanks, A-Z lower-cased; a text's set is its distinct 2-word shingles (with fewer
words, the whole sequence as one). Shingles are numbered below 2**32. One permutation scatters
them once; coordinate k of a signature is the least value of the other permutation over the
scattered numbers shifted around the circle by k. So a signature costs one permutation a coordinate
and two sets of constants, however long it is.

``rows`` coordinates make a band, ``bands`` bands a signature. Texts that share a band meet; whether
two of them link is always told by their full sets: 100 * intersection >= 80 * union. The
defaults miss a pair at the very limit of 0.8 with probability (1 - 0.8**5)**41 < 1e-7, others less.

Equal sets are one node. Nodes of one band are a tile. Within a tile links are searched from node to
node: those a node links with join its group and are not looked at again, so a tile of m nodes gives
m - 1 rows at most, and a tile of copies takes a few looks a node. Looks go to bitmaps of the
sets first, which bound the intersection from above. A tile's rows are thus pairs that link, but
for few; these are verified by full sets, and the tiles in which one failed are searched again
with full sets in place. Tiles of more than ``TILE`` nodes are cut into blocks by the node's hash;
when blocks of one tile are still apart after that, each block meets each other one. No pair is
capped or left out.

Null and empty texts, and texts without words, have an empty set and link with nothing. Null ids are
never a component's name unless all its ids are null; ``kept`` compares nulls as equal, so a text
of a null id that links with nothing is kept. Rows of equal id and set are kept or dropped together.
Repeated rows are in one component. Empty tables give empty tables. Only doc_id and text are
looked at; other columns may have any names. Texts go through whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.llm.common import WordHasher, blank_words, in_arrow, mix, row_blocks, shingle_hashes, text_arrays
from textrules.llm.components import components
from textrules.llm.store import stored
from textrules.operators.skew import join_skewed
from textrules.session import checked_broadcast

#: Nodes of a tile that one task searches, and bytes of their bitmaps.
TILE, TILE_BYTES = 4096, 16 << 20
#: Nodes whose bands a task remembers to have given.
REMEMBERED = 50_000
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Circulant:
    """Shingle size, and the shape of signatures."""

    shingle: int = 2
    rows: int = 5
    bands: int = 41


def _permuted(x: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of the numbers below 2**32 (the public murmur3 finalizer around a salt)."""
    x = x ^ np.uint32(salt)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` coordinates (rows) of the sets that begin at ``starts``; none of them is empty."""
    scattered = _permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x2545F491)
    out = np.empty((n, len(starts)), np.uint32)
    for k in range(n):
        np.minimum.reduceat(_permuted(scattered - np.uint32(k), 0x9E3779B9), starts, out=out[k])
    return out


def band_keys(signs: np.ndarray, rule: Circulant) -> np.ndarray:
    """A 64-bit key a band (columns) of each set (rows)."""
    keys = np.repeat(np.arange(1, rule.bands + 1, dtype=np.uint64)[:, None], signs.shape[1], axis=1)
    with np.errstate(over="ignore"):
        for r in range(rule.rows):
            keys = mix(keys * np.uint64(0x9FB21C651E98DF25) ^ signs[r :: rule.rows].astype(np.uint64))
    return keys.T


class SetMaker:
    """Shingle sets of the rows of a block of texts, as sorted arrays of hashes."""

    def __init__(self, rule: Circulant):
        self.n, self.hasher = rule.shingle, WordHasher(blank_words())

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        _, _, words, rows = self.hasher.words(data, offsets)
        runs = shingle_hashes(words, self.n)
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if hi - lo >= self.n:
                yield np.unique(runs[lo : hi - self.n + 1])
            else:
                yield shingle_hashes(words[lo:hi], hi - lo) if hi > lo else runs[:0]


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = mix(shingles ^ _SALT).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A set as bits: about eight times as many as it has shingles, a power of two of them."""
    bits = max(64, 1 << int(np.ceil(np.log2(8 * max(1, len(shingles))))))
    flags = np.zeros(bits, bool)
    flags[(shingles >> np.uint64(8)) & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little")


NODE = "struct<a:long,b:long>"
_NODE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _nodes(nodes: list[tuple[int, int] | None]) -> pa.Array:
    return pa.array([None if x is None else {"a": x[0], "b": x[1]} for x in nodes], _NODE)


def set_table(docs: DataFrame, rule: Circulant = Circulant()) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, bands, bits of (doc_id, text) rows.

    A task gives the bands and bits of a node once; later rows of the same node have null there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, given = SetMaker(rule), set()
        for batch in batches:
            data, offsets = text_arrays(batch.column(2))
            for lo, hi in row_blocks(offsets):
                size, nodes, at, new = [], [], [], []
                for k, s in enumerate(maker.sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])):
                    node = node_of(s) if len(s) else None
                    size.append(len(s))
                    nodes.append(node)
                    if node is not None and node not in given:
                        if len(given) >= REMEMBERED:
                            given.clear()
                        given.add(node)
                        at.append(k)
                        new.append(s)
                bands, bits = [None] * len(size), [None] * len(size)
                if new:
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in new])[:-1]])
                    keys = band_keys(signatures(np.concatenate(new), starts, rule.rows * rule.bands), rule)
                    for k, s, own in zip(at, new, keys.view(np.int64), strict=True):
                        bands[k], bits[k] = own, bitmap(s).tobytes()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2], pa.array(size, pa.int64()), _nodes(nodes),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands", "bits"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_shingles long, node {NODE}, bands array<long>, bits binary"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").transform(in_arrow, run, schema)


# -- the search of a tile -----------------------------------------------------------------


class Overlaps:
    """Upper bounds of the overlaps of sets, from bitmaps of sets of like sizes."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n = n
        self.width = np.array([len(b) for b in bits])
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():  # maps of one length and, folded, of twice the length
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            maps = np.zeros((len(rows), w), np.uint8)
            for at, k in enumerate(rows.tolist()):
                one = np.frombuffer(bits[k], np.uint8)
                maps[at] = one if len(one) == w else one[:w] | one[w:]
            maps = maps.view(np.uint64)
            lost = n[rows] - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            self.classes[w] = rows, maps, lost

    def linkable(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Rows among ``wanted`` (flags) that row ``k`` may link with.

        Sets that link differ by a quarter in size at most, so their maps by one doubling.
        """
        found = []
        for w in (int(self.width[k]), int(self.width[k]) // 2):
            if w not in self.classes:
                continue
            rows, maps, lost = self.classes[w]
            own = int(np.searchsorted(rows, k))
            near = wanted[rows]
            if w != self.width[k]:
                near = near & (self.width[rows] == w)
            at = np.flatnonzero(near)
            at = at[9 * np.minimum(self.n[rows[at]], self.n[k]) >= 4 * (self.n[rows[at]] + self.n[k])]
            both = np.bitwise_count(maps[at] & maps[own]).sum(axis=1, dtype=np.int64) + np.minimum(lost[at], lost[own])
            found.append(rows[at[9 * both >= 4 * (self.n[rows[at]] + self.n[k])]])
        return np.concatenate(found)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def forest(
    n: np.ndarray, bits: list[bytes], group: np.ndarray, sure: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Pairs of rows that join the groups of a tile as far as its links do, each one needed.

    Rows of equal ``group`` are joined beforehand. Without ``sure`` a pair may fail to link.
    """
    overlaps, left, pairs = Overlaps(n, bits), np.ones(len(n), bool), []
    members: dict[int, list[int]] = {}
    for k, g in enumerate(group.tolist()):
        members.setdefault(g, []).append(k)
    groups = group.tolist()
    for start in range(len(n)):
        if not left[start]:
            continue
        todo = list(members[groups[start]])
        left[todo] = False
        while todo and left.any():
            k = todo.pop()
            for other in overlaps.linkable(k, left).tolist():
                if left[other] and (sure is None or sure(k, other)):
                    pairs.append((k, other))
                    todo += members[groups[other]]
                    left[members[groups[other]]] = False
    return pairs


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles out of rows in the order of their tile."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.diff(tile)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(tile)], strict=True):
            if kept and hi > lo and kept[-1].column(0)[0].as_py() != tile[lo]:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            if hi > lo:
                kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def tile_links(rows: DataFrame, exact: bool) -> DataFrame:
    """(tile, x, y) that join the nodes of each tile; rows: tile, node, root, n, bits or shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles_of(batches):
            group = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
            if group.max() == 0:
                continue
            n, blobs, sure = table["n"].to_numpy(), table.column(4).to_pylist(), None
            if exact:
                sets = [np.frombuffer(b, np.uint64) for b in blobs]
                blobs = [bitmap(s).tobytes() for s in sets]
                sure = lambda i, j, sets=sets: linked(sets[i], sets[j])
            pairs = np.array(forest(n, blobs, group, sure), np.int64).reshape(-1, 2)
            if len(pairs):
                node = table["node"].combine_chunks()
                x, y = (node.take(pa.array(pairs[:, k])) for k in (0, 1))
                tile = table["tile"].combine_chunks().slice(0, len(pairs))
                yield pa.RecordBatch.from_arrays([tile, x, y], names=["tile", "x", "y"])

    in_order = rows.repartition("tile").sortWithinPartitions("tile", "node")
    found = in_order.transform(in_arrow, run, f"tile long, x {NODE}, y {NODE}")
    return found.select("tile", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


# -- links --------------------------------------------------------------------------------


def _members(sets: DataFrame) -> DataFrame:
    """(key, blocks, node) of the nodes that share a band; blocks is how many a tile is cut into."""
    each = sets.filter(F.col("bands").isNotNull()).select(
        "node", F.octet_length("bits").alias("size"), F.explode("bands").alias("key")
    )
    shared = (
        each.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
        .filter("low <> high")
        .select("key", F.ceil(F.greatest(F.col("rows") / TILE, F.col("size") / TILE_BYTES)).cast("int").alias("blocks"))
    )
    shared = stored(shared, "circulant-shared")
    return join_skewed(each.select("key", "node"), shared, "key").select("key", "blocks", "node").distinct()


def _sets_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, rule: Circulant) -> DataFrame:
    """(node, shingles) of ``nodes``, made again from one text of each."""
    texts = sets.filter(F.col("bands").isNotNull()).groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    hashes = stored(nodes.join(texts, "node").select("text_hash").distinct(), "circulant-texts")
    own = docs.select("text").withColumn("text_hash", F.xxhash64("text"))
    own = own.join(checked_broadcast(hashes), "text_hash", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, given = SetMaker(rule), set()
        for batch in batches:
            data, offsets = text_arrays(batch.column(0))
            for lo, hi in row_blocks(offsets):
                found, values = [], []
                for s in maker.sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    node = node_of(s)
                    if len(s) and node not in given:
                        if len(given) >= REMEMBERED:
                            given.clear()
                        given.add(node)
                        found.append(node)
                        values.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([_nodes(found), pa.array(values, pa.binary())], names=["node", "shingles"])

    found = own.transform(in_arrow, run, f"node {NODE}, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(x, y, links) of pairs, by the full sets of their nodes."""
    side = lambda c: whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    wide = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "s_x", "s_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            sure = [linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in two)) for two in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure, pa.bool_())], names=["x", "y", "links"])

    return wide.transform(in_arrow, run, f"x {NODE}, y {NODE}, links boolean")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    joined = rows.join(roots, "node", "left")
    return joined.withColumn("root", F.xxhash64(F.coalesce("root", "node")))


def node_links(docs: DataFrame, sets: DataFrame, rule: Circulant = Circulant()) -> DataFrame:
    """(x, y) links that join the nodes of ``sets`` into the components that all links give."""
    members = stored(_members(sets), "circulant-members")
    given = sets.filter(F.col("bands").isNotNull())
    wanted = members.select("node").distinct()
    vectors = given.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("bits").alias("bits")
    )
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).otherwise(0).cast("int")
    rows = members.join(vectors, "node").select(
        F.xxhash64("key", block).alias("tile"), "node", F.xxhash64("node").alias("root"), "n", "bits"
    )
    found = stored(tile_links(rows, exact=False), "circulant-pairs")
    pairs = found.select("x", "y").distinct()
    whole = stored(_sets_of(docs, sets, _ends(pairs), rule), "circulant-sets")
    judged = stored(verified(pairs, whole), "circulant-judged")
    links = judged.filter("links").select("x", "y")
    # Again with full sets: tiles in which a pair failed, and tiles whose blocks are apart.
    failed = found.join(judged.filter("not links").select("x", "y"), ["x", "y"]).select("tile").distinct()
    placed = members.withColumn("own", block).withColumn("tile", F.xxhash64("key", "own"))
    again = placed.join(failed, "tile", "left_semi").select("key", F.col("own").alias("one"), F.col("own").alias("two")).distinct()
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    cut = members.filter("blocks > 1").select("key", "blocks").distinct()
    cross = cut.select("key", F.explode(blocks).alias("one"), "blocks").select("key", "one", F.explode(blocks).alias("two")).filter("one < two")
    open_ = stored(again.unionByName(cross), "circulant-open")
    if open_.isEmpty():
        return links
    roots = components(links, "circulant-roots")
    named = stored(_with_roots(placed.join(open_.select("key").distinct(), "key", "left_semi"), roots), "circulant-named")
    # A block pair needs a look only when it holds several roots.
    each = named.groupBy("key", "own").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    side = lambda c: each.select("key", F.col("own").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
    mixed = open_.join(side("one"), ["key", "one"]).join(side("two"), ["key", "two"]).filter(
        "least(low_one, low_two) <> greatest(high_one, high_two)"
    )
    mixed = stored(mixed.select("key", "one", "two", F.xxhash64("key", "one", "two").alias("tile")), "circulant-mixed")
    if mixed.isEmpty():
        return links
    parts = mixed.select("key", "tile", F.explode(F.array_distinct(F.array("one", "two"))).alias("own"))
    rows = named.drop("tile").join(parts, ["key", "own"]).select("tile", "node", "root")
    rows = stored(rows, "circulant-rest")
    full = stored(_sets_of(docs, sets, rows.select("node").distinct(), rule), "circulant-rest-sets")
    wide = rows.join(full, "node").select(
        "tile", "node", "root", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles"
    )
    return links.unionByName(tile_links(wide, exact=True).select("x", "y").distinct())


def near_duplicates(docs: DataFrame, rule: Circulant = Circulant()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every (doc_id, text) row."""
    docs = docs.select("doc_id", "text")
    sets = stored(set_table(docs, rule), "circulant")
    roots = components(node_links(docs, sets, rule), "circulant-components")
    rows = sets.select("doc_id", "n_shingles", "node")
    ids = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = ids.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("rows").alias("members"))
    several = several.filter("members > 1").select("root", "component_id")
    named = stored(join_skewed(ids.select("node", "root"), several, "root").select("node", "component_id"), "circulant-names")
    in_groups = join_skewed(rows, named, "node")
    alone = rows.join(named, "node", "left_anti").withColumn("component_id", F.col("doc_id"))
    found = in_groups.unionByName(alone)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    """What op11 returns."""
    return near_duplicates(docs)


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r
  FROM shingles JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s)),
firsts AS (SELECT doc_id, s FROM ranked JOIN sizes USING (doc_id) WHERE r <= n - (4 * n + 4) // 5 + 1),
met AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM firsts a JOIN firsts b ON a.s = b.s AND a.doc_id < b.doc_id),
fit AS (SELECT x, y, p.n AS n, q.n AS m FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n)),
lists AS (SELECT doc_id, list(s) AS l FROM shingles GROUP BY doc_id),
links AS (
  SELECT x, y FROM (SELECT x, y, n, m, len(list_intersect(a.l, b.l)) AS k
    FROM fit JOIN lists a ON a.doc_id = x JOIN lists b ON b.doc_id = y) WHERE 100 * k >= 80 * (n + m - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
found AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.id, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (
    WITH RECURSIVE reach(x, id) AS (
      SELECT x, x FROM ways UNION SELECT w.y, r.id FROM reach r JOIN ways w ON w.x = r.x AND w.y > r.id)
    SELECT x AS doc_id, min(id) AS id FROM reach GROUP BY x) c USING (doc_id))
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""
