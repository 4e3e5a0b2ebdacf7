"""Circulant MinHash against all pairs of shingle sets."""

import random

import numpy as np
import plain
import pytest

from textrules.llm import circulant as cm
from textrules.llm.common import mix


def plain_rows(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs; ids are distinct."""
    sets = {i: plain.shingles(t, 2) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and plain.linked(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def families(rng, n_families, members, size=120, most=0.16):
    """Texts in groups whose similarities lie on both sides of the limit."""
    rows = []
    for f in range(n_families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(members):
            rows.append((len(rows), " ".join(edited(rng, base, rng.uniform(0, most)))))
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_against_all_pairs(spark, docs_of):
    rng = random.Random(5)
    rows = families(rng, 25, 12) + [(1000 + k, " ".join(f"s{rng.randrange(9)}" for _ in range(rng.randrange(9)))) for k in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "É é"), (2007, "é é")]
    want = plain_rows(rows)
    assert rows_of(cm.query(docs_of(rows).repartition(6))) == want
    assert len({c for _, _, c, _ in want}) < len(want) - 60


@pytest.mark.parametrize("tile", [4096, 8])
def test_one_large_group_in_blocks(spark, docs_of, monkeypatch, tile):
    rows = families(random.Random(8), 1, 150, most=0.2)
    monkeypatch.setattr(cm, "TILE", tile)
    want = plain_rows(rows)
    assert rows_of(cm.query(docs_of(rows).repartition(6))) == want
    assert len({c for _, _, c, _ in want}) > 2


def test_chains_of_links_that_only_one_pair_holds(spark, docs_of):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 150])) for k in range(20)]
    assert rows_of(cm.query(docs_of(rows[::-1]))) == plain_rows(rows)


def test_forest_joins_what_links_join():
    rng = random.Random(3)
    for _ in range(20):
        base = rng.sample(range(10**6), 90)
        sets = []
        for _ in range(40):
            own = [x if rng.random() > 0.12 else rng.randrange(10**6) for x in base][: rng.randrange(60, 91)]
            sets.append(np.unique(mix(np.array(own, np.uint64))))
        n, bits = np.array([len(s) for s in sets]), [cm.bitmap(s).tobytes() for s in sets]
        pairs = [(i, j) for i in range(40) for j in range(i) if cm.linked(sets[i], sets[j])]
        overlaps = cm.Overlaps(n, bits)
        for i, j in pairs:  # bounds lose no link
            assert j in overlaps.linkable(i, np.ones(40, bool)) and i in overlaps.linkable(j, np.ones(40, bool))
        given = np.arange(40)
        given[5] = given[3]
        got = cm.forest(n, bits, given, lambda i, j: cm.linked(sets[i], sets[j]))
        root = lambda links: _roots(40, [*links, (3, 5)])
        assert root(got) == root(pairs) and len(got) == 39 - (len(set(root(pairs))) - 1) - 1


def _roots(n, links):
    up = list(range(n))
    for _ in range(n):
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    return up


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        both, each = int(600 * share), (600 - int(600 * share)) // 2
        values = mix(rng.integers(0, 1 << 60, both + 2 * each).astype(np.uint64))
        one, two = values[: both + each], np.concatenate([values[:both], values[both + each :]])
        signs = cm.signatures(np.concatenate([one, two]), np.array([0, len(one)]), 2000)
        assert (signs[:, 0] == signs[:, 1]).mean() == pytest.approx(share, abs=0.05)
        # a coordinate is the least of one permutation over numbers moved around the circle
        scattered = cm._permuted((one >> np.uint64(32)).astype(np.uint32), 0x2545F491).astype(np.int64)
        moved = ((scattered - 7) % (1 << 32)).astype(np.uint32)
        assert signs[7, 0] == cm._permuted(moved, 0x9E3779B9).min()
    everything = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16) | np.uint32(3)
    assert len(np.unique(cm._permuted(everything, 5))) == 1 << 16


def test_odd_rows_ids_and_columns(spark, docs_of, odd_rows):
    plainly = rows_of_all(cm.query(docs_of(odd_rows)))
    assert plainly == rows_of_all(cm.query(docs_of(odd_rows, clashes=True)))
    assert len(plainly) == len(odd_rows)
    by = {i: (n, c, kept) for i, n, c, kept in plainly if i is not None}
    assert by[1] == (0, 1, True) and by[3] == (0, 3, True) and by[7] == (1, 7, True)
    assert by[5][1:] == (5, True) and by[6][1:] == (5, False)
    nulls = sorted((c is None, kept) for i, _, c, kept in plainly if i is None)
    assert nulls == [(False, False), (True, True)]  # a copy of 5; a text of its own
    assert cm.query(docs_of([])).collect() == []


def rows_of_all(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
