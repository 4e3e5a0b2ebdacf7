"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from textrules.llm import spelling as sp


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, dominance=5):
    """word -> (form, root, n, n_near, form_n) by all pairs."""
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_apart(w, v))
        first = near[0] if near and -near[0][0] >= dominance * n else None
        form[w] = (first[1] if first else None, -first[0] if first else None, len(near))
    for w, n in counts.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (form[w][0], root, n, form[w][2], form[w][1])
    return out


def plain_counts(rows):
    counts = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def near_alike(rng, n, letters="abcé", least=6, most=9):
    """Words of which many are one letter apart, with counts that have ties and chains."""
    words = {"".join(rng.choices(letters, k=rng.randrange(least, most))) for _ in range(n)}
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    return {w: rng.choice([5, 5, 6, 25, 30, 125, 700]) for w in sorted(words) if len(w) >= least}


@pytest.mark.parametrize("tile", [8192, 40])
def test_words_against_all_pairs(spark, monkeypatch, tile):
    counts = near_alike(random.Random(tile), 250)
    monkeypatch.setattr(sp, "TILE", tile)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    want = plain_variants(counts)
    assert found(sp.variants(words)) == want
    assert sum(f is not None for f, *_ in want.values()) > 50
    assert any(r != f and f is not None for f, r, *_ in want.values())  # chains of forms


def test_index_bits_by_definition():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    for m in (6, 7):
        words = [w for w in near_alike(rng, 60, "ab", m, m + 2) if len(w) in (m, m + 1)]
        rows = pa.table({
            "m": [m] * len(words), "word": words, "tile": [1] * len(words), "indexed": [True] * len(words),
            "asked": [True] * len(words), "last_half": [False] * len(words),
        })
        row, n, best = sp.searched(rows)
        near = {
            i: [j for j, v in enumerate(words) if one_apart(w, v) and min(len(w), len(v)) == m]
            for i, w in enumerate(words)
        }
        assert {i: (k, b) for i, k, b in zip(row.tolist(), n.tolist(), best.tolist(), strict=True)} == {
            i: (len(v), v[0]) for i, v in near.items() if v
        }
    sets = np.array([[0, 4], [1 << 63, 0], [0, 1 << 63]], np.uint64)
    assert sp.lowest(sets).tolist() == [66, 63, 127]


def test_shares_are_whole_tiles_of_one_class():
    import pyarrow as pa

    rng = random.Random(7)
    for first in (3000, 1, 2):
        sizes = [(6, first), *((6 + k // 40, rng.choice([1, 1, 2, 3, 700, 1500])) for k in range(120))]
        tile = [t for t, (_, n) in enumerate(sizes) for _ in range(n)]
        m = [sizes[t][0] for t in tile]
        table = pa.table({"m": m, "tile": tile})
        shares = [(s["m"].to_pylist(), s["tile"].to_pylist()) for s in sp._shares(iter(table.to_batches(max_chunksize=500)))]
        assert [t for _, ts in shares for t in ts] == [t for t in tile if sizes[t][1] > 1]
        for ms, ts in shares:
            assert len(set(ms)) == 1 and (len(ts) <= sp.SHARED or len(set(ts)) == 1)
        assert len(shares) < len({t for t in tile})


def test_texts(spark, docs_of, odd_rows):
    rng = random.Random(2)
    vocabulary = list(near_alike(rng, 40))
    rows = [(k, " ".join(rng.choices(vocabulary, k=400)).title()) for k in range(40)]
    rows += [(100, "Élan×mots÷ÀÉ été_été2été " * 6), (None, "without an id " * 9), (101, None), (102, "")]
    rows += [(103, "x" * 9000 + " "), (103, "x" * 9000 + " ")] * 3 + [r[:2] for r in odd_rows]
    want = plain_variants(plain_counts(rows))
    assert found(sp.query(docs_of(rows))) == want
    assert found(sp.query(docs_of(rows, clashes=True))) == want
    assert sp.query(docs_of([])).collect() == [] and sp.query(docs_of([(1, "short words")])).collect() == []


def test_smallest_folder(spark):
    import duckdb

    from textrules.llm.common import read

    path = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    assert found(sp.query(read(spark, path, "documents"))) == plain_variants(plain_counts(texts))
