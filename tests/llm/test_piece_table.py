"""Fill-in-the-middle: descriptors, outputs and restored texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textrules.llm import piece_table as pt


def plain_row(doc_id, text, seed=1):
    """The contract by plain slicing."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    if d % 100 < 20:
        return n, "spm", lo, hi - lo, "<S>" + text[hi:] + "<P>" + text[:lo] + "<M>" + text[lo:hi]
    return n, "psm", lo, hi - lo, "<P>" + text[:lo] + "<S>" + text[hi:] + "<M>" + text[lo:hi]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    letters = "ab <>PSM/éß漢😀\n\x00"
    made = [(k, "".join(rng.choices(letters, k=rng.randrange(60)))) for k in range(400)]
    made += [(1000, "<"), (1001, "<P"), (1002, "P>"), (1003, "x<M>y"), (1004, "<<S<P<M"), (1005, ">>"), (1006, "😀" * 90_000)]
    return [*made, (7, made[3][1]), (7, made[3][1]), (None, "no id"), (1007, None), (1008, "")]


def test_outputs_and_restored_texts(spark, docs_of, rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for clashes in (False, True):
        docs = docs_of(rows, clashes)
        found = pt.restored(pt.transformed(docs)).collect()
        assert len(found) == len(rows)
        for r in found:
            text = r["text"] or ""
            want = plain_row(r["doc_id"], text)
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
            assert r["output_sha256"] == sha(r["output"])
            assert (r["restored"], r["restored_sha256"]) == (text, sha(text))
        assert {r["form"] for r in found} == {"plain", "psm", "spm"}
        assert set(docs.columns) <= set(found[0].asDict())
    asked = sorted(map(repr, pt.query(docs_of(rows)).collect()))
    assert asked == sorted(map(repr, pt.query(docs_of(rows, True)).collect())) and len(asked) == len(rows)
    assert pt.query(docs_of([])).collect() == []


def test_rates_and_seed(spark, docs_of, rows):
    docs = docs_of(rows)
    assert {r["form"] for r in pt.transformed(docs, pt.Rates(rearranged=0)).collect()} == {"plain"}
    full = pt.transformed(docs, pt.Rates(seed=2, rearranged=100, spm=100)).filter("n > 0 and form = 'spm'").collect()
    for r in full:
        a, b = (int(hashlib.sha256(f"2:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8))
        assert r["prefix_chars"] == min(a % (r["n"] + 1), b % (r["n"] + 1))


def test_descriptors(spark):
    pieces = pt.cut(pt.cut(pt.whole(F.lit(10)), 0, F.lit(4)), 1, F.lit(0))
    three = [("text", 0, 4), ("text", 4, 0), ("text", 4, 6)]
    one = spark.range(1).select(pieces.alias("p"), pt.arrange(pieces, pt.ORDERS["spm"]).alias("q")).first()
    assert [tuple(x) for x in one["p"]] == three
    assert [tuple(x) for x in one["q"]] == [
        ("sentinel", 3, 3), three[2], ("sentinel", 0, 3), three[0], ("sentinel", 6, 3), three[1]
    ]
    for form, order in pt.ORDERS.items():
        numbers = [x for x in order if not isinstance(x, str)]
        assert [order[k] for k in pt.inverse(order)] == sorted(numbers), form
