"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from textrules.llm import bpe_tree, crf, decontaminate, fertility, jaccard, language, passages, secrets, token_counts, warc

BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])
ITEM = "no id here but some words all the same"


def bench(spark, rows=((1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), BENCH)


def labels(spark, rows=((5, 1), (6, 0), (7, None), (None, 1), (5, 1))):
    return spark.createDataFrame(list(rows), LABELS)


PER_DOCUMENT = {
    "op1": lambda s, d: fertility.query(d),
    "op4": lambda s, d: token_counts.query(d),
    "op5": lambda s, d: bpe_tree.query(d),
    "op7": lambda s, d: jaccard.query(d),
    "op8": lambda s, d: crf.query(d, labels(s)),
    "op9": lambda s, d: language.query(d),
    "op10": lambda s, d: secrets.query(d),
}
OTHERS = {
    "op3": lambda s, d: passages.query(d),
    "op6": lambda s, d: decontaminate.query(d, bench(s)),
    "one of each": lambda s, d: jaccard.one_of_each(d),
    "clean": lambda s, d: decontaminate.clean_documents(d, bench(s)),
    "redact": lambda s, d: secrets.redact(d),
    "known": lambda s, d: language.keep_known(d, language.trained_on(d)),
    "encode": lambda s, d: bpe_tree.encode(d, bpe_path()),
}


def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_odd_rows(spark, docs_of, odd_rows, name):
    run = PER_DOCUMENT[name]
    plain = [r.asDict() for r in run(spark, docs_of(odd_rows)).collect()]
    assert Counter(r["doc_id"] for r in plain) == Counter(r[0] for r in odd_rows)
    clashing = [r.asDict() for r in run(spark, docs_of(odd_rows, clashes=True)).collect()]
    order = lambda rows: sorted(map(repr, rows))
    assert order(clashing) == order(plain)
    fives = [r for r in plain if r["doc_id"] == 5]
    assert fives[0] == fives[1]


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT | OTHERS))
def test_empty_table(spark, docs_of, name):
    run = (PER_DOCUMENT | OTHERS)[name]
    full = run(spark, docs_of([(1, "some words", "en", "a")]))
    empty = run(spark, docs_of([]))
    assert empty.collect() == []
    assert empty.dtypes == full.dtypes


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_odd_rows_of_the_others(spark, docs_of, odd_rows, name):
    plain = OTHERS[name](spark, docs_of(odd_rows)).collect()
    clashing = OTHERS[name](spark, docs_of(odd_rows, clashes=True)).collect()
    assert len(plain) == len(clashing)
    if name in ("clean", "redact", "known", "one of each"):
        assert plain and set(plain[0].asDict()) == set(docs_of(odd_rows).columns)


def test_defined_results(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    by = lambda rows: {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    kept = by(PER_DOCUMENT["op1"](spark, docs).collect())
    assert kept[1]["base_failed"] and kept[2]["n_words"] == 0 and kept[10]["n_words"] == 1
    counts = by(PER_DOCUMENT["op4"](spark, docs).collect())
    assert (counts[1]["n_bytes"], counts[1]["n_tokens"]) == (0, 0) and counts[10]["n_bytes"] == 300_000
    found = by(PER_DOCUMENT["op7"](spark, docs).collect())
    assert found[1]["n_shingles"] == 0 and found[7]["n_shingles"] == 1
    assert found[6]["component_id"] == found[5]["component_id"] == 5
    langs = by(PER_DOCUMENT["op9"](spark, docs).collect())
    assert langs[1]["lang_pred"] == langs[3]["lang_pred"] == "und" and langs[1]["score"] == 0
    spans = by(PER_DOCUMENT["op10"](spark, docs).collect())
    assert spans[1]["spans"] == "" and spans[1]["n_hex"] == 0
    items = OTHERS["op6"](spark, docs).collect()
    assert {(r["doc_id"], r["item_id"]) for r in items} == {(None, 1), (None, None)}
    assert len(OTHERS["one of each"](spark, docs).collect()) == len(odd_rows) - 3


def test_no_labels_and_no_training(spark, docs_of):
    docs = docs_of([(1, "words and words", None, "a"), (2, "", None, "a")])
    assert {r["score"] for r in crf.query(docs, labels(spark, [])).collect()} == {0.5}
    assert {r["lang_pred"] for r in language.query(docs).collect()} == {"und"}
    assert decontaminate.query(docs, bench(spark, [])).collect() == []


def test_pages_with_odd_rows(spark):
    schema = "page_id long, url string, html string, payload string, digest string"
    rows = [
        (1, "u", "", "p", "d"), (2, None, None, "p", "d"), (3, "v", "x", "p", "d"), (4, "w\r\nWARC/1.0\r\n", "x", "p", "d"),
        (4, "w", "x", "p", "d"), (5, "y", "z" * 300_000, None, None), (None, "n", "x", "p", "d"),
    ]
    found = [tuple(r)[:1] + tuple(r)[3:] for r in warc.query(spark.createDataFrame(rows, schema)).collect()]
    assert Counter(found) == Counter([
        (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3),
        (5, "response", None), (None, "response", None),
    ])
    assert warc.query(spark.createDataFrame([], schema)).collect() == []


def test_one_of_each_keeps_unlinked_rows_without_ids_or_with_one_id(spark, docs_of):
    text = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("d") + " e"),
        (1, text("f")), (1, text("g")), (2, text("d")), (3, None), (None, None), (None, ""),
    ]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs_of(rows)).collect())
    assert kept == Counter({*rows} - {(None, text("d") + " e")})


def test_items_without_blanks_and_short_items_are_searched(spark, docs_of):
    asked = "水的沸点在标准大气压下是多少摄氏度？请写出你的推理过程。"
    thai = "น้ำเดือดที่อุณหภูมิเท่าไร"
    items = [(1, asked), (2, thai), (3, "Four words, no more"), (4, "東京"), (5, "？！"), (6, None), (7, "four words no less")]
    rows = [
        (1, f"前面的话。{asked}后面的话。"), (2, f"前面的话{asked.replace('标准', '正常').replace('？', '')}"), (3, f"x{thai}y"),
        (4, "here are four words no more of them"), (5, "four words"), (6, "私は東京に住む"), (7, "東の京、？！"), (8, None),
        (9, "水在多少度会沸腾"), (10, "four words no more; four words no more"),
    ]
    found = decontaminate.query(docs_of(rows), bench(spark, items)).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == Counter([(1, 1), (2, 1), (3, 2), (4, 3), (6, 4), (10, 3)])
    by = {r["doc_id"]: r for r in found}
    assert (by[1]["first_word"], by[1]["end_word"], by[1]["distance"], by[1]["item_words"]) == (4, 30, 0, 26)
    assert by[2]["distance"] == 2 and (by[4]["first_word"], by[4]["end_word"], by[4]["item_words"]) == (2, 6, 4)
    assert (by[10]["first_word"], by[6]["first_word"], by[6]["end_word"]) == (0, 2, 4)
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs_of(rows), bench(spark, items)).collect()} == {5, 7, 8, 9}


def test_lone_characters_part_words_and_nothing_else():
    import numpy as np

    from textrules.llm.common import WordHasher, letter_words

    cut = WordHasher(letter_words(), alone=True)
    for text, want in {
        "abc日本，def": ["abc", "日", "本", "def"], "𠀀a𠀁": ["𠀀", "a", "𠀁"], "é한국어 ñ": ["é한국어", "ñ"], "日": ["日"], "、": [], "a、b": ["a", "b"],
    }.items():
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, hashes, _ = cut.words(data, np.array([0, len(data)]))
        assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == want
        for word, h in zip(want, hashes.tolist(), strict=True):
            raw = np.frombuffer(word.encode(), np.uint8)
            assert cut.words(raw, np.array([0, len(raw)]))[2].tolist() == [h]


def test_language_grams_stay_apart():
    import numpy as np

    codes = np.arange(400_000, dtype=np.uint64)
    hashes = language.hash_grams([0x4E00 + codes % 700, 0x4E00 + codes // 700, 0x4E00 + codes % 11, 0x4E00 + codes % 13])
    assert len(np.unique(hashes)) == len(codes)


def test_language_tables_score_as_arrays_do(spark, docs_of, odd_rows):
    rows = [*odd_rows, (20, "zwei und drei sind fünf", "de"), (21, "two and three are five", "en"), (22, "漢字と仮名", "ja")]
    docs = docs_of(rows, clashes=True)
    arrays, tables = language.train(docs), language.train(docs, limit=0)
    assert type(arrays) is language.LanguageModel and type(tables) is language.LanguageTables
    a, b = (
        sorted((r.asDict() for r in language.identify(docs, m).collect()), key=lambda r: (str(r["doc_id"]), str(r["text"])))
        for m in (arrays, tables)
    )
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b, strict=True):
        assert {k: v for k, v in x.items() if k not in ("score", "cross_entropy")} == {k: y[k] for k in y if k not in ("score", "cross_entropy")}
        assert (y["score"], y["cross_entropy"]) == pytest.approx((x["score"], x["cross_entropy"]), rel=1e-4)


def test_rejection_does_not_depend_on_other_scripts(spark, docs_of):
    import random

    rng = random.Random(6)
    text = lambda letters, n, size: " ".join("".join(rng.choices(letters, k=size)) for _ in range(n))
    common = ["".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(60)]
    latin = [(k, " ".join(rng.choices(common, k=200)), "aa") for k in range(10)]
    han = [(100 + k, text([chr(0x4E00 + i) for i in range(5000)], 100, 50), "bb") for k in range(4)]
    stray = [(200, text([chr(0x0400 + i) for i in range(48, 80)], 1, 32), "aa")]
    third = [w for k in range(30) for w in (common[k], common[-1 - k], text("abcdefghijklmnopqrst", 1, 6))]
    asked = docs_of([(1, " ".join(third)), (2, " ".join(rng.choices(common, k=60)))])
    few, many = language.train(docs_of([*latin])), language.train(docs_of([*latin * 20, *han, *stray]))
    assert many.own[0] == few.own[0] and many.uniform > few.uniform + 2
    for model in (few, many):
        found = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.identify(asked, model).collect()}
        assert found == {1: ("aa", True), 2: ("aa", False)}
