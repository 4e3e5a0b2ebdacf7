"""The pipeline at the smallest folder, stage by stage against plain versions."""

import hashlib
import zlib

import corpus_pipeline
import oracle
import plain
import public_tokenizers

from textrules.llm import bpe_tree, decontaminate

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    con = oracle.duck(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = con.execute("SELECT text FROM benchmark").fetchall()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if k < 4:
            assert sorted(docs.columns) == sorted(COLUMNS)
        if name == "language ID":
            assert len(after) >= 0.98 * len(before)
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in plain.components(before).items() if i == c}
        if name == "benchmark decontamination":
            held = {
                i for i, t in before.items() for (b,) in items
                if plain.least_distance(plain.letters(b), plain.letters(t)) <= decontaminate.allowed(len(plain.letters(b)), 0.8)
            }
            assert set(after) == set(before) - held
        if name == "secret scans":
            assert set(after) == set(before)
            assert all(after[i] == before[i] for i in after if not plain.spans(before[i]) and "[secret]" not in after[i])
            assert all("[secret]" in after[i] for i in after if any(x[0] == "access" for x in plain.spans(before[i])))
        if name == "byte-level BPE":
            encoding = bpe_tree.BpeTree(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).encoding
            assert set(after) == set(before)
            for r in rows:
                assert list(r["ids"]) == encoding.encode_ordinary(r["text"])
                assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        before = after


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = corpus_pipeline.run(spark, SF)
    assert {"ids", "n_tokens", *COLUMNS} <= set(rows.columns) and rows.count() > 100


def test_languages_are_learned_from_all_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:6]
    rest = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:6]
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 5, "en", "s", 1) for i in rest]
    rows += [(i, "съешь ещё этих мягких французских булок да выпей чаю " * 5, "ru", "s", 1) for i in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_languages(spark, docs, SF).collect()
    assert {r["doc_id"] for r in kept} == {*held, *rest}
