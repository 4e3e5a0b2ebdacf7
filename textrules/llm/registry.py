"""The registered queries of this package and their cross-checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textrules.llm import (
    bpe_tree,
    circulant,
    crf,
    decontaminate,
    fertility,
    jaccard,
    language,
    passages,
    piece_table,
    secrets,
    spelling,
    token_counts,
    warc,
)
from textrules.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(read(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_fertility": _over("documents", fertility.query),
    "op2_warc": _over("pages", warc.query),
    "op3_passages": _over("documents", passages.query),
    "op4_token_counts": _over("documents", token_counts.query),
    "op5_bpe_tree": _over("documents", bpe_tree.query),
    "op6_decontaminate": lambda spark, d: decontaminate.query(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op7_jaccard": _over("documents", jaccard.query),
    "op8_crf": lambda spark, d: crf.query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op9_language": _over("documents", language.query),
    "op10_secrets": _over("documents", secrets.query),
    "op11_circulant": _over("documents", circulant.query),
    "op12_piece_table": _over("documents", piece_table.query),
    "op13_spelling": _over("documents", spelling.query),
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op7_jaccard": jaccard.ORACLE,
    "op11_circulant": circulant.ORACLE,
    "op12_piece_table": piece_table.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
