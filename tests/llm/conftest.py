import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Columns that operators use inside or give out: the input may have them too.
CLASHES = (
    "node", "key", "keys", "score", "n_tokens", "ids", "candidates", "digest", "owner", "_row", "component_id",
    "item_id", "distance", "rejected", "lang_pred", "kept", "n_words", "script", "text_hash", "region", "first", "payload",
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows, with clashing columns if asked for."""

    def build(rows, clashes=False):
        full = []
        for r in rows:
            i, text, lang, source = (*r, "en", "src0")[:4] if len(r) == 2 else (*r, "src0")[:4]
            full.append((i, text, lang, source, None if text is None else len(text)))
        schema = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in CLASHES)] if clashes else DOCS.fields)
        return spark.createDataFrame([(*r, *(["x"] * len(CLASHES) if clashes else [])) for r in full], schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of line{i % 31}" for i in range(60_000))
    same = "the very same words stand here once more and again " * 3
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", "b"), (4, long, "de", "b"), (5, same, "en", "a"),
        (5, same, "en", "a"), (6, same, "en", None), (7, "short", None, "c"), (None, same, None, None),
        (None, "no id here but some words all the same", "fr", "c"), (8, "é日本語 😀 ñandú", "es", "d"),
        (9, "a\x00b \x1c   c\r\nd", "en", "d"), (10, "x" * 300_000, "en", "e"),
    ]
