"""Registered queries: name -> (callable on a Corpus, cross-check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from textrules.fixtures import Corpus

Entry = tuple[Callable[[Corpus], DataFrame], str | None]


def entries() -> dict[str, Entry]:
    from textrules.catalog import (
        exports,
        incremental,
        ingest,
        matching,
        reports,
        rules,
        text,
        topics,
        vocabulary,
    )

    found: dict[str, Entry] = {}
    for module in (matching, reports, rules, vocabulary, text, ingest, exports, topics, incremental):
        for name, entry in module.ENTRIES.items():
            assert name not in found, name
            found[name] = entry
    return found
