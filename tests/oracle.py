"""Run registered queries on Spark and their cross-check SQL on DuckDB and compare.

As a script: ``python tests/oracle.py <sf folder> [query …]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp", "DATE": "date",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, query) -> list[str]:
    result = con.execute(query)
    names = [d[0] for d in result.description]
    kinds = {r[0]: KINDS.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {query}").fetchall()}
    expected = rows_of(names, con.execute(query).fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if {k: kinds.get(k) for k in mine} != mine:
        problems.append(f"types {mine} against {kinds}")
    if got != expected:
        problems.append(
            f"rows {sum(got.values())} against {sum(expected.values())}; "
            f"only here {list((got - expected).items())[:2]}; "
            f"only there {list((expected - got).items())[:2]}"
        )
    if not expected:
        problems.append("no rows: proves nothing")
    return problems


def main(sf_dir: str, wanted: list[str]) -> None:
    import __spark_entry__ as entry
    from textrules.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    checks = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in checks:
                problems = compare(df, con, checks[name])
                note = "exact"
            else:
                problems, note = [], f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], "error"
        print(f"{'FAIL' if problems else 'ok':4} {name} {note} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
