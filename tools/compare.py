"""Run queries beside their SQL form in DuckDB and report differences.

Usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from locigrid.plans.catalog import load_all  # noqa: E402
from locigrid.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# DuckDB type -> Spark type
TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TINYINT": "tinyint", "FLOAT": "float", "HUGEINT": "hugeint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "x", str(v)) for v in row)


def differences(name, q, spark, con, sf_dir) -> list[str]:
    df = q.run(spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(normal(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if q.sql is None:
        return [] if rows else ["no rows"]
    relation = con.execute(f"DESCRIBE {q.sql}").fetchall()
    types = {r[0]: TYPES.get(r[1], r[1]) for r in relation}
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    if types != mine:
        out.append(f"schema {sorted(set(mine.items()) ^ set(types.items()))}")
    if sorted(types) != columns:
        return out
    picked = ", ".join(f'"{c}"' for c in columns)
    theirs = [tuple(normal(v) for v in r) for r in con.execute(f"SELECT {picked} FROM ({q.sql})").fetchall()]
    rows.sort(key=key)
    theirs.sort(key=key)
    if len(rows) != len(theirs):
        out.append(f"rows {len(rows)} against {len(theirs)}")
    bad = [(a, b) for a, b in zip(rows, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(rows)} differ, first {bad[0]}")
    if not rows:
        out.append("no rows")
    return out


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    catalog = load_all()
    names = [n for n in catalog if not args or any(n == a or catalog[n].run.__module__.endswith("." + a) for a in args)]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        began = time.time()
        try:
            found = differences(name, catalog[name], spark, con, sf_dir)
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        took = time.time() - began
        failed += bool(found)
        kind = "sql" if catalog[name].sql else "rows"
        print(f"{'FAIL' if found else 'ok  '} {name} ({kind}, {took:.1f}s) {' | '.join(found)}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
