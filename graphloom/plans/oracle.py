"""Queries against their SQL twins in DuckDB: row counts, names, kinds of types and values."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return list(map(_norm, v)) if isinstance(v, list) else v


def compare(spark, build, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    df = build(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    kinds = dict(zip(names, [str(d[1]) for d in want.description]))
    order = sorted(names)
    a = sorted(([_norm(r[c]) for c in order] for r in df.collect()), key=repr)
    b = sorted(([_norm(r[names.index(c)]) for c in order] for r in expected), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = {c: (t, kinds[c]) for c, t in df.dtypes if t in simple and simple[t] not in kinds[c] and kinds[c] != "NUMBER" and kinds[c] != "STRING" and kinds[c] != "bool"}
    return f"types {off}" if off else None
