"""Side-by-side comparison of registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, build, sql):
    """Empty text when the query and its SQL agree, else what differs."""
    df = build(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if shape in plan:
            return f"the plan has a {shape}"
    cur = con.execute(sql)
    names, expected = [d[0] for d in cur.description], cur.fetchall()
    kinds = {d[0]: str(d[1]) for d in cur.description}
    cols, got = canonical(df.columns, rows)
    ecols, want = canonical(names, expected)
    if cols != ecols:
        return f"columns {cols} != {ecols}"
    if not want:
        return "the check has no rows"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]} in {cols}"
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT"}
    off = [(n, t, kinds[n]) for n, t in df.dtypes if simple.get(t) != kinds[n] and kinds[n] != '"NULL"']
    return f"types {off}" if off else ""
