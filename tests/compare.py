"""Runs a catalogue query and its SQL counterpart and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "STRING": "VARCHAR", "BIGINT": "BIGINT", "INT": "INTEGER", "BOOLEAN": "BOOLEAN",
    "DATE": "DATE", "DOUBLE": "DOUBLE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{"/*.parquet" if os.path.isdir(path) else ""}')")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, types and the bag of rows agree."""
    result = con.execute(sql)
    wanted = {d[0]: str(d[1]) for d in result.description}
    expected_rows = result.fetchall()
    found = {f.name: f.dataType.simpleString().upper() for f in df.schema}
    if sorted(found) != sorted(wanted):
        return [f"columns {sorted(found)} against {sorted(wanted)}"]
    problems = []
    for name, kind in found.items():
        kind = KINDS.get(kind, kind)
        if kind.replace(" ", "") != wanted[name].replace(" ", ""):
            problems.append(f"type of {name}: {kind} against {wanted[name]}")
    names = sorted(found)
    position = {name: i for i, name in enumerate(wanted)}
    ours = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    theirs = sorted((tuple(row[position[n]] for n in names) for row in expected_rows), key=repr)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    for a, b in zip(ours, theirs):
        if a != b:
            problems.append(f"first difference {a} against {b}")
            break
    return problems
