"""Run queries and their SQL side by side and compare rows, types and values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT",
    "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty when both agree."""
    found = []
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} != {sorted(names)}"]
    for name, kind in result.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    ours = Counter(tuple(_plain(v) for v in r) for r in result.select(*order).toLocalIterator())
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rows)
    if ours != theirs:
        more, less = list((ours - theirs).items()), list((theirs - ours).items())
        found.append(
            f"{sum(ours.values())} rows != {sum(theirs.values())}; only here "
            f"{sum(n for _, n in more)}, e.g. {sorted(more, key=str)[:2]}; only there "
            f"{sorted(less, key=str)[:2]}; columns {order}"
        )
    return found
