"""Run a registered query and its SQL on the same tables and compare."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    wanted = relation.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = spark_df.collect()
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    a, b = _bag(spark_df.columns, got), _bag(names, wanted)
    if a == b:
        return None
    return f"only spark {list((a - b).items())[:3]}, only sql {list((b - a).items())[:3]}"
