"""Runs queries beside their SQL in DuckDB and compares all values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ("none",)
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "int32", "int64", "float64"):
        return ("n", round(float(x), 6))
    return ("s", str(x))


def mismatch(spark_df, con, sql):
    """Empty if the results agree, else what differs."""
    got_names = sorted(spark_df.columns)
    got = sorted((tuple(_cell(r[c]) for c in got_names) for r in spark_df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    if sorted(names) != got_names:
        return f"columns {got_names} and {sorted(names)}"
    at = [names.index(c) for c in got_names]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    return next((f"{a} and {b}" for a, b in zip(got, want) if a != b), "")
