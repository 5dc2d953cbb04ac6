"""Compare every registered query with its SQL twin in DuckDB: `python -m tests.oracle [names]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def rows_of(frame):
    names = sorted(frame.columns)
    return names, [tuple(_cell(v) for v in row) for row in frame[names].itertuples(index=False)]


def _key(row):
    return tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in row)


def compare(spark_df, sql: str, con) -> str:
    """Empty text when equal, otherwise a description of the first difference."""
    left_names, left = rows_of(spark_df.toPandas())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    right_names = [names[i] for i in order]
    right = [tuple(_cell(row[i]) for i in order) for row in cursor.fetchall()]
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    left, right = sorted(left, key=_key), sorted(right, key=_key)
    for a, b in zip(left, right):
        for name, x, y in zip(left_names, a, b):
            if isinstance(x, float) and isinstance(y, int) and x == y:
                # pandas turns nullable integers into floats
                continue
            if type(x) is not type(y):
                return f"{name}: {type(x).__name__} {x!r} != {type(y).__name__} {y!r} in {a} / {b}"
            if isinstance(x, float):
                if x != y and not math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12):
                    return f"{name}: {x!r} != {y!r} in {a} / {b}"
            elif x != y:
                return f"{name}: {x!r} != {y!r}\n  {a}\n  {b}"
    return ""


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tallyglass.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                text = compare(df, oracles[name], con)
                status = "ok" if not text else "DIFF " + text[:1500]
            else:
                status = f"rows {len(df.toPandas())}"
        except Exception as exc:  # noqa: BLE001
            text = status = "ERROR " + str(exc)[:1500]
        bad += status[:2] not in ("ok", "ro")
        print(f"{name:40s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
