"""Run registered queries against their SQL counterparts and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree, else a short description."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = rows_of(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(mine) != len(theirs):
        left = [r for r in mine if r not in set(theirs)][:2]
        right = [r for r in theirs if r not in set(mine)][:2]
        return f"rows {len(mine)} vs {len(theirs)}; only Spark {left}; only SQL {right}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values {a} vs {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    from auditlake.session import build_session
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf_dir = argv[0]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                result = difference(spark, con, QUERIES[name], ORACLE[name], sf_dir) or "ok"
            else:
                result = f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as exc:  # report and go on
            result = f"ERROR {str(exc)[:500]}"
        bad += not (result == "ok" or result.startswith("no SQL"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
