"""Run a query in Spark and its SQL in DuckDB and compare rows, whatever their order.

    python -m checks.compare /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, int):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    found = rows(df.columns, df.collect())
    result = con.sql(sql)
    wanted = rows(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} vs {sorted(result.columns)}"
    if found != wanted:
        extra, lacking = found - wanted, wanted - found
        return f"{sum(found.values())} vs {sum(wanted.values())} rows; only here {list(extra)[:2]}; only there {list(lacking)[:2]}"
    return None


def main() -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from veilframe.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "checks", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) if name in ORACLES else f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as error:  # keep going: one report for all
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{time.time() - started:7.2f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
