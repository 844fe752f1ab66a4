"""Run registered queries beside their SQL and report differences.

Usage: python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def oracle(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, folder, query, sql):
    frame = query(spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(ours)
    if ours == theirs:
        return None, len(ours)
    extra, missing = set(ours) - set(theirs), set(theirs) - set(ours)
    sample = "\n".join(f"    ours   {str(r)[:600]}" for r in sorted(extra)[:3])
    sample += "\n" + "\n".join(f"    theirs {str(r)[:600]}" for r in sorted(missing)[:3])
    return f"{len(ours)} rows vs {len(theirs)}; {len(extra)} extra, {len(missing)} missing\n{sample}", len(ours)


def main() -> None:
    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), oracle(folder)
    spark.sparkContext.setLogLevel("ERROR")
    oracles = contract.oracle_sql()
    failed = []
    for name, query in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, count = difference(spark, con, folder, query, oracles[name])
            else:
                problem, count = None, query(spark, folder).count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", 0
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={count} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
