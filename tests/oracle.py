"""Run registered queries beside their SQL and compare the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine[1]) > 0, f"{len(mine[1])} rows, no SQL"
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return False, f"{len(mine[1])} vs {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if repr(a) != repr(b)]
    if bad:
        return False, f"{len(bad)} of {len(mine[1])} rows differ, first {str(bad[0])[:1500]}"
    return True, f"{len(mine[1])} rows"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls, good = entry.oracle_sql(), 0
    names = [n for n in entry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, entry.queries()[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        good += ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{good}/{len(names)}")


if __name__ == "__main__":
    main()
