"""Run registered queries against their SQL: ``python compare.py [sf_dir] [name …]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], str, list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    sql_took = time.time() - start
    mine, mine_hash, mine_lines = digest(df.columns, got)
    theirs, theirs_hash, theirs_lines = digest(names, want)
    note = f"{len(got)} rows, {took:.1f}s (sql {sql_took:.1f}s)"
    if mine != theirs:
        return False, f"{note}: columns {mine} != {theirs}"
    if mine_hash != theirs_hash:
        extra = [x for x in mine_lines if x not in set(theirs_lines)][:2]
        lack = [x for x in theirs_lines if x not in set(mine_lines)][:2]
        return False, f"{note}: {len(want)} expected; only ours {extra}; only sql {lack}"
    return True, note


def main() -> None:
    from confluo.checks import ORACLES, QUERIES
    from confluo.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in args or QUERIES:
        try:
            ok, note = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
