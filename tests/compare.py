"""python tests/compare.py SF NAME...: run queries beside their SQL and compare all values."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        if isinstance(v, dict):
            return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(sf, names):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for p in Path(base).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, base)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took, t = time.time() - t, time.time()
            if name not in sql:
                print(f"{name}: rows {len(got)} in {took:.1f} s, no SQL", flush=True)
                continue
            r = con.sql(sql[name])
            want = rows_of(r.columns, r.fetchall())
            ok = sorted(df.columns) == sorted(r.columns) and [repr(x) for x in got] == [repr(x) for x in want]
            bad += not ok
            print(f"{name}: {'same' if ok else 'DIFFERENT'} rows {len(got)}/{len(want)} in {took:.1f} s, SQL {time.time() - t:.1f} s", flush=True)
            if not ok:
                print("  columns", sorted(df.columns), sorted(r.columns))
                a, b = set(map(repr, got)), set(map(repr, want))
                print("  only here", sorted(a - b)[:3], "\n  only SQL", sorted(b - a)[:3], flush=True)
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
