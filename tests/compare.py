"""Run registered queries on Spark and on DuckDB and compare rows.

    python tests/compare.py [--sf=0.01] [--show] [name or prefix* ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from surco.session import build_session  # noqa: E402
from surco.sources.adapters import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return (1, "")
    if isinstance(v, bool):
        return (0, str(int(v)))
    if isinstance(v, float):
        return (0, repr(v + 0.0))
    if isinstance(v, int):
        return (0, str(v))
    return (0, str(v))


def main(argv):
    sf = "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf = f"/root/testdata/sf{a[5:]}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name not in oracles:
                print(f"ROWS  {name}: {len(rows)} rows {took:.1f}s")
                if "--show" in argv:
                    print("  ", df.columns, rows[:3])
                continue
            t = time.time()
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            other = cur.fetchall()
            if sorted(cols) != sorted(df.columns):
                print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(cols)}")
                failed.append(name)
                continue
            a = sorted(tuple(norm(r[df.columns.index(c)]) for c in sorted(cols)) for r in rows)
            b = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in other)
            if a == b:
                types = [(c, ty) for c, ty in df.dtypes if ty.startswith(("array", "map", "struct", "decimal", "date", "timestamp", "boolean"))]
                print(f"ok    {name}: {len(a)} rows {took:.1f}s oracle {time.time()-t:.1f}s {types or ''}")
                if "--show" in argv:
                    print("  ", df.columns, rows[:3])
            else:
                failed.append(name)
                from collections import Counter
                ca, cb = Counter(a), Counter(b)
                oa, ob = list((ca - cb).elements())[:3], list((cb - ca).elements())[:3]
                print(f"FAIL  {name}: {len(a)} vs {len(b)} rows; cols {sorted(cols)}")
                for x in oa:
                    print("   spark ", [v[1] if v[0] == 0 else None for v in x])
                for x in ob:
                    print("   oracle", [v[1] if v[0] == 0 else None for v in x])
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name}: {str(e)[:600]}")
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
