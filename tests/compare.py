"""Run registered queries against their SQL statements; also a command line.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame, types: dict[str, str]) -> pd.DataFrame:
    out = pd.DataFrame()
    for c in sorted(df.columns):
        s = df[c]
        if types.get(c) == "DATE":
            out[c] = [str(v)[:10] for v in s]
            continue
        if s.dtype.kind == "M":
            out[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f").where(s.notna(), "NULL")
            continue
        out[c] = [("NULL" if pd.isna(v) else
                   (repr(float(v)) if isinstance(v, float) and not float(v).is_integer() else
                    str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and s.dtype.kind in "iufO"
                    else str(v)[:10] if hasattr(v, "year") else str(v))) for v in s]
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def difference(spark_df, rel: duckdb.DuckDBPyRelation) -> str | None:
    """None when equal, otherwise what differs."""
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    want = rel.df()
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    bad = [f"{n}: {t} vs {types[n]}" for n, t in spark_df.dtypes if loose.get(t, t) != types[n]]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)} {bad}"
    a, b = _norm(got, types), _norm(want, types)
    if not a.equals(b):
        rows = (a != b).any(axis=1)
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        return f"{int(rows.sum())} rows differ in {cols}\n{a[rows][cols].head(4)}\n{b[rows][cols].head(4)} {bad}"
    if bad:
        return "types " + ", ".join(bad)
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from dockwatch.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session("8")
    for n in names:
        t0 = time.time()
        try:
            df = queries()[n](spark, sf_dir)
            if n in oracle_sql():
                d = difference(df, duck(sf_dir).sql(oracle_sql()[n]))
                rows = df.count() if d is None else "?"
                print(f"{'ok  ' if d is None else 'DIFF'} {n} rows={rows} {time.time() - t0:.1f}s {d or ''}", flush=True)
            else:
                print(f"rows {n} {df.count()} {time.time() - t0:.1f}s", flush=True)
        except Exception as e:
            print(f"FAIL {n} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
