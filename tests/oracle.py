"""Run registered queries next to their SQL and report differences."""

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else repr(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False, name=None))


def difference(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"rows {len(a)} vs {len(b)}; first differences {bad}"
    if not a:
        return "no rows"
    return None


def main(names, sf="0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tunelens.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = difference(spark, con, sf_dir, query, sqls[name])
            else:
                rows = query(spark, sf_dir).toPandas()
                diff = None if len(rows) else "no rows"
                if "-v" in names:
                    print(rows.head(12).to_string())
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{name:32s} {'SQL ' if name in sqls else 'weak'} {time.time() - start:6.2f}s {diff or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "0.01"
    if args and args[0].startswith("sf"):
        sf = args.pop(0)[2:]
    main(args, sf)
