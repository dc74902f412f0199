"""Compare registered queries with their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = "/root/testdata"


def duck(folder):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, run, text, folder, may_be_empty=False):
    """An empty string when both results agree, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = con.execute(text)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, result.fetchall())
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{name}: {len(got)} rows and {len(want)}; only here {extra}; only in SQL {missing}"
    if not got and not may_be_empty:
        return f"{name}: no rows"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {c[0]: str(c[1]).lower() for c in result.description}
    same = {"bigint": "bigint", "int": "integer", "string": "varchar", "boolean": "bool", "double": "double",
            "timestamp_ntz": "timestamp"}
    for column, kind in spark_types.items():
        if not duck_types[column].startswith(same[kind][:4]):
            return f"{name}: {column} is {kind} and {duck_types[column]}"
    return ""


def main():
    import __spark_entry__ as entry
    from conftest import make_session
    scale, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    folder = f"{DATA}/sf{scale}"
    spark, con = make_session(), duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, run, oracles[name], folder) if name in oracles else "no SQL"
        except Exception as error:
            problem = f"{name}: {type(error).__name__} {str(error)[:700]}"
        bad += bool(problem)
        print(f"{time.time() - start:6.2f}s {name} {problem or 'ok'}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
