"""Compare registered queries with their SQL on the same tables.

``python -m tests.oracle_check [sf_dir] [query ...]`` prints one line per query.
"""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# Spark type -> DuckDB type that carries the same values
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def compare(df, con, sql):
    """None if equal, else what differs."""
    names = sorted(df.columns)
    result = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(sql_types) != names:
        return f"columns {names} against {sorted(sql_types)}"
    spark_types = dict(df.dtypes)
    other = [n for n in names if SAME.get(spark_types[n]) != sql_types[n]]
    if other:
        return f"types {[(n, spark_types[n], sql_types[n]) for n in other]}"
    order = [[d[0] for d in result.description].index(n) for n in names]
    expected = sorted(([r[i] for i in order] for r in result.fetchall()), key=_key)
    got = sorted(([r[n] for n in names] for r in df.collect()), key=_key)
    if len(got) != len(expected):
        return f"rows {len(got)} against {len(expected)}"
    if not got:
        return "no rows"
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            if not same:
                return f"{dict(zip(names, a))} against {dict(zip(names, b))}"
    return None


def main():
    from pyspark.sql import SparkSession

    from acuity.plans.oracle import ORACLE
    from acuity.plans.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    wrong = 0
    for name in sys.argv[2:] or list(ORACLE):
        start = time.time()
        try:
            problem = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:30s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{wrong} differ")


if __name__ == "__main__":
    main()
