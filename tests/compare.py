"""Runs queries in Spark and DuckDB on one folder and compares their rows as the driver does. python -m tests.compare FOLDER [NAME...]"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings kb ner_train re_train input_entities linked_mentions entities triples nodes eval_samples ref_entries mix_targets".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def oracle(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    c = con.execute(sql)
    return [x[0] for x in c.description], c.fetchall()


def compare(spark, folder, name, query, sql):
    df = query(spark, folder)
    got = df.collect()
    cols, want = oracle(folder, sql)
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        x, y = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} / {len(b)} rows; only Spark {len(x)} {sorted(x)[:2]}; only SQL {len(y)} {sorted(y)[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q, o = E.queries(), E.oracle_sql()
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            if n in o:
                said = compare(spark, sys.argv[1], n, q[n], o[n]) or "equal"
            else:
                said = f"rows {q[n](spark, sys.argv[1]).count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + " ".join(str(e).split())[:600]
        print(f"{n}: {said[:900]} [{time.time() - t:.1f} s]", flush=True)
