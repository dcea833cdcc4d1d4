"""Run registered queries and their SQL side by side: [EXACT=1] python tests/oracle_check.py [sf] [name...]"""
import datetime, decimal, math, sys, time, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from pyspark.sql import SparkSession

# EXACT=1 compares floating values to the last bit.
EXACT = os.environ.get("EXACT") == "1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and EXACT:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(norm(x) for x in v.values()) + "}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, queries, oracles):
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in oracles:
        return len(got), None
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols] if sorted(names) == cols else None
    if idx is None:
        return len(got), f"columns {cols} vs {sorted(names)}"
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    if got == want:
        return len(got), ""
    a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return len(got), f"{cols} rows {len(got)} vs {len(want)}\n   spark {a}\n   duck  {b}"


def session():
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if want and not any(w in name for w in want):
            continue
        t = time.time()
        try:
            n, msg = compare(spark, con, sf_dir, name, q, o)
        except Exception as ex:
            n, msg = -1, f"ERROR {type(ex).__name__} {str(ex)[:700]}"
        state = "rows-only" if msg is None else "ok" if msg == "" else "FAIL"
        bad += state == "FAIL"
        print(f"{state:9} {name:40} {n:8} {time.time()-t:6.2f}s {msg or ''}", flush=True)
    print("failures", bad)
