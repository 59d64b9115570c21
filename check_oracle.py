"""Run registered queries beside their checking SQL: check_oracle.py [sf] [name ...].

MAX_GROUP_ROWS in the environment lowers the limit above which a group is cut
into chunks, so that the path for hot keys is checked as well.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from registry import ORACLE, QUERIES
from registry.fixtures import SOURCES


def session(shared: str) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if "MAX_GROUP_ROWS" in os.environ:
        spark.conf.set("spark.opsight.maxGroupRows", os.environ["MAX_GROUP_ROWS"])
    return spark


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def _cell(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return f"rows-only {len(rows)}"
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    got, exp = normal(rows, df.columns), normal(want, columns)
    kinds = {c: {type(r[i]).__name__ for r in rows} for i, c in enumerate(df.columns)}
    wkinds = {c: {type(r[i]).__name__ for r in want} for i, c in enumerate(columns)}
    diff = {c: (kinds[c], wkinds[c]) for c in kinds if rows and want and kinds[c] != wkinds[c]}
    if got != exp:
        only = [x for x in got if x not in set(exp)][:2] if len(got) < 200000 else []
        miss = [x for x in exp if x not in set(got)][:2] if len(got) < 200000 else []
        return f"MISMATCH {len(got)} vs {len(exp)} {sorted(columns)} spark={only} sql={miss} types={diff}"
    if diff:
        return f"TYPES {diff}"
    return f"ok {len(got)}"


def main() -> int:
    with tempfile.TemporaryDirectory() as shared:
        return check(shared)


def check(shared: str) -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/{sf}"
    spark = session(shared)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in (*SOURCES, "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict = "ERROR " + str(error)[:600].replace("\n", " ")
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:40s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
