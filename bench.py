"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Rows of the bulk insert.
INSERTED = 100_000

HEADLINE = ("b1_select_all", "b2_where", "b3_sum", "b4_group_by", "b5_count", "b6_join", "b7_order_limit", "flagship", "j09_n_way", "w02_row_number", "a01_group", "x03_bm25")


def main() -> None:
    from pyspark.sql import SparkSession

    from basalt import registry
    from basalt.database import Database

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):  # the first run reads and compiles; the best of three counts
            began = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 4)
    best = float("inf")
    for _ in range(3):  # bulk insert: one statement into an empty table, constraints checked
        db = Database(spark)
        db.load(folder, "lineitem")
        db.execute("CREATE TABLE t(k INT NOT NULL, q REAL, s TEXT)")
        began = time.perf_counter()
        db.execute(f"INSERT INTO t SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem LIMIT {INSERTED}")
        best = min(best, time.perf_counter() - began)
    seconds["b8_insert"] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
