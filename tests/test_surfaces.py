"""DB-API, shell and streaming."""

import io

from pyspark.sql import functions as F

from basalt import dbapi
from basalt.cli import Shell
from basalt.database import Database
from basalt.streaming import windows


def test_dbapi(spark):
    con = dbapi.connect(spark)
    cur = con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    cur.executemany("INSERT INTO t(v) VALUES (?)", [("a",), ("b",)])
    assert cur.rowcount == 2 and cur.lastrowid == 2
    con.begin()
    con.execute("DELETE FROM t")
    con.rollback()
    cur = con.execute("SELECT id, v FROM t WHERE id >= :low ORDER BY id", {"low": 1})
    assert [d[0] for d in cur.description] == ["id", "v"] and cur.fetchone() == (1, "a") and cur.fetchall() == [(2, "b")]
    con.close()


def test_shell(spark, tmp_path):
    out = io.StringIO()
    shell = Shell(Database(spark), out)
    for line in ("CREATE TABLE t(a INT, b TEXT);", "INSERT INTO t VALUES (1, NULL), (2, 'x')", ".nullvalue -", ".mode csv", "SELECT * FROM t ORDER BY a", ".tables", ".schema t", "SELECT nope FROM t", f".export {tmp_path}/c SELECT * FROM t", f".import {tmp_path}/c u", "SELECT COUNT(*) AS n FROM u"):
        shell.run(line)
    said = out.getvalue()
    assert "a,b\n1,-\n2,x\n" in said and "CREATE TABLE t(a INT, b TEXT)" in said and "Error: no such column: nope" in said and said.endswith("n\n2\n")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", u, 1.0 * m) for m in range(0, 40, 3) for u in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, user string, v double").select(F.to_timestamp("ts").alias("ts"), "user", "v")
    df.write.parquet(f"{tmp_path}/in")
    agg = (F.count("*").alias("n"), F.sum("v").alias("s"))
    for make in (lambda d: windows.tumbling(d, "ts", "10 minutes", ["user"], *agg), lambda d: windows.sessions(d, "ts", "2 minutes", ["user"], *agg)):
        want = sorted(map(tuple, make(df).collect()), key=repr)
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        name = f"s{abs(hash(make)) % 10**6}"
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.table(name).collect()), key=repr) == want
