"""Registered queries of sources, sinks, functions and streams, with DuckDB SQL for their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..database import Database
from ..session import Engine
from ..sources import files
from ..sources.store import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def _made(spark: SparkSession, sf_dir: str, folder: str | None = None) -> Database:
    """A database with a table t of the nations, an index and a view."""
    db = Database(spark, folder)
    db.load(sf_dir, "nation")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, r INT); INSERT INTO t SELECT n_nationkey + 1, n_name, n_regionkey FROM nation")
    db.execute("CREATE INDEX ix ON t(r); CREATE VIEW w AS SELECT r, COUNT(*) AS n FROM t GROUP BY r")
    return db


_T = "SELECT (n_nationkey + 1)::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS r FROM nation"


def s16_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "csv")
    files.export_csv(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(', "'))).alias("note")), path)
    return files.import_csv(spark, path)


def s18_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "json")
    files.export_json(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal")), path)
    return files.import_json(spark, path).select("c_custkey", "c_name", "bal")


def s19_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .introspect import dump

    other = Database(spark)
    for statement in dump(_made(spark, sf_dir), rows=500):
        other.execute(statement)
    return other.query("SELECT id, name, r FROM t")


def s20_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "backup")
    _made(spark, sf_dir).execute(f"BACKUP DATABASE TO '{path}'")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/t").select("id", "name", "r")


def s22_file_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _place(spark, "own")).query("SELECT id, name, r FROM t")


def _asked(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _made(spark, sf_dir).query(sql)


def l22_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).load(sf_dir, "orders")
    return e.query("SELECT o_orderkey FROM orders WHERE o_custkey > :low AND o_orderstatus = :status", {"low": 10, "status": "O"})


def l30_dbapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import dbapi

    con = dbapi.connect(spark)
    con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    con.cursor().executemany("INSERT INTO t(v) VALUES (?)", [("a",), ("b",), (None,)])
    return spark.createDataFrame(con.execute("SELECT id, v FROM t WHERE id <> ?", [2]).fetchall(), "id long, v string")


def l31_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parser import SqlError

    db, out = _made(spark, sf_dir), []
    for sql in ("SELECT nope FROM t", "SELECT * FROM nope", "SELECT nope(1)", "SELEC 1", "INSERT INTO t VALUES (1, 'x', 1)", "INSERT INTO t VALUES (99, NULL, 1)", "CREATE TABLE t(a INT)"):
        try:
            db.execute(sql)
            out.append((sql, "ok"))
        except SqlError as x:
            out.append((sql, str(x).split(":")[0]))
    return spark.createDataFrame(out, "sql string, said string")


def l26_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).query("PRAGMA integrity_check").toDF("said")


def l05_partial_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _made(spark, sf_dir)
    db.execute("CREATE TABLE p(a INT, b TEXT); CREATE UNIQUE INDEX u ON p(a) WHERE b IS NOT NULL")
    db.execute("INSERT INTO p SELECT r, CASE WHEN id < 4 THEN name END FROM t WHERE id > 2")
    return db.query("SELECT a, b FROM p")


def s15_fts5(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.load(sf_dir, "documents")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id, body); INSERT INTO f SELECT doc_id, text FROM documents")
    return db.query("SELECT CAST(id AS INTEGER) AS id FROM f WHERE f MATCH '\"rights reserved\" OR token NOT license'")


def s14_series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.execute("CREATE VIRTUAL TABLE s USING series(2, 50, 4)")
    return db.query("SELECT value FROM s")


def l19_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _made(spark, sf_dir)
    db.execute("DELETE FROM t WHERE r = 1; INSERT INTO t VALUES (70, 'x', 1); REINDEX; VACUUM")
    return db.query("SELECT id, name, r FROM t")


def f15_own_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).load(sf_dir, "customer")
    e.create_function("initials", lambda s: s.str.slice(0, 3), "text", ["text"])
    e.create_aggregate("spread", lambda s: float(s.max() - s.min()), "real", ["real"])
    return e.query("SELECT initials(c_mktsegment) AS seg, spread(c_custkey) AS s FROM customer GROUP BY c_mktsegment")


def d15_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.max("event_id").alias("last"))


def d15_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by a stream of the table; each batch writes the windows as they are then."""
    from ..streaming.windows import tumbling

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    path = _place(spark, "windows")
    out = tumbling(stream, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.max("event_id").alias("last"))
    query = out.writeStream.outputMode("complete").option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def d15_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import sessions

    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))


_WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY ALL"
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
k AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, user_id, COUNT(*) AS n FROM k GROUP BY user_id, s"""


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) x({columns})"


QUERIES = {
    f.__name__: f
    for f in (s16_csv, s18_json, s19_dump, s20_backup, s22_file_backed, l22_parameters, l30_dbapi, l31_error_codes, l26_integrity, l05_partial_unique, l19_vacuum, s14_series_table, s15_fts5, f15_own_functions, d15_windows, d15_stream, d15_sessions)
} | {
    "s11_tables": _asked("SELECT table_name, table_type FROM information_schema.tables"),
    "s11_views": _asked("SELECT table_name FROM information_schema.views"),
    "s11_table_constraints": _asked("SELECT constraint_name, table_name, constraint_type FROM information_schema.table_constraints"),
    "s11_key_columns": _asked("SELECT constraint_name, column_name, ordinal_position FROM information_schema.key_column_usage"),
    "s13_extensions": _asked("SELECT COUNT(*) > 0 AS some FROM extensions WHERE name IN ('json', 'series')"),
    "l17_index_list": _asked("PRAGMA index_list(t)"),
    "m19_changes": _asked("SELECT last_insert_rowid() AS id, changes() AS n"),
}

SQL = {
    "s16_csv": "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', \"' END AS note FROM customer",
    "s18_json": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer",
    "s14_series_table": "SELECT UNNEST(generate_series(2, 50, 4))::BIGINT AS value",
    "s15_fts5": "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])rights[^a-z0-9]+reserved($|[^a-z0-9])') OR regexp_matches(lower(text), '(^|[^a-z0-9])token($|[^a-z0-9])') AND NOT regexp_matches(lower(text), '(^|[^a-z0-9])license($|[^a-z0-9])')",
    "l19_vacuum": f"SELECT * FROM ({_T}) WHERE r <> 1 UNION ALL SELECT 70, 'x', 1",
    "s19_dump": _T,
    "s20_backup": _T,
    "s22_file_backed": _T,
    "l22_parameters": "SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_orderstatus = 'O'",
    "l30_dbapi": _values("id, v", "(1::BIGINT, 'a')", "(3, NULL)"),
    "l31_error_codes": _values(
        "sql, said",
        "('SELECT nope FROM t', 'no such column')",
        "('SELECT * FROM nope', 'no such table')",
        "('SELECT nope(1)', 'no such function')",
        "('SELEC 1', 'near \"SELEC\"')",
        "('INSERT INTO t VALUES (1, ''x'', 1)', 'UNIQUE constraint failed')",
        "('INSERT INTO t VALUES (99, NULL, 1)', 'NOT NULL constraint failed')",
        "('CREATE TABLE t(a INT)', 'table t already exists')",
    ),
    "l26_integrity": "SELECT 'ok' AS said",
    "l05_partial_unique": f"SELECT r AS a, CASE WHEN id < 4 THEN name END AS b FROM ({_T}) WHERE id > 2",
    "f15_own_functions": "SELECT c_mktsegment[1:3] AS seg, (MAX(c_custkey) - MIN(c_custkey))::DOUBLE AS s FROM customer GROUP BY c_mktsegment",
    "d15_windows": _WINDOWS,
    "d15_stream": _WINDOWS,
    "d15_sessions": _SESSIONS,
    "s11_tables": _values("table_name, table_type", "('t', 'BASE TABLE')", "('w', 'VIEW')"),
    "s11_views": "SELECT 'w' AS table_name",
    "s11_table_constraints": _values("constraint_name, table_name, constraint_type", "('t_pk', 't', 'PRIMARY KEY')", "('t_unique_1', 't', 'UNIQUE')"),
    "s11_key_columns": _values("constraint_name, column_name, ordinal_position", "('t_pk', 'id', 1::BIGINT)", "('t_unique_1', 'name', 1)"),
    "s13_extensions": "SELECT 1::BIGINT AS some",
    "l17_index_list": "SELECT 0::BIGINT AS seq, 'ix' AS name, 0::BIGINT AS \"unique\", 'c' AS origin, 0::BIGINT AS partial",
    "m19_changes": "SELECT COUNT(*)::BIGINT AS id, COUNT(*)::BIGINT AS n FROM nation",
}
