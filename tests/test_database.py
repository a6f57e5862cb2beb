"""DDL, DML, constraints, triggers and transactions against Python's sqlite3, statement by statement."""

import sqlite3

import pytest

from basalt.database import ConstraintError, Database
from basalt.plans import introspect
from basalt.plans.parser import SqlError
from basalt.sources import files

SCRIPT = [
    'create table d(id integer primary key, name text unique, score real default 1.5, flag int not null default 7, check (score >= 0))',
    "insert into d(name, score) values ('a', 2), ('b', '3.5'), ('c', 4)",
    "insert into d(id, name) values (10, 'x')",
    "insert into d(name) values ('y')",
    'select * from d',
    "insert into d(name) values ('a')",
    "insert into d(name, score) values ('neg', -1)",
    "insert into d(name, flag) values ('n', null)",
    "insert or ignore into d(name, score) values ('a', 9), ('z', 9), ('z', 10)",
    "insert or replace into d(id, name, score) values (1, 'a2', 5), (99, 'b', 6)",
    'select * from d',
    "insert into d(name, score) values ('a2', 50), ('new', 60) on conflict(name) do update set score = excluded.score + d.score, flag = 1 where d.flag = 7",
    'select * from d',
    'update d set score = score * 2, flag = flag + id where id > 5',
    'select id, name, score, flag from d',
    'update d set flag = null where id = 1',
    "update d set name = 'zz' where id in (select id from d where score > 10)",
    "delete from d where name like 'z%' or score is null",
    'select * from d',
    "insert into d(name) values ('r1'), ('r2') returning id, name || '!', score",
    "update d set score = 0 where name = 'r1' returning *",
    "delete from d where name = 'r2' returning name",
    'create table p(id integer primary key, v text)',
    'create table ch(id integer primary key, pid integer references p(id) on delete cascade on update cascade, w text)',
    'create table ch2(id integer primary key, pid integer references p(id) on delete set null)',
    'create table ch3(pid integer references p(id))',
    "insert into p values (1,'one'),(2,'two'),(3,'three')",
    "insert into ch values (1,1,'a'),(2,1,'b'),(3,2,'c')",
    'insert into ch2 values (1,1),(2,3)',
    'insert into ch3 values (2)',
    "insert into ch values (9, 77, 'bad')",
    'delete from p where id = 1',
    'select * from ch',
    'select * from ch2',
    'delete from p where id = 2',
    'select * from p',
    'update p set id = 30 where id = 3',
    'begin',
    "insert into p values (100,'t')",
    'savepoint s1',
    'delete from p',
    'rollback to s1',
    'select count(*) from p',
    'rollback',
    'select count(*) from p',
    'create table log(msg text)',
    "create trigger t1 after insert on p when new.id > 50 begin insert into log values ('ins ' || new.v); end",
    "create trigger t2 after update on p begin insert into log values (old.v || '->' || new.v); end",
    "create trigger t3 before delete on p begin insert into log values ('del ' || old.id); end",
    "insert into p values (60,'sixty'),(5,'five')",
    "update p set v = v || '+' where id in (60, 5)",
    'delete from p where id = 5',
    'select * from log',
    'create table src(k integer, nv text)',
    "insert into src values (60,'from'),(2,'x')",
    'update p set v = src.nv from src where src.k = p.id and p.id = 60',
    'select * from p',
    'alter table src add column extra int default 5',
    'alter table src rename column nv to val',
    'select * from src',
    'alter table src drop column extra',
    'alter table src rename to src2',
    'select * from src2',
    'create view vw as select k * 2 as kk from src2',
    'select * from vw',
    'create table cp as select k, val from src2 where k > 10',
    'select * from cp',
    'drop table cp',
    'select * from cp',
    'create unique index ui on src2(k)',
    "insert into src2 values (2, 'dup')",
    'insert into src2 select id, v from p where id > 55 and id not in (select k from src2)',
    "select type, name, tbl_name from sqlite_master where type in ('table','view') order by name",
    'insert into d default values',
    'create table if not exists d(x int)',
    'drop view vw',
    'drop table nothere',
    'drop table if exists nothere',
]


def shaped(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_script_equals_sqlite(spark):
    db, lite = Database(spark), sqlite3.connect(":memory:", isolation_level=None)
    lite.execute("PRAGMA foreign_keys = ON")
    for sql in SCRIPT:
        try:
            want = shaped(lite.execute(sql).fetchall())
        except sqlite3.Error:
            want = "error"
        try:
            rows = db.execute(sql).rows
            got = shaped(rows.collect()) if rows is not None else []
        except Exception:
            if want != "error":
                raise
            got = "error"
        assert got == want, sql


@pytest.fixture(scope="module")
def db(spark):
    out = Database(spark)
    out.execute("""CREATE TABLE p(id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT NOT NULL DEFAULT 'd', UNIQUE(v));
    CREATE TABLE c(a INT, b INT REFERENCES p(id) ON DELETE SET NULL, PRIMARY KEY(a, b), CHECK (a > 0)); CREATE INDEX ic ON c(a); CREATE VIEW w AS SELECT id FROM p;
    INSERT INTO p(v) VALUES ('x'), ('it''s'), ('z'); INSERT INTO c VALUES (1, 1), (2, 3)""")
    return out


def test_introspection(db):
    names = {r.name for r in db.query("SELECT name FROM sqlite_master").collect()}
    assert names == {"p", "c", "ic", "w"}
    info = {r.name: r for r in db.query("PRAGMA table_info(p)").collect()}
    assert info["id"].pk == 1 and info["v"].notnull == 1 and info["v"].dflt_value == "'d'"
    assert {r.name for r in db.query("PRAGMA index_list(c)").collect()} == {"ic"}
    assert db.query("PRAGMA foreign_key_list(c)").first().on_delete == "SET NULL"
    assert db.query("PRAGMA integrity_check").first()[0] == "ok" and db.query("PRAGMA foreign_key_check").count() == 0
    assert {r.table_name for r in db.query("SELECT table_name FROM information_schema.TABLES").collect()} == {"p", "c", "w"}
    assert db.query("SELECT COUNT(*) FROM information_schema.COLUMNS WHERE table_name = 'p'").first()[0] == 2
    assert {r[0] for r in db.query("SELECT constraint_type FROM information_schema.TABLE_CONSTRAINTS").collect()} == {"PRIMARY KEY", "UNIQUE", "FOREIGN KEY", "CHECK"}
    assert db.query("SELECT delete_rule FROM information_schema.REFERENTIAL_CONSTRAINTS").first()[0] == "SET NULL"
    db.execute("ANALYZE")
    assert db.query("SELECT stat FROM sqlite_stat1 WHERE tbl = 'p'").first()[0] == "3"
    db.execute("PRAGMA synchronous = 2")
    assert db.query("PRAGMA synchronous").first()[0] == "2"
    assert "upper" in {r.name for r in db.query("PRAGMA function_list").collect()}
    assert db.query("EXPLAIN SELECT * FROM p").count() > 0


def test_dump_rebuilds(db, spark):
    again = Database(spark)
    for line in introspect.dump(db):
        again.execute(line)
    for t in ("p", "c"):
        assert shaped(again.query(f"SELECT * FROM {t}").collect()) == shaped(db.query(f"SELECT * FROM {t}").collect())


def test_backup_and_files(db, spark, tmp_path):
    assert db.execute(f"BACKUP DATABASE TO '{tmp_path}/b'").rows.first().tables == 2
    df = db.query("SELECT id, v, NULL AS e FROM p").selectExpr("id", "v", "CAST(e AS STRING) AS e")
    files.export_csv(df, f"{tmp_path}/csv")
    back = files.import_csv(spark, f"{tmp_path}/csv")
    assert shaped(back.collect()) == [("1", "x", None), ("2", "it's", None), ("3", "z", None)]
    files.export_json(df, f"{tmp_path}/json")
    assert files.import_json(spark, f"{tmp_path}/json").count() == 3


def test_failed_statement_changes_nothing(db):
    before = shaped(db.query("SELECT * FROM p").collect())
    with pytest.raises(ConstraintError) as e:
        db.execute("INSERT INTO p(v) VALUES ('new'), ('x')")
    assert e.value.state == "23000" and shaped(db.query("SELECT * FROM p").collect()) == before


def test_select_into_and_vacuum(db):
    db.execute("SELECT id, v INTO copied FROM p WHERE id > 1; INSERT INTO copied VALUES (9, 'nine'); VACUUM")
    assert db.query("SELECT COUNT(*) FROM copied").first()[0] == 3 and len(db.table("copied").folders) == 1
    db.execute("DROP TABLE copied")


def test_partial_unique_index(spark):
    db = Database(spark)
    db.execute("CREATE TABLE t(a INT, b TEXT); INSERT INTO t VALUES (1, NULL), (1, NULL), (1, 'x')")
    db.execute("CREATE UNIQUE INDEX u ON t(a) WHERE b IS NOT NULL")
    db.execute("INSERT INTO t VALUES (1, NULL), (2, 'x')")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1, 'y')")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE t SET b = 'z' WHERE a = 1")
    db.execute("DROP INDEX u; INSERT INTO t VALUES (1, 'y')")
    with pytest.raises(ConstraintError):
        db.execute("CREATE UNIQUE INDEX u ON t(a) WHERE b IS NOT NULL")


def test_own_functions_and_row_arguments(spark):
    db = Database(spark)
    db.execute("CREATE TABLE t(a INT, d TEXT, f TEXT); INSERT INTO t VALUES (1, '2024-01-31', '%Y/%m'), (2, '2024-02-28', '%d%%'), (3, '2024-03-01', '%Q'), (NULL, '2024-03-01', NULL)")
    db.create_function("twice", lambda s: s * 2, "int", ["int"])
    db.create_aggregate("middle", lambda s: float(s.median()), "real", ["real"])
    rows = lambda sql: [tuple(r) for r in db.query(sql).collect()]
    assert rows("SELECT twice(a) FROM t WHERE a IS NOT NULL ORDER BY a") == [(2,), (4,), (6,)]
    assert rows("SELECT middle(a) FROM t WHERE a IS NOT NULL HAVING middle(a) > 0") == [(2.0,)]
    with pytest.raises(SqlError):
        db.query("SELECT twice(a, a) FROM t")
    assert rows("SELECT DATE(d, '+' || a || ' days'), STRFTIME(f, d) FROM t ORDER BY a NULLS LAST") == [("2024-02-01", "2024/01"), ("2024-03-01", "28%"), ("2024-03-04", None), (None, None)]
    assert rows("SELECT JSON_GROUP_ARRAY(DISTINCT a % 2) FROM t") == [("[null,0,1]",)]
    assert rows("SELECT JSON_GROUP_ARRAY(a) FILTER (WHERE a > 1) FROM t") == [("[2,3]",)]
    assert rows("SELECT GROUP_CONCAT(a, '-') OVER (ORDER BY d, a) FROM t WHERE a IS NOT NULL") == [("1",), ("1-2",), ("1-2-3",)]


def test_endless_recursion_is_an_error(spark):
    from basalt.operators.recursion import iterate

    with pytest.raises(RecursionError):
        iterate(spark.range(1), lambda d: d.selectExpr("id + 1 AS id"), distinct=True, most=3).count()


def test_virtual_tables_and_vacuum(spark):
    import os

    db = Database(spark)
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body); INSERT INTO f VALUES ('Quick fox', 'jumps over'), ('Lazy dog', 'sleeps, the quick way'), (NULL, 'foxes run')")
    found = lambda q: sorted(r[0] for r in db.query(f"SELECT body FROM f WHERE f MATCH '{q}'").collect())
    over, way, run = "jumps over", "sleeps, the quick way", "foxes run"
    want = {"quick": [over, way], "quick fox": [over], "fox*": [run, over], "dog OR run": [run, way], '"quick way"': [way], '"fox jumps"': [], "quick NOT fox": [way], "over AND quick": [over], "!": []}
    assert {q: found(q) for q in want} == {q: sorted(w) for q, w in want.items()}
    db.execute("CREATE VIRTUAL TABLE s USING series(1, 10, 3)")
    assert sorted(r[0] for r in db.query("SELECT value FROM s").collect()) == [1, 4, 7, 10]
    with pytest.raises(SqlError):
        db.execute("CREATE VIRTUAL TABLE z USING nothing(a)")
    before = set(db.store.written)
    db.execute("DELETE FROM f WHERE title IS NULL; VACUUM")
    gone = before - db.store.written
    assert gone and not any(os.path.exists(p.removeprefix("file://")) for p in gone)
    assert db.query("SELECT COUNT(*) FROM f").first()[0] == 2
    db.execute("BEGIN; DELETE FROM f; VACUUM; ROLLBACK")
    assert db.query("SELECT COUNT(*) FROM f").first()[0] == 2


def test_printf_formats_of_rows(spark):
    """A format in a column gives what the same literal gives."""
    db = Database(spark)
    forms = ["%d|%s", "%05d", "%-6d|", "%+d", "%.2f", "%8.3f|", "%x", "%5s|%-5s|", "%%%d", "%q", "%,d", "%s %s %s", "plain", "%e"]
    db.execute("CREATE TABLE t(f TEXT, a INT, b TEXT)")
    for f in forms:
        db.execute("INSERT INTO t VALUES (?, 1234, 'it''s')", [f])
    db.execute("INSERT INTO t VALUES (NULL, 1, 'x')")
    got = {r[0]: r[1] for r in db.query("SELECT f, PRINTF(f, a, b) FROM t").collect()}
    for f in forms:
        assert got[f] == db.query(f"SELECT PRINTF('{f}', a, b) FROM t LIMIT 1").first()[0], f
    assert got[None] is None
