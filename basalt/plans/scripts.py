"""Reference scripts of the statements that change tables: (name, script, final query, DuckDB SQL of its result)."""

from __future__ import annotations

_NATIONS = "CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT UNIQUE, r INT); INSERT INTO t SELECT n_nationkey + 1, n_name, n_regionkey FROM nation"
_BASE = "SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey AS r FROM nation"
_ALL = "SELECT id, name, r FROM t"


def _typed(sql: str) -> str:
    return f"SELECT id::BIGINT AS id, name, r::BIGINT AS r FROM ({sql}) x"


SCRIPTS: list[tuple[str, str, str, str]] = [
    ("l01_create_defaults", "CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT NOT NULL DEFAULT 'd', q REAL DEFAULT 2.5, CHECK (q > 0)); INSERT INTO t DEFAULT VALUES; INSERT INTO t(v) VALUES ('x'), ('y')", "SELECT id, v, q FROM t", "SELECT id::BIGINT AS id, v, 2.5::DOUBLE AS q FROM (VALUES (1, 'd'), (2, 'x'), (3, 'y')) x(id, v)"),
    ("l04_alter", f"{_NATIONS}; ALTER TABLE t ADD COLUMN e INT DEFAULT 5; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t DROP COLUMN r; ALTER TABLE t RENAME TO t2", "SELECT id, label, e FROM t2", "SELECT (n_nationkey + 1)::BIGINT AS id, n_name AS label, 5::BIGINT AS e FROM nation"),
    ("l06_view", f"{_NATIONS}; CREATE VIEW w AS SELECT r, COUNT(*) AS n FROM t GROUP BY r; DELETE FROM t WHERE r = 0", "SELECT r, n FROM w", "SELECT n_regionkey::BIGINT AS r, COUNT(*) AS n FROM nation WHERE n_regionkey <> 0 GROUP BY n_regionkey"),
    ("l07_insert_values", "CREATE TABLE t(id INT, name TEXT, r INT); INSERT INTO t(name, id) VALUES ('a', '7'), ('b', 8.0); INSERT INTO t VALUES (9, 5, NULL)", _ALL, _typed("SELECT * FROM (VALUES (7, 'a', NULL), (8, 'b', NULL), (9, '5', NULL)) x(id, name, r)")),
    ("l08_insert_select", _NATIONS, _ALL, _typed(_BASE)),
    ("l09_replace", f"{_NATIONS}; INSERT OR REPLACE INTO t SELECT n_nationkey + 1, n_name || '*', 77 FROM nation WHERE n_regionkey = 2; REPLACE INTO t VALUES (500, 'FRANCE', 0)", _ALL, _typed(f"SELECT id, CASE WHEN r = 2 THEN name || '*' ELSE name END AS name, CASE WHEN r = 2 THEN 77 ELSE r END AS r FROM ({_BASE}) b WHERE name <> 'FRANCE' UNION ALL SELECT 500, 'FRANCE', 0")),
    ("l10_ignore", f"{_NATIONS}; INSERT OR IGNORE INTO t SELECT n_nationkey + 20, 'new' || n_name, 9 FROM nation; INSERT INTO t VALUES (1, 'zz', 1) ON CONFLICT DO NOTHING", _ALL, _typed(f"{_BASE} UNION ALL SELECT n_nationkey + 20, 'new' || n_name, 9 FROM nation WHERE n_nationkey + 20 > 25")),
    ("l11_upsert", f"{_NATIONS}; INSERT INTO t SELECT n_nationkey + 11, 'u' || n_name, 100 FROM nation WHERE 1 ON CONFLICT(id) DO UPDATE SET name = t.name || '/' || excluded.name, r = excluded.r + t.r WHERE t.r <> 1", _ALL, _typed("SELECT n.n_nationkey + 1 AS id, CASE WHEN e.n_name IS NOT NULL AND n.n_regionkey <> 1 THEN n.n_name || '/u' || e.n_name ELSE n.n_name END AS name, CASE WHEN e.n_name IS NOT NULL AND n.n_regionkey <> 1 THEN 100 + n.n_regionkey ELSE n.n_regionkey END AS r FROM nation n LEFT JOIN nation e ON e.n_nationkey + 11 = n.n_nationkey + 1 UNION ALL SELECT n_nationkey + 11, 'u' || n_name, 100 FROM nation WHERE n_nationkey + 11 > 25")),
    ("l12_update", f"{_NATIONS}; UPDATE t SET r = id, name = name || r WHERE r % 2 = 1", _ALL, _typed(f"SELECT id, CASE WHEN r % 2 = 1 THEN name || r ELSE name END AS name, CASE WHEN r % 2 = 1 THEN id ELSE r END AS r FROM ({_BASE}) b")),
    ("l13_delete", f"{_NATIONS}; DELETE FROM t WHERE r IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'a%') OR NULLIF(id, 3) > 20", _ALL, _typed(f"SELECT * FROM ({_BASE}) b WHERE r NOT IN (SELECT r_regionkey FROM region WHERE r_name ILIKE 'a%') AND id <= 20")),
    ("l14_cascade", "CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(k INT, p INT REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO p SELECT r_regionkey + 1 FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey + 1 FROM nation; DELETE FROM p WHERE id = 2; UPDATE p SET id = 40 WHERE id = 4", "SELECT k, p FROM c", "SELECT n_nationkey::BIGINT AS k, (CASE WHEN n_regionkey = 3 THEN 40 ELSE n_regionkey + 1 END)::BIGINT AS p FROM nation WHERE n_regionkey <> 1"),
    ("l14_set_null", "CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(k INT, p INT REFERENCES p(id) ON DELETE SET NULL); INSERT INTO p SELECT r_regionkey + 1 FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey + 1 FROM nation; DELETE FROM p WHERE id = 2", "SELECT k, p FROM c", "SELECT n_nationkey::BIGINT AS k, NULLIF(n_regionkey + 1, 2)::BIGINT AS p FROM nation"),
    ("l15_trigger", "CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE log(m TEXT); CREATE TRIGGER a AFTER INSERT ON t WHEN NEW.id > 1 BEGIN INSERT INTO log VALUES ('i' || NEW.v); END; CREATE TRIGGER b AFTER DELETE ON t BEGIN INSERT INTO log VALUES ('d' || OLD.v); END; INSERT INTO t VALUES (1, 'a'), (2, 'b'); DELETE FROM t WHERE id = 1", "SELECT m FROM log", "SELECT m FROM (VALUES ('ib'), ('da')) x(m)"),
    ("l16_savepoint", f"{_NATIONS}; BEGIN; DELETE FROM t WHERE r = 0; SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; RELEASE s; COMMIT; BEGIN; DELETE FROM t; ROLLBACK", _ALL, _typed(f"SELECT * FROM ({_BASE}) b WHERE r <> 0")),
    ("l17_table_info", _NATIONS, "PRAGMA table_info(t)", "SELECT * FROM (VALUES (0::BIGINT, 'id', 'INTEGER', 0::BIGINT, NULL::VARCHAR, 1::BIGINT), (1, 'name', 'TEXT', 0, NULL, 0), (2, 'r', 'INT', 0, NULL, 0)) x(cid, name, type, \"notnull\", dflt_value, pk)"),
    ("j14_update_from", f"{_NATIONS}; UPDATE t SET name = g.r_name FROM region g WHERE g.r_regionkey = t.r AND t.id < 6; UPDATE t SET r = r + 1 WHERE id = 1", "SELECT id, r FROM t", "SELECT (n_nationkey + 1)::BIGINT AS id, (n_regionkey + CASE WHEN n_nationkey = 0 THEN 1 ELSE 0 END)::BIGINT AS r FROM nation"),
    ("j15_delete_using", f"{_NATIONS}; DELETE FROM t USING region g WHERE g.r_regionkey = t.r AND g.r_name = 'ASIA'", _ALL, _typed(f"SELECT b.* FROM ({_BASE}) b JOIN region ON r_regionkey = r WHERE r_name <> 'ASIA'")),
    ("s10_master", f"{_NATIONS}; CREATE INDEX ix ON t(r); CREATE VIEW w AS SELECT 1 AS one", "SELECT type, name, tbl_name FROM sqlite_master", "SELECT * FROM (VALUES ('table', 't', 't'), ('index', 'ix', 't'), ('view', 'w', 'w')) x(type, name, tbl_name)"),
    ("s11_information_schema", _NATIONS, "SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = 't'", "SELECT * FROM (VALUES ('id', 'INTEGER', 'NO'), ('name', 'TEXT', 'YES'), ('r', 'INT', 'YES')) x(column_name, data_type, is_nullable)"),
    ("s12_stat1", f"{_NATIONS}; ANALYZE", "SELECT tbl, stat FROM sqlite_stat1", "SELECT 't' AS tbl, COUNT(*)::VARCHAR AS stat FROM nation"),
    ("s25_select_into", "SELECT n_nationkey AS k, n_name AS v INTO made FROM nation WHERE n_regionkey = 1", "SELECT k, v FROM made", "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation WHERE n_regionkey = 1"),
    ("s26_ctas", "CREATE TABLE made AS SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey", "SELECT c, n FROM made", "SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey"),
    ("s27_returning", _NATIONS, "DELETE FROM t WHERE r = 3 RETURNING id, name || '!' AS loud", "SELECT (n_nationkey + 1)::BIGINT AS id, n_name || '!' AS loud FROM nation WHERE n_regionkey = 3"),
]
