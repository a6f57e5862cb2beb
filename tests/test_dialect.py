"""The dialect against Python's sqlite3: the same text on both, rows compared as sets."""

import sqlite3

import pytest

from basalt.plans.parser import SqlError, parse_query, split_statements
from basalt.session import Engine

SETUP = """CREATE TABLE t(id INTEGER, name TEXT, val REAL, grp TEXT, n INTEGER);
INSERT INTO t VALUES (1,'alice',10.5,'a',5),(2,'Bob',NULL,'b',0),(3,'carol',-3.25,'a',NULL),(4,NULL,7.0,'b',-7),(5,'Dave%',0.0,NULL,12);
CREATE TABLE u(id INTEGER, tag TEXT); INSERT INTO u VALUES (1,'x'),(1,'y'),(3,'z'),(9,'w'),(NULL,'q');"""

QUERIES = [
    'select id, n/2, n%3, val/2, 7/2, 7.0/2, 1/0, n*val from t',
    'select * from t where n',
    "select id from t where name like 'a%' or name like '%\\%' escape '\\'",
    "select id from t where name glob '[a-c]*'",
    'select a.id, b.tag from t a left join u b on a.id=b.id',
    'select id as k, count(*) from u group by k having count(*)>0',
    "select grp, sum(n), avg(val), total(n), group_concat(name,'|') from t where name is not null group by grp",
    'select grp, name, max(id) from t where id in (1,2) group by grp',
    'select id, row_number() over (order by id desc) rn, sum(id) over (partition by grp order by id) s from t',
    'select id from t order by n desc limit 2 offset 1',
    'select id from t order by id limit 1, 2',
    "select upper(name)||'!', length(name), substr('hello',0,3), substr('hello',3,-2), substr('hello',-3), substr('hello',-9), substr('hello',2,100), substr('abc',-5,3) from t where id=1",
    "select case when n then 'y' else 'n' end, case grp when 'a' then 1 else 2.5 end, iif(n>3,'big','small') from t",
    'select exists(select 1 from u where u.id=t.id), (select tag from u where u.id=t.id order by tag) from t',
    'select id from t where id not in (select id from u where id is not null)',
    'select id from t where id not in (select id from u)',
    'select t.id+1 as z from t where z>3',
    "values (1,'a'),(2,'b')",
    'with recursive r(n) as (select 1 union all select n+1 from r where n<10) select sum(n) from r',
    'with recursive r(n) as (select 1 union select (n+1)%5 from r) select n from r',
    'select id from t union select id from u except select 9',
    'select 1 union all select 2 intersect select 2',
    "select printf('%05d|%-5s|%.2f|%x|%%|%e|%g', 42, 'ab', 3.14159, 255, 12345.678, 0.0001), printf('%s %s', NULL, 1.5)",
    "select date('2024-01-31','+1 month'), datetime('2024-01-15 10:30:00','-1 day','+2 hours'), time('10:20:30'), strftime('%Y/%m/%d %H:%M:%S %j %w %s %W','2024-03-05 01:02:03'), julianday('2024-01-01'), unixepoch('2024-01-01'), date('2024-03-15','start of month','-1 day'), date('2024-03-15','weekday 0')",
    "select cast('12abc' as integer), cast(3.9 as integer), cast('3.5x' as real), cast(5 as text), cast('abc' as integer), typeof(1), typeof(1.5), typeof('x'), typeof(null), typeof(x'00')",
    "select max(1,null), max(3,2), min('a','b'), coalesce(null,2), ifnull(null,'x'), nullif(1,1), abs(-3), abs(-2.5), round(2.567,2), round(-2.5), sign(-3), hex('abc'), hex(255), quote('it''s'), quote(1.5), quote(null), unicode('a'), char(72,105), instr('hello','l'), replace('aaa','a','bb'), trim('  x '), ltrim('xxa','x'), rtrim('axx','x')",
    "select 5 & 3, 5 | 3, 1 << 4, 256 >> 2, ~5, -7/2, -7%3, 1+'2abc', '3'*2",
    "select 1 is null, null is null, 1 is 1, 1 is not 2, null = null, 1 between 0 and 2, 2 in (1,2), 'a' in (), not 1, true, false, 3 > 2",
    'select distinct grp from t order by grp',
    'select count(distinct id), sum(distinct id), count(tag) filter (where id=1) from u',
    'select \'{"a":[1,"x"]}\' -> \'$.a\', \'{"a":"q"}\' ->> \'a\', \'{"a":"q"}\' -> \'a\'',
    "select name from t where name = 'BOB' collate nocase",
    'select name from t order by name collate nocase desc',
    'select id, lag(id) over (order by id), lead(n,1,-1) over (order by id), first_value(name) over (partition by grp order by id), last_value(id) over (order by id rows between 1 preceding and 1 following), nth_value(id,2) over (order by id), ntile(2) over (order by id), percent_rank() over (order by id), cume_dist() over (order by id) from t',
    'select sum(id) over w from t window w as (order by id rows unbounded preceding)',
    'select * from t natural join u',
    'select t.*, tag from t join u using (id)',
    "select id from t where (id, grp) = (1,'a')",
    'select x from (select id as x from t) where x > 2 order by x',
    'select grp, json_group_array(id) from t group by grp',
    "select id, id = '1', name > 5, n = '5' from t",
    'select count(*) from t, u',
    'select t.id from t left join u on t.id = u.id where u.id is null',
    'select grp g, count(*) c from t group by 1 order by c desc, g',
    'select sum(a)+sum(b) from (select 1 a, 2 b union all select 3, 4)',
    "select a.id from t a where a.val > (select avg(b.val) from t b where coalesce(b.grp,'') = coalesce(a.grp,''))",
    'select group_concat(distinct grp) from t',
    "select length(x'0102'), x'41' = x'41', 'a'||1||2.5, 9223372036854775807",
    'select "id" from t where [grp] = \'a\' and `n` is null -- comment',
]


@pytest.fixture(scope="module")
def both(spark):
    lite = sqlite3.connect(":memory:")
    lite.executescript(SETUP)
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame(lite.execute("SELECT * FROM t").fetchall(), "id long, name string, val double, grp string, n long"))
    engine.register("u", spark.createDataFrame(lite.execute("SELECT * FROM u").fetchall(), "id long, tag string"))
    return engine, lite


def shaped(rows):
    plain = lambda v: round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("sql", QUERIES)
def test_equals_sqlite(both, sql):
    engine, lite = both
    assert shaped(engine.query(sql).collect()) == shaped(lite.execute(sql).fetchall())


@pytest.mark.parametrize("sql", ["SELECT id FROM t ORDER BY n DESC, id LIMIT 3", "SELECT name FROM t ORDER BY name COLLATE NOCASE DESC", "SELECT grp, COUNT(*) c FROM t GROUP BY 1 ORDER BY c DESC, grp"])
def test_order(both, sql):
    engine, lite = both
    assert [tuple(r) for r in engine.query(sql).collect()] == lite.execute(sql).fetchall()


def test_parameters(both):
    engine, _ = both
    assert [r[0] for r in engine.query("SELECT id FROM t WHERE id > ? AND name <> ? ORDER BY id", [1, "carol"]).collect()] == [2, 5]
    assert engine.query("SELECT :a + @b", {"a": 1, "b": 2.5}).first()[0] == 3.5
    assert engine.query("SELECT ?2 || ?1", ["x'y", None]).first()[0] is None


def test_quantified_and_rewrites(both):
    engine, _ = both
    one = lambda q: sorted(r[0] for r in engine.query(q).collect())
    assert one("SELECT id FROM t WHERE id > ALL (SELECT id FROM u WHERE id < 4)") == [4, 5]
    assert one("SELECT id FROM t WHERE id = ANY (SELECT id FROM u)") == [1, 3]
    assert one("SELECT id FROM t WHERE id <> ALL (SELECT id FROM u WHERE id IS NOT NULL)") == [2, 4, 5]
    assert one("SELECT id FROM t WHERE id < ANY (SELECT id FROM u WHERE 0)") == []
    assert one("SELECT id FROM t WHERE id < ALL (SELECT id FROM u WHERE 0)") == [1, 2, 3, 4, 5]
    assert one("SELECT id FROM t ORDER BY id FETCH FIRST 2 ROWS ONLY") == [1, 2]
    assert one("SELECT value FROM series(5, 1, -2)") == [1, 3, 5] and one("SELECT value FROM series(1, 5, -1)") == []
    assert one("SELECT 1 UNION ALL SELECT 2 INTERSECT SELECT 2") == [2]
    assert one("SELECT id FROM t WHERE name MATCH 'ALI'") == [1]


def test_json_functions(both):
    engine, _ = both
    q = """SELECT JSON_EXTRACT('{"a":{"b":[1,2.50,"x"]}}', '$.a.b[1]'), JSON_EXTRACT('[1,2,3]', '$[#-1]'), JSON_TYPE('{"a":1.5}', '$.a'), JSON_SET('{"a":1}', '$.b', 'q'), JSON_REMOVE('[1,2,3]', '$[1]'),
    JSON_PATCH('{"a":{"b":1,"c":2}}', '{"a":{"b":null}}'), JSON_ARRAY_INSERT('[1,3]', '$[1]', 2), JSON_VALID('{bad'), JSON_EXTRACT(NULL, '$'), JSON_KEYS('{"x":1}')"""
    assert tuple(engine.query(q).first()) == ("2.5", "3", "real", '{"a":1,"b":"q"}', "[1,3]", '{"a":{"c":2}}', "[1,2,3]", 0, None, '["x"]')
    rows = engine.query("SELECT key, value, type, fullkey, path FROM json_tree('{\"a\":1,\"b\":[2,{\"c\":null}]}')").collect()
    assert [r.fullkey for r in rows] == ["$", "$.a", "$.b", "$.b[0]", "$.b[1]", "$.b[1].c"] and rows[-1].type == "null"
    assert [tuple(r) for r in engine.query("SELECT t.id, j.value FROM t JOIN json_each('[1,2]') j ON j.value = t.id ORDER BY 1").collect()] == [(1, "1"), (2, "2")]


@pytest.mark.parametrize("sql,state", [("SELEC 1", "42601"), ("SELECT nope FROM t", "42703"), ("SELECT * FROM missing", "42P01"), ("SELECT nofunc(1)", "42883"), ("SELECT 1 UNION SELECT 1, 2", "42601"), ("SELECT ?", "07001"), ("SELECT row_number()", "42P20")])
def test_errors(both, sql, state):
    with pytest.raises(SqlError) as e:
        both[0].query(sql)
    assert e.value.state == state


def test_split_statements():
    script = "SELECT ';'; -- no;\nCREATE TRIGGER a AFTER INSERT ON t BEGIN SELECT CASE WHEN 1 THEN 2 END; SELECT 3; END; SELECT 4"
    assert len(split_statements(script)) == 3
    assert parse_query("SELECT /* c */ 1").body.items[0].e.value == 1
