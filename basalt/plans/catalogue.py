"""The reference queries of every query operator: (name, dialect SQL, DuckDB SQL if it differs).

Sums of products are cast to DECIMAL, so the order of partitions cannot change them. Dialect SQL
runs through the engine; DuckDB SQL is the oracle's spelling of the same result.
"""

from __future__ import annotations

L, O, C, N, E, D = "lineitem", "orders", "customer", "nation", "events", "documents"


def _money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


FLAGSHIP = """SELECT c.c_custkey AS c_custkey, c.c_mktsegment AS c_mktsegment, COUNT(*) AS n_lines, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY c.c_custkey, c.c_mktsegment HAVING COUNT(*) > 5 ORDER BY revenue DESC, c_custkey LIMIT 10"""

#: Same text for both engines, unless a second one follows.
QUERIES: list[tuple[str, str] | tuple[str, str, str]] = [
    ("flagship", FLAGSHIP),
    # scans and sources
    ("s01_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    ("s02_no_from", "SELECT 1 AS a, 'x' AS b, 2.5 AS c", "SELECT 1::BIGINT AS a, 'x' AS b, 2.5::DOUBLE AS c"),
    ("s03_values", "VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT col0::BIGINT AS column1, col1 AS column2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v"),
    ("s04_values_derived", "SELECT a, b FROM (VALUES (1, 'p'), (2, 'q')) AS t(a, b) WHERE a > 1", "SELECT a::BIGINT AS a, b FROM (VALUES (1, 'p'), (2, 'q')) AS t(a, b) WHERE a > 1"),
    ("s05_derived", "SELECT s.seg AS seg, s.n AS n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) s WHERE s.n > 0"),
    ("s07_cte", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n >= 5) SELECT c.c_name AS c_name, t.n AS n FROM top t JOIN customer c ON c.c_custkey = t.o_custkey"),
    ("s08_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 40) SELECT n, f FROM r", "WITH RECURSIVE r(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 40) SELECT n, f FROM r"),
    ("s08_recursive_union", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 7 + 3) % 12 FROM r) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION SELECT (n * 7 + 3) % 12 FROM r) SELECT n FROM r"),
    ("s09_json_each", "SELECT e.event_id AS event_id, j.key AS k, j.value AS v FROM events e JOIN json_each(e.props) j", "SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events"),
    ("s09_json_tree", "SELECT key, value, type, fullkey FROM json_tree('{\"a\":[1,{\"b\":null}],\"c\":\"x\"}') WHERE atom IS NOT NULL OR type = 'null'", "SELECT * FROM (VALUES ('0', '1', 'integer', '$.a[0]'), ('b', NULL, 'null', '$.a[1].b'), ('c', 'x', 'text', '$.c')) v(key, value, type, fullkey)"),
    ("s14_series", "SELECT value FROM series(10, 1, -3)", "SELECT UNNEST(generate_series(10, 1, -3))::BIGINT AS value"),
    # projection
    ("p01_columns", "SELECT l.l_orderkey AS k, \"l_quantity\" AS q, [l_tax] AS t FROM lineitem l", "SELECT l_orderkey AS k, l_quantity AS q, l_tax AS t FROM lineitem"),
    ("p02_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
    ("p03_alias", "SELECT c_acctbal * 2 AS twice, c_name label FROM customer", "SELECT c_acctbal * 2 AS twice, c_name AS label FROM customer"),
    ("p04_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    ("p05_all", "SELECT ALL r_name FROM region"),
    ("p06_alias_in_where", "SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders WHERE k > 200"),
    # predicates
    ("f01_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02"),
    ("f02_compare", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_custkey != 7 AND NOT o_custkey == 9", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_custkey <> 7 AND NOT o_custkey = 9"),
    ("f03_three_valued", "SELECT c_custkey, (NULLIF(c_nationkey, 3) > 5) OR c_acctbal > 0 AS t FROM customer", "SELECT c_custkey, ((NULLIF(c_nationkey, 3) > 5) OR c_acctbal > 0)::BIGINT AS t FROM customer"),
    ("f04_is_null", "SELECT COUNT(*) AS n FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULL"),
    ("f05_isnull_call", "SELECT SUM(ISNULL(NULLIF(n_regionkey, 1))) AS a, SUM(NOTNULL(NULLIF(n_regionkey, 1))) AS b FROM nation", "SELECT COUNT(*) FILTER (WHERE n_regionkey = 1) AS a, COUNT(*) FILTER (WHERE n_regionkey <> 1) AS b FROM nation"),
    ("f06_is", "SELECT COUNT(*) AS n FROM customer WHERE NULLIF(c_nationkey, 3) IS NULL OR c_nationkey IS 4 OR c_nationkey IS NOT 5", "SELECT COUNT(*) AS n FROM customer WHERE c_nationkey = 3 OR c_nationkey IS NOT DISTINCT FROM 4 OR c_nationkey IS DISTINCT FROM 5"),
    ("f07_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1500"),
    ("f08_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4) AND n_nationkey NOT IN ()", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)"),
    ("f09_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%A%' AND p_type NOT LIKE '_x%' OR p_brand LIKE 'brand#1\\_%' ESCAPE '\\'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE '_x%' OR p_brand ILIKE 'brand#1\\_%' ESCAPE '\\'"),
    ("f10_glob", "SELECT c_custkey FROM customer WHERE c_name GLOB 'Customer*[05]' OR c_mktsegment GLOB 'B?ILD*'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer.*[05]') OR regexp_full_match(c_mktsegment, 'B.ILD.*')"),
    ("f11_match", "SELECT c_custkey FROM customer WHERE c_mktsegment MATCH 'Mach'", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'mach')"),
    ("f12_nocase", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE", "SELECT COUNT(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'"),
    ("f13_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    ("f13_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)"),
    ("f14_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    ("f14_not_in_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region WHERE r_regionkey < 4)"),
    ("f15_any", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 1) AND p_size = SOME (SELECT n_nationkey FROM nation)", "SELECT p_partkey FROM part WHERE p_retailprice < (SELECT MAX(p_retailprice) FROM part WHERE p_size = 1) AND p_size IN (SELECT n_nationkey FROM nation)"),
    ("f15_all", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey < 5) AND c_custkey > ALL (SELECT r_regionkey FROM region WHERE 0)", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT MAX(c_acctbal) FROM customer WHERE c_nationkey < 5)"),
    ("f16_integer_truth", "SELECT n_name FROM nation WHERE n_regionkey AND NOT n_nationkey % 2", "SELECT n_name FROM nation WHERE n_regionkey <> 0 AND n_nationkey % 2 = 0"),
    # joins
    ("j01_inner", "SELECT o.o_orderkey AS k, c.c_name AS c FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000"),
    ("j02_left", "SELECT c.c_custkey AS c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000 GROUP BY c.c_custkey"),
    ("j03_right", "SELECT r.r_name AS r_name, n.n_name AS n_name FROM (SELECT * FROM nation WHERE n_regionkey > 2) n RIGHT JOIN region r ON r.r_regionkey = n.n_regionkey"),
    ("j04_full", "SELECT a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey"),
    ("j05_cross", "SELECT r.r_name AS r, n.n_name AS n FROM region r, nation n"),
    ("j06_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_name AS b FROM customer)", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_name AS b FROM customer) y"),
    ("j07_using", "SELECT k, n, s FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) a LEFT JOIN (SELECT s_nationkey AS k, s_name AS s FROM supplier) b USING (k)"),
    ("j08_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    ("j09_n_way", "SELECT r.r_name AS r, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name"),
    ("j10_range", "SELECT n.n_name AS n, COUNT(*) AS k FROM nation n JOIN part p ON p.p_size BETWEEN n.n_nationkey AND n.n_nationkey + 3 GROUP BY n.n_name"),
    ("j11_semi_anti", "SELECT COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    # aggregation
    ("a01_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS s, ROUND(AVG(l_quantity), 6) AS q FROM lineitem GROUP BY ALL"),
    ("a01_group_alias", "SELECT substr(o_orderpriority, 1, 1) AS p, COUNT(*) AS n FROM orders GROUP BY p"),
    ("a02_bare_column", "SELECT n_regionkey, r_name, COUNT(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, ANY_VALUE(r_name) AS r_name, COUNT(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey"),
    ("a03_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000"),
    ("a04_scalar", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, SUM(o_custkey)::BIGINT AS s, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0"),
    ("a05_count_star", "SELECT COUNT(*) AS n FROM lineitem"),
    ("a06_count", "SELECT COUNT(NULLIF(l_returnflag, 'N')) AS n FROM lineitem"),
    ("a07_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"),
    ("a08_sum", "SELECT SUM(l_orderkey) AS i, ROUND(SUM(l_quantity), 2) AS r, SUM(NULLIF(l_linenumber, l_linenumber)) AS z FROM lineitem", "SELECT SUM(l_orderkey)::BIGINT AS i, ROUND(SUM(l_quantity), 2) AS r, NULL::BIGINT AS z FROM lineitem"),
    ("a09_avg", "SELECT c_mktsegment, ROUND(AVG(c_custkey), 8) AS a FROM customer GROUP BY c_mktsegment"),
    ("a10_min_max", "SELECT o_orderstatus, MIN(o_orderpriority) AS a, MAX(o_totalprice) AS b FROM orders GROUP BY o_orderstatus"),
    ("a11_distinct_sum", "SELECT SUM(DISTINCT l_linenumber) AS s, ROUND(AVG(DISTINCT l_linenumber), 6) AS a, MAX(DISTINCT l_linenumber) AS m FROM lineitem", "SELECT SUM(DISTINCT l_linenumber)::BIGINT AS s, ROUND(AVG(DISTINCT l_linenumber), 6) AS a, MAX(DISTINCT l_linenumber) AS m FROM lineitem"),
    ("a12_all", "SELECT SUM(ALL l_linenumber) AS s, COUNT(ALL l_linenumber) AS n FROM lineitem", "SELECT SUM(l_linenumber)::BIGINT AS s, COUNT(l_linenumber) AS n FROM lineitem"),
    ("a13_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, ';' ORDER BY n_name) AS g, GROUP_CONCAT(DISTINCT n_regionkey) AS d FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS g, n_regionkey::VARCHAR AS d FROM nation GROUP BY n_regionkey"),
    ("a14_json_array", "SELECT n_regionkey, JSON_GROUP_ARRAY(n_name ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || STRING_AGG('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey"),
    ("a15_json_object", "SELECT n_regionkey, JSON_GROUP_OBJECT(n_name, n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || STRING_AGG('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey"),
    ("a16_compound", "SELECT l_returnflag, SUM(l_linenumber) + SUM(l_suppkey) * 2 AS s, MAX(l_quantity) - MIN(l_quantity) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, (SUM(l_linenumber) + SUM(l_suppkey) * 2)::BIGINT AS s, MAX(l_quantity) - MIN(l_quantity) AS d FROM lineitem GROUP BY l_returnflag"),
    ("a17_wrapped", "SELECT UPPER(MIN(c_name)) AS u, LENGTH(MAX(c_name)) AS n, ROUND(ABS(AVG(c_acctbal)), 4) AS a, CAST(SUM(c_custkey) AS TEXT) AS t FROM customer", "SELECT UPPER(MIN(c_name)) AS u, LENGTH(MAX(c_name)) AS n, ROUND(ABS(AVG(c_acctbal)), 4) AS a, SUM(c_custkey)::VARCHAR AS t FROM customer"),
    ("a18_total", "SELECT TOTAL(l_linenumber) AS t, TOTAL(NULLIF(l_linenumber, l_linenumber)) AS z FROM lineitem", "SELECT SUM(l_linenumber)::DOUBLE AS t, 0.0::DOUBLE AS z FROM lineitem"),
    ("a19_mode_any", "SELECT n_regionkey, MODE(n_regionkey) AS m, ANY_VALUE(n_regionkey) AS a FROM nation GROUP BY n_regionkey"),
    ("a20_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_linestatus)::BIGINT AS g FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"),
    ("a20_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)"),
    ("a20_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    ("a24_filter", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS n, SUM(l_linenumber) FILTER (WHERE l_tax > 0.04) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS n, (SUM(l_linenumber) FILTER (WHERE l_tax > 0.04))::BIGINT AS s FROM lineitem GROUP BY l_returnflag"),
    # windows
    ("w01_partition", "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"),
    ("w02_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"),
    ("w03_rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    ("w04_dense_rank", "SELECT p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    ("w05_ntile", "SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer"),
    ("w06_lag_lead", "SELECT o_orderkey, LAG(o_orderkey, 2, -1) OVER w AS a, LEAD(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    ("w07_first_value", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS f FROM orders"),
    ("w08_last_value", "SELECT p_partkey, LAST_VALUE(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS l FROM part"),
    ("w09_running", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders", "SELECT o_orderkey, (SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS s, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders"),
    ("w10_rows_frame", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders", "SELECT o_orderkey, (SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS s FROM orders"),
    ("w10_range_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM part"),
    ("w11_percent_rank", "SELECT c_custkey, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 9) AS c FROM customer"),
    ("w12_nth_value", "SELECT c_custkey, NTH_VALUE(c_custkey, 3) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer"),
    # order and limit
    ("o01_order_expr", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey"),
    ("o02_nulls", "SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k DESC NULLS FIRST, n_name"),
    ("o02_null_smallest", "SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k, n_name", "SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k NULLS FIRST, n_name"),
    ("o03_order_nocase", "SELECT n_name FROM nation ORDER BY n_name COLLATE NOCASE DESC", "SELECT n_name FROM nation ORDER BY lower(n_name) DESC"),
    ("o04_order_group", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey"),
    ("o05_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    ("o05_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    ("o06_fetch", "SELECT o_orderkey FROM orders ORDER BY 1 DESC FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 5"),
    ("o07_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100"),
    # arguments of each row, distinct and ordered lists
    ("d08_row_modifier", "SELECT o_orderkey, DATE(o_orderdate, '+' || (o_orderkey % 40) || ' days') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate::DATE + (o_orderkey % 40)::INT, '%Y-%m-%d') AS d FROM orders"),
    ("d07_row_format", "SELECT o_orderkey, STRFTIME(CASE WHEN o_orderkey % 2 = 0 THEN '%Y' ELSE '%d.%m%%' END, o_orderdate) AS d FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d.%m%%') END AS d FROM orders"),
    ("t13_row_format", "SELECT o_orderkey, PRINTF(CASE WHEN o_orderkey % 2 = 0 THEN '%06d' ELSE '<%s>' END, o_orderkey) AS p FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(o_orderkey::VARCHAR, 6, '0') ELSE '<' || o_orderkey || '>' END AS p FROM orders"),
    ("a14_json_distinct", "SELECT o_custkey, JSON_GROUP_ARRAY(DISTINCT o_orderstatus) AS j FROM orders GROUP BY o_custkey", "SELECT o_custkey, '[' || string_agg(s, ',' ORDER BY s) || ']' AS j FROM (SELECT DISTINCT o_custkey, '\"' || o_orderstatus || '\"' AS s FROM orders) GROUP BY o_custkey"),
    ("a13_concat_over", "SELECT o_orderkey, GROUP_CONCAT(o_orderstatus, '-') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders", "SELECT o_orderkey, string_agg(o_orderstatus, '-') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders"),
    ("j06b_natural_later", "SELECT a.n_name AS n, b.r_name AS r, c.k AS k FROM nation a JOIN region b ON b.r_regionkey = a.n_regionkey NATURAL JOIN (SELECT n_name, n_nationkey * 2 AS k FROM nation) c", "SELECT a.n_name AS n, b.r_name AS r, a.n_nationkey * 2 AS k FROM nation a JOIN region b ON b.r_regionkey = a.n_regionkey"),
    ("a19_mode", "SELECT c_nationkey, MODE(c_mktsegment) AS m FROM (SELECT c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_nationkey, 'TOP' FROM customer) x GROUP BY c_nationkey", "SELECT DISTINCT c_nationkey, 'TOP' AS m FROM customer"),
    ("a24_stddev", "SELECT c_nationkey, ROUND(STDDEV(c_acctbal), 4) AS s FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1", "SELECT c_nationkey, ROUND(STDDEV(c_acctbal), 4) AS s FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1"),
    ("m09_random", "SELECT n_nationkey, TYPEOF(RANDOM()) AS t FROM nation", "SELECT n_nationkey, 'integer' AS t FROM nation"),
    ("m20_likely", "SELECT n_nationkey, LIKELY(n_nationkey) AS a, UNLIKELY(n_name) AS b FROM nation", "SELECT n_nationkey, n_nationkey AS a, n_name AS b FROM nation"),
    ("d01_current", "SELECT CURRENT_DATE = DATE('now') AS a, LENGTH(CURRENT_TIMESTAMP) AS b, LENGTH(CURRENT_TIME) AS c", "SELECT 1::BIGINT AS a, 19::BIGINT AS b, 8::BIGINT AS c"),
    ("l24_comments", "SELECT r_name /* the name, -- all of it */ FROM region -- to the end\n WHERE r_regionkey >= 0 /* open", "SELECT r_name FROM region"),
    # set operations
    ("u01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    ("u02_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("u03_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier"),
    ("u04_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    ("u05_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"),
    ("u06_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    ("u07_order_limit", "SELECT c_nationkey AS k FROM customer UNION SELECT 99 ORDER BY k DESC LIMIT 3", "SELECT c_nationkey AS k FROM customer UNION SELECT 99::BIGINT ORDER BY k DESC LIMIT 3"),
    ("u07_left_to_right", "SELECT 1 AS k UNION ALL SELECT 2 INTERSECT SELECT 2 UNION ALL SELECT 3", "(SELECT 1::BIGINT AS k UNION ALL SELECT 2 INTERSECT SELECT 2) EXCEPT SELECT 1 UNION ALL SELECT 3"),
    # strings
    ("t01_length", "SELECT doc_id, LENGTH(text) AS n, CHAR_LENGTH(lang) AS m, OCTET_LENGTH(text) AS o FROM documents", "SELECT doc_id, LENGTH(text) AS n, LENGTH(lang) AS m, strlen(text) AS o FROM documents"),
    ("t02_case", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l FROM customer"),
    ("t03_trim", "SELECT p_partkey, TRIM('  ' || p_name || ' ') AS a, LTRIM(p_brand, 'Br') AS b, RTRIM(p_brand, '0123456789') AS c FROM part"),
    ("t04_substr", "SELECT c_custkey, SUBSTR(c_name, 3) AS a, SUBSTR(c_name, -4, 2) AS b, SUBSTR(c_name, 0, 3) AS c, SUBSTR(c_name, 5, -2) AS d, SUBSTRING(c_name, 2, 4) AS e FROM customer", "SELECT c_custkey, SUBSTR(c_name, 3) AS a, SUBSTR(c_name, -4, 2) AS b, SUBSTR(c_name, 1, 2) AS c, SUBSTR(c_name, 3, 2) AS d, SUBSTR(c_name, 2, 4) AS e FROM customer"),
    ("t05_replace", "SELECT p_partkey, REPLACE(p_name, 'a', '--') AS r, REPLACE(p_name, '', 'x') AS s FROM part", "SELECT p_partkey, REPLACE(p_name, 'a', '--') AS r, p_name AS s FROM part"),
    ("t06_instr", "SELECT p_partkey, INSTR(p_name, 'a') AS i, POSITION('1' IN p_brand) AS p FROM part", "SELECT p_partkey, INSTR(p_name, 'a') AS i, INSTR(p_brand, '1') AS p FROM part"),
    ("t07_concat", "SELECT c_custkey, c_name || '/' || c_custkey || NULLIF(c_mktsegment, 'BUILDING') AS t FROM customer"),
    ("t08_hex", "SELECT n_nationkey, HEX(n_name) AS h, HEX(n_nationkey) AS k FROM nation", "SELECT n_nationkey, hex(n_name::BLOB) AS h, hex(n_nationkey::VARCHAR::BLOB) AS k FROM nation"),
    ("t09_unhex", "SELECT n_nationkey, CAST(UNHEX(HEX(n_name)) AS TEXT) AS t, UNHEX('4') IS NULL AS bad FROM nation", "SELECT n_nationkey, n_name AS t, 1::BIGINT AS bad FROM nation"),
    ("t10_char", "SELECT n_nationkey, CHAR(65 + n_nationkey, 8364, 98) AS c FROM nation", "SELECT n_nationkey, chr((65 + n_nationkey)::INT) || chr(8364) || chr(98) AS c FROM nation"),
    ("t11_unicode", "SELECT n_nationkey, UNICODE(n_name) AS u FROM nation"),
    ("t12_quote", "SELECT n_nationkey, QUOTE(n_name || '''s') AS q, QUOTE(n_nationkey) AS k, QUOTE(NULL) AS z FROM nation", "SELECT n_nationkey, '''' || n_name || '''''s''' AS q, n_nationkey::VARCHAR AS k, 'NULL' AS z FROM nation"),
    ("t13_printf", "SELECT c_custkey, PRINTF('%06d|%-12s|%.2f|%x|%%', c_custkey, c_mktsegment, c_acctbal, c_nationkey) AS p FROM customer", "SELECT c_custkey, printf('%06d|%-12s|%.2f|%x|%%', c_custkey, c_mktsegment, c_acctbal, c_nationkey) AS p FROM customer"),
    ("t14_zeroblob", "SELECT LENGTH(ZEROBLOB(5)) AS a, HEX(ZEROBLOB(2)) AS b, LENGTH(RANDOMBLOB(9)) AS c", "SELECT 5::BIGINT AS a, '0000' AS b, 9::BIGINT AS c"),
    ("t16_reverse_repeat", "SELECT n_nationkey, REVERSE(n_name) AS r, REPEAT('ab', 3) AS p FROM nation"),
    # numbers, conditions, types
    ("m01_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey / 7 AS d, l_orderkey % 7 AS m, l_orderkey / (l_linenumber - 1) AS z, -l_linenumber + 2 * 3 AS p FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey // 7 AS d, l_orderkey % 7 AS m, l_orderkey // NULLIF(l_linenumber - 1, 0) AS z, (-l_linenumber + 6)::BIGINT AS p FROM lineitem"),
    ("m02_abs_round", "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, ROUND(c_acctbal) AS q, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, ROUND(c_acctbal) AS q, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, SIGN(c_acctbal)::BIGINT AS s FROM customer"),
    ("m05_sqrt_pow", "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS s, ROUND(POW(p_size, 2), 6) AS p, ROUND(POWER(p_size, 0.5), 9) AS q, SQRT(-1) IS NULL AS n FROM part", "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS s, ROUND(POW(p_size, 2), 6) AS p, ROUND(POW(p_size, 0.5), 9) AS q, 1::BIGINT AS n FROM part"),
    ("m08_max_min", "SELECT c_custkey, MAX(c_nationkey, 12) AS a, MIN(c_nationkey, 12) AS b, MAX(NULLIF(c_nationkey, 3), 1) AS c FROM customer", "SELECT c_custkey, GREATEST(c_nationkey, 12)::BIGINT AS a, LEAST(c_nationkey, 12)::BIGINT AS b, CASE WHEN c_nationkey = 3 THEN NULL ELSE GREATEST(c_nationkey, 1) END::BIGINT AS c FROM customer"),
    ("m10_logs", "SELECT p_partkey, ROUND(EXP(p_size / 10.0), 6) AS e, ROUND(LN(p_size), 9) AS l, ROUND(LOG(2, p_size), 9) AS b, ROUND(LOG2(p_size), 9) AS c, ROUND(LOG10(p_size), 9) AS d, MOD(p_size, 7) AS m FROM part", "SELECT p_partkey, ROUND(EXP(p_size / 10.0), 6) AS e, ROUND(LN(p_size), 9) AS l, ROUND(LOG2(p_size), 9) AS b, ROUND(LOG2(p_size), 9) AS c, ROUND(LOG10(p_size), 9) AS d, (p_size % 7)::DOUBLE AS m FROM part"),
    ("m11_trig", "SELECT p_partkey, ROUND(SIN(p_size), 9) AS a, ROUND(COS(p_size), 9) AS b, ROUND(TAN(p_size), 6) AS c, ROUND(ATAN2(p_size, 2), 9) AS d, ROUND(DEG_TO_RAD(p_size), 9) AS e, ROUND(RAD_TO_DEG(p_size), 6) AS f, ROUND(TANH(p_size), 9) AS g, ROUND(ASIN(1.0 / p_size), 9) AS h FROM part", "SELECT p_partkey, ROUND(SIN(p_size), 9) AS a, ROUND(COS(p_size), 9) AS b, ROUND(TAN(p_size), 6) AS c, ROUND(ATAN2(p_size, 2), 9) AS d, ROUND(RADIANS(p_size), 9) AS e, ROUND(DEGREES(p_size), 6) AS f, ROUND(TANH(p_size), 9) AS g, ROUND(ASIN(1.0 / p_size), 9) AS h FROM part"),
    ("m12_bits", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey << 3 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS n FROM nation", "SELECT n_nationkey, (n_nationkey & 6)::BIGINT AS a, (n_nationkey | 8)::BIGINT AS o, (n_nationkey * 8)::BIGINT AS l, (n_nationkey >> 1)::BIGINT AS r, (~n_nationkey)::BIGINT AS n FROM nation"),
    ("m13_coalesce", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), NULLIF(c_custkey, 9), -1) AS a, IFNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS b, NULLIF(c_nationkey, 3) AS c FROM customer"),
    ("m15_iif", "SELECT c_custkey, IIF(c_acctbal > 0, 'plus', 'minus') AS s FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s FROM customer"),
    ("m16_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 200000 THEN 'hi' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM orders", "SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::BIGINT AS a, CASE WHEN o_totalprice > 200000 THEN 'hi' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM orders"),
    ("m17_cast", "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS i, CAST(c_custkey AS REAL) AS r, CAST(c_custkey AS TEXT) AS t, CAST(c_custkey || 'abc' AS INTEGER) AS p, CAST('2024-01-15' AS DATE) AS y FROM customer", "SELECT c_custkey, TRUNC(c_acctbal)::BIGINT AS i, c_custkey::DOUBLE AS r, c_custkey::VARCHAR AS t, c_custkey AS p, 2024::BIGINT AS y FROM customer"),
    ("m18_typeof", "SELECT c_custkey, TYPEOF(c_custkey) AS a, TYPEOF(c_acctbal) AS b, TYPEOF(c_name) AS c, TYPEOF(NULLIF(c_nationkey, 3)) AS d FROM customer", "SELECT c_custkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN c_nationkey = 3 THEN 'null' ELSE 'integer' END AS d FROM customer"),
    ("m21_literals", "SELECT 1.5e2 AS a, 'it''s' AS b, TRUE + 1 AS c, HEX(X'4142') AS d, 0x10 AS e, NULL IS NULL AS f", "SELECT 150.0::DOUBLE AS a, 'it''s' AS b, 2::BIGINT AS c, '4142' AS d, 16::BIGINT AS e, 1::BIGINT AS f"),
    ("m22_scalar_subquery", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c"),
    # date and time
    ("d02_date", "SELECT o_orderkey, DATE(o_orderdate) AS d, TIME(o_orderdate) AS t, DATETIME(o_orderdate) AS s FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s FROM orders"),
    ("d05_julianday", "SELECT o_orderkey, JULIANDAY(o_orderdate) AS j, UNIXEPOCH(o_orderdate) AS u FROM orders", "SELECT o_orderkey, epoch(o_orderdate) / 86400 + 2440587.5 AS j, epoch(o_orderdate)::BIGINT AS u FROM orders"),
    ("d07_strftime", "SELECT event_id, STRFTIME('%Y/%m/%d %H:%M:%S %j %w %%', ts) AS s FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S %j %w %%') AS s FROM events"),
    ("d08_modifiers", "SELECT o_orderkey, DATE(o_orderdate, '+10 days') AS a, DATE(o_orderdate, 'start of month', '+1 month', '-1 day') AS b, DATETIME(o_orderdate, '-90 minutes', '+5 seconds') AS c FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(last_day(o_orderdate), '%Y-%m-%d') AS b, strftime(o_orderdate - INTERVAL 90 MINUTE + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS c FROM orders"),
    ("d08_month_overflow", "SELECT DATE('2024-01-31', '+1 month') AS a, DATE('2023-03-31', '-1 months') AS b, DATE('2024-02-29', '+1 year') AS c", "SELECT '2024-03-02' AS a, '2023-03-03' AS b, '2025-03-01' AS c"),
    ("d09_weekday", "SELECT DATE('2024-03-15', 'weekday 0') AS a, DATE('2024-03-17', 'weekday 0') AS b, DATETIME(86400, 'unixepoch') AS c, DATE('2024-07-09', 'start of year') AS d", "SELECT '2024-03-17' AS a, '2024-03-17' AS b, '1970-01-02 00:00:00' AS c, '2024-01-01' AS d"),
    # JSON
    ("g01_json_valid", "SELECT event_id, JSON_VALID(props) AS v, JSON_ISVALID('{x') AS w, JSON('bad{') IS NULL AS z FROM events", "SELECT event_id, 1::BIGINT AS v, 0::BIGINT AS w, 1::BIGINT AS z FROM events"),
    ("g02_extract", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, props ->> '$.k' AS m, props -> 'k' AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS m, json_extract(props, '$.k')::VARCHAR AS j FROM events"),
    ("g04_build", "SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL) AS a, JSON_OBJECT('n', n_name, 'k', n_nationkey) AS o, JSON_QUOTE(n_name) AS q FROM nation", "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",null]' AS a, '{\"n\":\"' || n_name || '\",\"k\":' || n_nationkey || '}' AS o, '\"' || n_name || '\"' AS q FROM nation"),
    ("g06_type_length", "SELECT event_id, JSON_TYPE(props) AS a, JSON_TYPE(props, '$.k') AS b, JSON_LENGTH(props) AS c, JSON_TYPE(props, '$.zz') AS d FROM events", "SELECT event_id, 'object' AS a, 'integer' AS b, 1::BIGINT AS c, NULL::VARCHAR AS d FROM events"),
    ("g10_mutate", "SELECT n_nationkey, JSON_SET('{\"a\":1}', '$.b', n_nationkey) AS a, JSON_REMOVE('[1,2,3]', '$[#-1]') AS b, JSON_REPLACE('{\"a\":1}', '$.a', n_name) AS c, JSON_INSERT('{\"a\":1}', '$.a', 5) AS d, JSON_PATCH('{\"a\":1,\"b\":{\"c\":2}}', '{\"b\":{\"c\":null,\"d\":3}}') AS e, JSON_ARRAY_INSERT('[1,3]', '$[1]', 2) AS f FROM nation", "SELECT n_nationkey, '{\"a\":1,\"b\":' || n_nationkey || '}' AS a, '[1,2]' AS b, '{\"a\":\"' || n_name || '\"}' AS c, '{\"a\":1}' AS d, '{\"a\":1,\"b\":{\"d\":3}}' AS e, '[1,2,3]' AS f FROM nation"),
    ("g17_keys", "SELECT JSON_KEYS('{\"x\":1,\"y\":[2]}') AS k, JSON_EXTRACT('{\"x\":1,\"y\":[2]}', '$.x', '$.y[0]') AS m, JSON_ARRAY_LENGTH('[1,2,3]') AS n, JSONB(' { \"a\" : 1 } ') AS b, JSON_PRETTY('[1]') AS p", "SELECT '[\"x\",\"y\"]' AS k, '[1,2]' AS m, 3::BIGINT AS n, '{\"a\":1}' AS b, '[' || chr(10) || '    1' || chr(10) || ']' AS p"),
    # the eight shapes of the benchmark
    ("b1_select_all", "SELECT * FROM lineitem"),
    ("b2_where", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey > 1000"),
    ("b3_sum", "SELECT SUM(l_partkey) AS s FROM lineitem", "SELECT SUM(l_partkey)::BIGINT AS s FROM lineitem"),
    ("b4_group_by", "SELECT l_returnflag, SUM(l_linenumber) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag", "SELECT l_returnflag, SUM(l_linenumber)::BIGINT AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag"),
    ("b5_count", "SELECT COUNT(*) AS n FROM orders"),
    ("b6_join", "SELECT o.o_orderkey AS k, l.l_partkey AS p FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"),
    ("b7_order_limit", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem ORDER BY l_partkey DESC, l_orderkey, l_suppkey LIMIT 100"),
]
