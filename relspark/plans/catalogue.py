"""The registered queries over the driver tables, with their oracle SQL.

Each entry is the query in this package's dialect (run through ``dialect.rewrite``
and Catalyst) and the SQL an independent engine answers it with; None where both
texts are the same. Every query reads its whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import rewrite
from ..functions import udfs
from ..operators import recursive, relational, tablefunc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FLAGSHIP = """
SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n
FROM customer
JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'
GROUP BY n_name
HAVING COUNT(*) > 1
ORDER BY revenue DESC, n_name
LIMIT 10
"""

#: Sums of doubles are rounded to this many digits on both sides.
_SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    # projection, filter, predicates
    "scan_project": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem", None),
    "constant_row": ("SELECT 1 + 1 AS two, 'a' || 'b' AS ab", None),
    "filter_compare": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND NOT o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'", None),
    "filter_or_parens": ("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND p_retailprice != 0", None),
    "filter_between": ("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000", None),
    "filter_not_between": ("SELECT c_custkey FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 5000", None),
    "filter_in": ("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)", None),
    "filter_not_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (1, 3, 5, 7)", None),
    "filter_like_ci": ("SELECT n_name FROM nation WHERE n_name LIKE '%a%'", "SELECT n_name FROM nation WHERE n_name ILIKE '%a%'"),
    "filter_like_escape": ("SELECT p_partkey FROM part WHERE p_name LIKE '%!_%' ESCAPE '!' OR p_name NOT LIKE '%e%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%!_%' ESCAPE '!' OR p_name NOT ILIKE '%e%'"),
    "filter_glob": ("SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*A?*'", None),
    "filter_is_null": ("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL", None),
    "filter_is_not_null": ("SELECT COUNT(*) AS n FROM events WHERE props IS NOT NULL", None),
    "filter_case_lhs": ("SELECT p_partkey FROM part WHERE CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END = 'mid'", None),
    "filter_expr_lhs": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice > 900000 AND UPPER(l_returnflag) = 'R'", None),
    "filter_true": ("SELECT r_name FROM region WHERE TRUE AND NOT 1 = 0", None),
    "row_compare": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) >= (14000, 3)", None),
    "row_in_list": ("SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) IN ((1, 1), (3, 1), (4, 4))", None),
    "row_in_subquery": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, MAX(l_linenumber) FROM lineitem GROUP BY l_orderkey)", None),
    "distinct_multi": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", None),
    "join_full": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_natural": ("SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b", None),
    "join_multi_cond": ("SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 45 AND s.s_acctbal > 0", None),
    "join_chain4": ("SELECT r_name, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey", None),
    "join_using": ("SELECT k, n_name, c_custkey FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b USING (k)", None),
    "lateral_topn": ("SELECT c.c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x", None),
    "lateral_agg": ("SELECT c.c_custkey, x.n, x.total FROM customer c LEFT JOIN LATERAL (SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders o WHERE o.o_custkey = c.c_custkey) x ON true", None),
    # subqueries
    "sub_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", None),
    "sub_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", None),
    "sub_exists": ("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)", None),
    "sub_not_exists": ("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)", None),
    "sub_scalar_where": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "sub_scalar_select": ("SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", None),
    "sub_corr_scalar": ("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "derived_table": ("SELECT d.flag, d.n FROM (SELECT l_returnflag AS flag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 1) AS d WHERE d.n > 10", None),
    # aggregation
    "agg_global": ("SELECT COUNT(*) AS n, COUNT(props) AS np, ROUND(SUM(value), 2) AS s, ROUND(AVG(value), 4) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events", None),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS lo FROM orders WHERE 1 = 0", None),
    "agg_group": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_expr": ("SELECT LENGTH(p_brand) AS k, SUM(p_size * 2) AS s FROM part GROUP BY LENGTH(p_brand)", "SELECT LENGTH(p_brand)::INT AS k, SUM(p_size * 2)::BIGINT AS s FROM part GROUP BY LENGTH(p_brand)"),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND SUM(o_totalprice) > 100000", None),
    "agg_distinct_all": ("SELECT COUNT(DISTINCT p_size) AS c, SUM(DISTINCT p_size) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a, MIN(DISTINCT p_size) AS lo, MAX(DISTINCT p_size) AS hi FROM part", "SELECT COUNT(DISTINCT p_size) AS c, SUM(DISTINCT p_size)::BIGINT AS s, ROUND(AVG(DISTINCT p_size), 6) AS a, MIN(DISTINCT p_size) AS lo, MAX(DISTINCT p_size) AS hi FROM part"),
    "group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name, '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "string_agg_distinct": ("SELECT o_orderstatus, STRING_AGG(DISTINCT o_orderpriority, ',') AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus"),
    "agg_first_in_group": ("SELECT o_custkey, MIN_BY(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey"),
    # windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, (ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rn FROM orders"),
    "win_rank_dense": ("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", "SELECT p_partkey, (RANK() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS r, (DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS d FROM part"),
    "win_lag_lead": ("SELECT event_id, LAG(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events", None),
    "win_ntile": ("SELECT p_partkey, NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS t FROM part", "SELECT p_partkey, (NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))::INT AS t FROM part"),
    "win_first_last": ("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "win_running_sum": ("SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events", None),
    "win_rolling_rows": ("SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS m FROM events", None),
    "win_whole_partition": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders"),
    "win_named": ("SELECT o_orderkey, ROW_NUMBER() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, (ROW_NUMBER() OVER w)::INT AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "win_range": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "win_range_offset": ("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM part", None),
    "win_groups": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM orders", None),
    "win_named_frame": (
        "SELECT o_orderkey, COUNT(*) OVER w AS n, LAST_VALUE(o_orderkey) OVER w AS l, RANK() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS l, (RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS r FROM orders",
    ),
    # sort and limit
    "sort_nulls_last": ("SELECT ROW_NUMBER() OVER (ORDER BY x.v, x.k) AS rn, x.k FROM (SELECT r_regionkey AS k, NULLIF(r_regionkey, 2) AS v FROM region) x", "SELECT (ROW_NUMBER() OVER (ORDER BY v NULLS LAST, k))::INT AS rn, k FROM (SELECT r_regionkey AS k, NULLIF(r_regionkey, 2) AS v FROM region) x"),
    "sort_nulls_first": ("SELECT k FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 2) AS v FROM nation) x ORDER BY v NULLS FIRST, k LIMIT 4", None),
    "sort_nocase": ("SELECT n_name FROM nation ORDER BY n_name COLLATE NOCASE, n_nationkey LIMIT 10", "SELECT n_name FROM nation ORDER BY lower(n_name), n_nationkey LIMIT 10"),
    "sort_expr_ordinal": ("SELECT p_name, p_partkey FROM part ORDER BY LENGTH(p_name) DESC, 2 LIMIT 7", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30", None),
    "offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    # set operations
    "union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "set_op_chain": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION SELECT 99", None),
    # CTEs
    "cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey", None),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b", None),
    "cte_recursive_counter": ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 300) SELECT COUNT(*) AS c, SUM(n) AS s FROM r", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 300) SELECT COUNT(*) AS c, SUM(n)::BIGINT AS s FROM r"),
    "cte_hierarchy": ("WITH RECURSIVE h AS (SELECT n_nationkey AS k, 0 AS lvl FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, h.lvl + 1 FROM nation JOIN h ON n_nationkey > 0 AND CAST(FLOOR((n_nationkey - 1) * 0.5) AS INT) = h.k) SELECT k, lvl FROM h", "WITH RECURSIVE h AS (SELECT n_nationkey AS k, 0 AS lvl FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, h.lvl + 1 FROM nation JOIN h ON n_nationkey > 0 AND (n_nationkey - 1) // 2 = h.k) SELECT k, lvl FROM h"),
    # scalar functions
    "fn_string": ("SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, c_name || '/' || c_mktsegment AS j FROM customer", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name)::INT AS n, c_name || '/' || c_mktsegment AS j FROM customer"),
    "fn_substr": ("SELECT p_partkey, SUBSTR(p_name, 2, 4) AS a, SUBSTR(p_name, -3) AS b, SUBSTR(p_name, -100, 3) AS c FROM part", "SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, greatest(-3, -length(p_name))) AS b, substr(p_name, greatest(-100, -length(p_name)), 3) AS c FROM part"),
    "fn_trim": ("SELECT n_nationkey, TRIM('  ' || n_name || ' ') AS a, LTRIM(n_name, 'ANU') AS b, RTRIM(n_name, 'AEY') AS c FROM nation", None),
    "fn_replace_instr": ("SELECT p_partkey, REPLACE(p_name, 'a', '<>') AS r, INSTR(p_name, 'e') AS i, INSTR(p_name, NULL) AS z FROM part", "SELECT p_partkey, replace(p_name, 'a', '<>') AS r, instr(p_name, 'e')::INT AS i, 0 AS z FROM part"),
    "fn_printf": ("SELECT p_partkey, PRINTF('%05d|%-8s|%.2f|%x', p_partkey, p_brand, p_retailprice, p_size) AS f FROM part", "SELECT p_partkey, printf('%05d|%-8s|%.2f|%x', p_partkey, p_brand, p_retailprice, p_size) AS f FROM part"),
    "fn_math": ("SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f FROM customer"),
    "fn_round": ("SELECT l_orderkey, l_linenumber, ROUND(l_quantity + 0.5) AS r0 FROM lineitem", "SELECT l_orderkey, l_linenumber, round_even(l_quantity + 0.5, 0)::BIGINT AS r0 FROM lineitem"),
    "fn_mod_div": ("SELECT n_nationkey, MOD(n_nationkey - 12, 5) AS m, (n_nationkey - 12) % -5 AS m2, (n_nationkey - 12) / 5 AS d, n_nationkey / 0 AS z, n_nationkey / 2.0 AS h FROM nation", "SELECT n_nationkey, ((n_nationkey - 12) - 5 * floor((n_nationkey - 12) / 5))::INT AS m, ((n_nationkey - 12) + 5 * floor((n_nationkey - 12) / -5))::INT AS m2, floor((n_nationkey - 12) / 5)::BIGINT AS d, NULL::BIGINT AS z, n_nationkey / 2.0::DOUBLE AS h FROM nation"),
    "fn_cast": ("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS i, CAST(c_custkey AS REAL) AS r, CAST('12.7x' AS INTEGER) AS bad, CAST('12.7' AS INTEGER) AS good, CAST(c_nationkey AS TEXT) AS t FROM customer", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS i, c_custkey::DOUBLE AS r, NULL::BIGINT AS bad, 12::BIGINT AS good, c_nationkey::VARCHAR AS t FROM customer"),
    "fn_coalesce_nullif": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 0), -1) AS a, IFNULL(NULLIF(n_regionkey, 1), 7) AS b FROM nation", None),
    "fn_case": ("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN p_size IN (2, 3) AND p_retailprice IS NOT NULL THEN 'few' ELSE 'many' END AS c, CASE p_size WHEN 1 THEN 10 ELSE 20 END AS d FROM part", None),
    "fn_typeof": ("SELECT o_orderkey, TYPEOF(o_orderkey) AS a, TYPEOF(o_totalprice) AS b, TYPEOF(o_orderstatus) AS c, TYPEOF(NULLIF(1, 1)) AS d FROM orders", "SELECT o_orderkey, 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d FROM orders"),
    "fn_concat_null": ("SELECT n_nationkey, n_name || NULLIF(n_name, 'CHINA') AS c FROM nation", None),
    # JSON
    "json_extract": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events", "SELECT event_id, props->>'$.k' AS k FROM events"),
    "json_valid": ("SELECT event_id, JSON_VALID(props) AS a, JSON_VALID('{bad') AS b, JSON_VALID('null') AS c FROM events", "SELECT event_id, CASE WHEN json_valid(props) THEN 1 ELSE 0 END AS a, 0 AS b, 0 AS c FROM events"),
    "json_type": ("SELECT event_id, JSON_TYPE(props) AS a, JSON_TYPE(props, '$.k') AS b, JSON_TYPE(props, '$.none') AS c FROM events", "SELECT event_id, 'object' AS a, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN json_type(props, '$.k') = 'DOUBLE' THEN 'real' ELSE 'other' END AS b, 'null' AS c FROM events"),
    "json_array_object": ("SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL) AS a, JSON_OBJECT('id', n_nationkey, 'name', n_name) AS o FROM nation", "SELECT n_nationkey, json_array(n_nationkey, n_name, NULL)::VARCHAR AS a, json_object('id', n_nationkey, 'name', n_name)::VARCHAR AS o FROM nation"),
    "json_set_remove": ("SELECT n_nationkey, JSON_SET('{\"a\":1}', '$.b', n_nationkey) AS s, JSON_REMOVE('{\"a\":1,\"b\":[1,2]}', '$.a', '$.b[0]') AS r, JSON_INSERT('{\"a\":1}', '$.a', 9) AS i, JSON_REPLACE('{\"a\":1}', '$.a', 9) AS p FROM nation", "SELECT n_nationkey, '{\"a\":1,\"b\":' || n_nationkey || '}' AS s, '{\"b\":[2]}' AS r, '{\"a\":1}' AS i, '{\"a\":9}' AS p FROM nation"),
    "lateral_json_each": ("SELECT e.event_id, j.key AS k, j.value AS v, j.type AS t FROM events e, json_each(e.props) j", "SELECT event_id, j.key AS k, (props::JSON ->> j.key) AS v, CASE WHEN json_type(props, '$.' || j.key) IN ('UBIGINT', 'BIGINT') THEN 'integer' ELSE 'other' END AS t FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) j"),
    "json_patch": ("SELECT n_nationkey, JSON_PATCH('{\"a\":1,\"b\":{\"c\":2}}', '{\"a\":null,\"b\":{\"d\":3}}') AS p FROM nation", "SELECT n_nationkey, json_merge_patch('{\"a\":1,\"b\":{\"c\":2}}', '{\"a\":null,\"b\":{\"d\":3}}')::VARCHAR AS p FROM nation"),
    "json_array_length": ("SELECT n_nationkey, JSON_ARRAY_LENGTH('[1,2,3]') AS a, JSON_ARRAY_LENGTH('{\"x\":[1]}', '$.x') AS b, JSON_ARRAY_LENGTH('{}') AS c FROM nation", "SELECT n_nationkey, 3 AS a, 1 AS b, NULL::INT AS c FROM nation"),
    "json_quote": ("SELECT n_nationkey, JSON_QUOTE(n_name || '\"') AS a, JSON_QUOTE(n_nationkey) AS b FROM nation", "SELECT n_nationkey, to_json(n_name || '\"')::VARCHAR AS a, n_nationkey::VARCHAR AS b FROM nation"),
    "json_minify": ("SELECT n_nationkey, JSON('{\"a\" : ' || n_nationkey || ' , \"b\": [1, 2]}') AS j FROM nation", "SELECT n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":[1,2]}' AS j FROM nation"),
    "json_tree": ("SELECT e.event_id, j.fullkey AS f FROM events e, json_tree(e.props) j", "SELECT event_id, '$' AS f FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, '$.' || j.key FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) j"),
    # further reads
    "row_not_in_subquery": ("SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) NOT IN (SELECT s_nationkey, 1 FROM supplier)", None),
    "sort_rtrim": ("SELECT n_name FROM nation ORDER BY n_name || '  ' COLLATE RTRIM DESC, n_nationkey LIMIT 10", "SELECT n_name FROM nation ORDER BY rtrim(n_name || '  ') DESC, n_nationkey LIMIT 10"),
    "fn_round_digits": ("SELECT l_orderkey, l_linenumber, ROUND(l_quantity * 0.125, 2) AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.125::DOUBLE, 2) AS r FROM lineitem"),
    "fn_div_big": (
        "SELECT n_nationkey, (9007199254740993 + n_nationkey) / 1 AS a, (-9007199254740993 - n_nationkey) / 2 AS b, 7 / (n_nationkey - 3) AS c FROM nation",
        "SELECT n_nationkey, 9007199254740993 + n_nationkey AS a, (-9007199254740993 - n_nationkey - (9007199254740993 + n_nationkey) % 2) // 2 AS b, CASE WHEN n_nationkey <> 3 THEN floor(7 / (n_nationkey - 3))::BIGINT END AS c FROM nation",
    ),
    "fn_random": ("SELECT n_nationkey, TYPEOF(RANDOM()) AS a, TYPEOF(RANDOMBLOB(4)) AS b FROM nation", "SELECT n_nationkey, 'integer' AS a, 'blob' AS b FROM nation"),
    "fn_current": ("SELECT r_name, LENGTH(CURRENT_TIMESTAMP) AS a, LENGTH(CURRENT_DATE) AS b, LENGTH(CURRENT_TIME) AS c FROM region", "SELECT r_name, 19 AS a, 10 AS b, 8 AS c FROM region"),
    "fn_format": ("SELECT p_partkey, FORMAT('%s:%5.1f', p_brand, p_retailprice) AS f FROM part", "SELECT p_partkey, printf('%s:%5.1f', p_brand, p_retailprice) AS f FROM part"),
    "with_set_op": ("WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0) SELECT k FROM a UNION SELECT s_nationkey + 10 FROM supplier EXCEPT SELECT 3", None),
    "join_cte_view": ("WITH big AS (SELECT n_name AS name, n_regionkey FROM nation WHERE n_nationkey > 5) SELECT b.name, v.n FROM big b JOIN nation_customers v ON b.name = v.n_name", "SELECT n_name AS name, COUNT(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey > 5 GROUP BY n_name"),
    "inline_values": ("SELECT v.x, n_name FROM (VALUES (1, 'a'), (2, 'b')) v(x, y) JOIN nation ON n_nationkey = v.x", None),
    "view_query": ("SELECT n_name, n FROM nation_customers WHERE n > 10", "SELECT n_name, n FROM (SELECT n_name, COUNT(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name) WHERE n > 10"),
    "generated_column": ("SELECT l_orderkey, l_linenumber, net FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) g WHERE net > 90000", None),
    "fk_orphans": ("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 5)", None),
    "unique_violations": ("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1", None),
}

_VIEWS = {"nation_customers": "SELECT n_name, COUNT(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"}


def load_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A dialect query over the tables it names."""
    for name, text in _VIEWS.items():
        if name in sql:
            run_sql(spark, sf_dir, text).createOrReplaceTempView(name)
    load_tables(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql)))
    udfs.register(spark)
    return spark.sql(rewrite(sql))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, FLAGSHIP)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recursive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that each nation reaches by k -> (7k + 3) mod 25, from 0 on: a cycle that UNION ends."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    step = lambda new: new.select(((F.col("k") * 7 + 3) % 25).alias("k")).join(nation, "k", "left_semi")
    return recursive.fixpoint(nation.where("k = 0"), step)


def _json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tablefunc.json_each(_table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", F.col("key").alias("k"), F.col("value").alias("v"), F.col("fullkey").alias("path"))


def _natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), "n_name")
    right = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), "r_name")
    return relational.natural_join(left, right, "a", "b").withColumnsRenamed({"a.id": "a_id", "b.id": "b_id", "a.n_name": "n_name", "b.r_name": "r_name"})


def _database(script: str, query: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """The final state after DML on tables loaded from the driver's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.database import Database

        db = Database(spark=spark)
        for t in tables:
            db.register(t, _table(spark, sf_dir, t))
        db.executescript(script)
        return db.query(query)

    return run


def _result(script: str, statement: str, *tables: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[SparkSession, str], DataFrame]:
    """What a last statement itself returns (RETURNING, PRAGMA, EXPLAIN, ...)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.database import Database

        db = Database(spark=spark)
        for t in tables:
            db.register(t, _table(spark, sf_dir, t))
        db.executescript(script)
        return then(db.run(statement)[0])

    return run


#: Statements that must fail, each after the ones before, and the error's name.
_FAILING = {
    "INSERT INTO t VALUES (1, 9, 'x')": "UniqueConstraintError",
    "INSERT INTO t VALUES (99, NULL, 'x')": "NotNullError",
    "INSERT INTO t VALUES (99, -1, 'x')": "CheckError",
    "INSERT INTO t VALUES (99, 1, 'long text')": "DataError",
    "INSERT INTO t (nope) VALUES (1)": "NoSuchColumnError",
    "INSERT INTO c VALUES (5, 1000)": "ForeignKeyError",
    "DELETE FROM t WHERE id = 3": "ForeignKeyError",
    "UPDATE t SET id = 1 WHERE id = 2": "UniqueConstraintError",
    "DELETE FROM t WHERE id = 4": "ConstraintError",
    "CREATE TABLE t (a INTEGER)": "TableExistsError",
    "CREATE INDEX i ON t (n)": "IndexExistsError",
    "DROP INDEX j": "NoSuchIndexError",
    "ALTER TABLE t ADD COLUMN n INTEGER": "ColumnExistsError",
    "SELECT * FROM nowhere": "NoSuchTableError",
    "SELEC 1": "ParseError",
    "ROLLBACK": "TransactionError",
    "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT n + 1 FROM r) SELECT n FROM r": "OperationalError",
}


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import errors as er
    from ..operators import recursive as rec
    from ..sources.database import Database

    db = Database(spark=spark)
    db.register("nation", _table(spark, sf_dir, "nation"))
    db.executescript(
        "CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER NOT NULL CHECK (n >= 0), v VARCHAR(4)); CREATE TABLE c (id INTEGER PRIMARY KEY, tid INTEGER REFERENCES t(id)); INSERT INTO t SELECT n_nationkey, n_regionkey, 'v' FROM nation;"
        " INSERT INTO c VALUES (1, 3); CREATE INDEX i ON t (n); CREATE TRIGGER keep BEFORE DELETE ON t WHEN OLD.id = 4 BEGIN SELECT RAISE(ABORT, 'keep'); END;"
    )
    rows, rounds = [], rec.ROUNDS
    rec.ROUNDS = 3
    try:
        for sql in _FAILING:
            try:
                got = db.run(sql)[0]
                rows.append((sql, "none" if got is None or got.count() >= 0 else ""))
            except er.Error as e:
                rows.append((sql, type(e).__name__))
    finally:
        rec.ROUNDS = rounds
    return spark.createDataFrame([*rows, ("rows left", str(db.query("SELECT COUNT(*) FROM t").first()[0]))], "sql string, error string")


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database made anew from the dump of another."""
    from ..sources.database import Database

    one, two = Database(spark=spark), Database(spark=spark)
    one.register("nation", _table(spark, sf_dir, "nation"))
    one.executescript("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t SELECT n_nationkey, n_name || '''' FROM nation WHERE n_regionkey < 2; CREATE VIEW w AS SELECT k FROM t WHERE k > 3; DROP TABLE nation;")
    two.executescript("\n".join(one.iterdump()))
    return two.query("SELECT t.k, t.v FROM t JOIN w ON t.k = w.k")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.database import Database

    db = Database(spark=spark)
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT, w REAL)")
    db.executemany("INSERT INTO t (v, w) VALUES (?, ? + 1)", [(f"it's {i}", i) for i in range(200)])
    return db.query("SELECT k, v, w FROM t WHERE k <> LAST_INSERT_ROWID()")


def _user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.database import Database

    db = Database(spark=spark)
    db.register("nation", _table(spark, sf_dir, "nation"))
    db.create_function("twice", 1, lambda s: None if s is None else s + s)
    return db.query("SELECT n_nationkey, twice(n_name) AS t FROM nation")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, counted by a stream that reads the files as they come."""
    from ..streaming.incremental import event_stream

    source = f"{sf_dir}/events.parquet"
    counts = event_stream(spark, f"{source}*", spark.read.parquet(source).schema).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    name = f"events_{uuid.uuid4().hex[:8]}"
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


_NATION = "CREATE TABLE t (k INTEGER PRIMARY KEY, r INTEGER, v TEXT); INSERT INTO t SELECT n_nationkey, n_regionkey, n_name FROM nation; "
_ALL = "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r, n_name AS v FROM nation"
_STATEMENTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "statement_errors": (_errors, "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in _FAILING.items()) + ") x(sql, error) UNION ALL SELECT 'rows left', COUNT(*)::VARCHAR FROM nation"),
    "insert_returning": (_result(_NATION, "INSERT INTO t VALUES (100, 1, 'a' || 'b'), (101, 2, NULL) RETURNING k, v, r * 2 AS d", "nation"), "SELECT 100::BIGINT AS k, 'ab' AS v, 2::BIGINT AS d UNION ALL SELECT 101, NULL, 4"),
    "update_returning": (_result(_NATION, "UPDATE t SET r = r + 10, v = v || r WHERE k IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) RETURNING k, v", "nation"), "SELECT n_nationkey::BIGINT AS k, n_name || (n_regionkey + 10) AS v FROM nation WHERE n_regionkey = 2"),
    "update_limit": (_database(_NATION + "UPDATE t SET r = -1 LIMIT 4;", "SELECT r = -1 AS hit, COUNT(*) AS n FROM t GROUP BY r = -1", "nation"), "SELECT true AS hit, 4::BIGINT AS n UNION ALL SELECT false, COUNT(*) - 4 FROM nation"),
    "delete_returning": (_result(_NATION, "DELETE FROM t WHERE r = 3 AND k > 5 RETURNING k", "nation"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5"),
    "delete_limit": (_database(_NATION + "DELETE FROM t WHERE r = 1 LIMIT 2;", "SELECT COUNT(*) AS n FROM t", "nation"), "SELECT COUNT(*) - 2 AS n FROM nation"),
    "update_subquery": (_database("UPDATE customer SET c_acctbal = 0 WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1);", "SELECT c_custkey, c_acctbal FROM customer", "customer", "nation"), "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "dml_upsert_nulls": (
        _database("CREATE TABLE t (id INTEGER PRIMARY KEY, u INTEGER UNIQUE, v INTEGER); INSERT INTO t (u, v) SELECT n_nationkey, 1 FROM nation; INSERT INTO t (u, v) VALUES (NULL, 7), (NULL, 7), (3, 10), (3, 100), (500, 1), (500, 2) ON CONFLICT (u) DO UPDATE SET v = v + excluded.v;", "SELECT u, v FROM t", "nation"),
        "SELECT n_nationkey::BIGINT AS u, CASE WHEN n_nationkey = 3 THEN 111 ELSE 1 END::BIGINT AS v FROM nation UNION ALL SELECT NULL, 7 UNION ALL SELECT NULL, 7 UNION ALL SELECT 500, 3",
    ),
    "insert_ignore_checked": (_database("CREATE TABLE t (k INTEGER PRIMARY KEY, r INTEGER NOT NULL CHECK (r <> 2)); INSERT OR IGNORE INTO t SELECT n_nationkey, NULLIF(n_regionkey, 4) FROM nation;", "SELECT k, r FROM t", "nation"), "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey NOT IN (2, 4)"),
    "insert_autokey": (_database("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t (v) SELECT n_name FROM nation; INSERT INTO t VALUES (1000, 'x'); INSERT INTO t (v) VALUES ('y');", "SELECT MIN(k) AS a, MAX(k) AS b, COUNT(DISTINCT k) AS n FROM t", "nation"), "SELECT 1::BIGINT AS a, 1001::BIGINT AS b, COUNT(*) + 2 AS n FROM nation"),
    "ddl_alter": (_database(_NATION + "ALTER TABLE t ADD COLUMN d INTEGER DEFAULT 4; ALTER TABLE t RENAME COLUMN v TO name; ALTER TABLE t DROP COLUMN r; ALTER TABLE t RENAME TO u;", "SELECT k, name, d FROM u", "nation"), "SELECT n_nationkey::BIGINT AS k, n_name AS name, 4::BIGINT AS d FROM nation"),
    "ddl_view": (_database(_NATION + "CREATE VIEW w AS SELECT r, COUNT(*) AS n FROM t GROUP BY r; CREATE VIEW x AS SELECT r FROM w WHERE n > 4; DELETE FROM t WHERE r = 0;", "SELECT w.r, w.n FROM w JOIN x ON w.r = x.r", "nation"), "SELECT n_regionkey::BIGINT AS r, COUNT(*) AS n FROM nation WHERE n_regionkey <> 0 GROUP BY n_regionkey HAVING COUNT(*) > 4"),
    "ddl_generated": (_database("CREATE TABLE g (k INTEGER PRIMARY KEY, w REAL, h REAL AS (w * 2) VIRTUAL, s REAL AS (w + 1) STORED); INSERT INTO g (k, w) SELECT c_custkey, c_acctbal FROM customer; UPDATE g SET w = 0 WHERE k < 10;", "SELECT k, h, s FROM g", "customer"), "SELECT c_custkey::BIGINT AS k, CASE WHEN c_custkey < 10 THEN 0 ELSE c_acctbal END * 2 AS h, CASE WHEN c_custkey < 10 THEN 0 ELSE c_acctbal END + 1 AS s FROM customer"),
    "ddl_master": (_database(_NATION + "CREATE INDEX i ON t (r); CREATE VIEW w AS SELECT k FROM t; CREATE TABLE gone (a INTEGER); DROP TABLE gone; DROP TABLE nation;", "SELECT type, name, tbl_name FROM _relspark_master", "nation"), "SELECT 'table' AS type, 't' AS name, 't' AS tbl_name UNION ALL SELECT 'index', 'i', 't' UNION ALL SELECT 'view', 'w', 'w'"),
    "schema_meta": (_database(_NATION + "INSERT INTO _relspark_schema_meta VALUES ('table', 't', 'owner', 'me'), ('table', 't', 'note', 'x'); UPDATE _relspark_schema_meta SET value = 'you' WHERE key = 'owner'; DELETE FROM _relspark_schema_meta WHERE key = 'note';", "SELECT object_type, object_name, key, value FROM _relspark_schema_meta", "nation"), "SELECT 'table' AS object_type, 't' AS object_name, 'owner' AS key, 'you' AS value"),
    "pragma_table_info": (_result(_NATION, "PRAGMA table_info(t)", "nation", then=lambda df: df.select("cid", "name", "type", "pk")), "SELECT 0::BIGINT AS cid, 'k' AS name, 'INTEGER' AS type, 1::BIGINT AS pk UNION ALL SELECT 1, 'r', 'INTEGER', 0 UNION ALL SELECT 2, 'v', 'TEXT', 0"),
    "pragma_integrity": (_result(_NATION + "CREATE UNIQUE INDEX i ON t (v);", "PRAGMA integrity_check", "nation"), "SELECT 'ok' AS integrity_check"),
    "explain_plan": (_result(_NATION, "EXPLAIN QUERY PLAN SELECT r, COUNT(*) FROM t GROUP BY r", "nation", then=lambda df: df.select((F.max("id") > 0).alias("lines"), (F.max("parent") > 0).alias("nested"), (F.min("notused") == 0).alias("zero")).limit(1)), "SELECT true AS lines, true AS nested, true AS zero"),
    "analyze_statement": (_result(_NATION, "ANALYZE t", "nation"), "SELECT 'k' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT n_nationkey) AS ndv, 't' AS table_name FROM nation UNION ALL SELECT 'r', COUNT(*), COUNT(DISTINCT n_regionkey), 't' FROM nation UNION ALL SELECT 'v', COUNT(*), COUNT(DISTINCT n_name), 't' FROM nation"),
    "vacuum": (_database(_NATION + "DELETE FROM t WHERE r = 0; INSERT INTO t VALUES (90, 0, 'z'); VACUUM;", "SELECT k, r, v FROM t", "nation"), f"SELECT * FROM ({_ALL}) WHERE r <> 0 UNION ALL SELECT 90, 0, 'z'"),
    "rowid_lookup": (_database(_NATION, "SELECT k, v FROM t WHERE k = 7", "nation"), "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation WHERE n_nationkey = 7"),
    "fk_set_null_update_cascade": (
        _database("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p(id) ON DELETE SET NULL ON UPDATE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 2; UPDATE p SET id = id + 50 WHERE id = 3;", "SELECT id, pid FROM c", "region", "nation"),
        "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 2 THEN NULL WHEN n_regionkey = 3 THEN 53 ELSE n_regionkey END::BIGINT AS pid FROM nation",
    ),
    "trigger_set_insert": (_database(_NATION + "CREATE TABLE log (k INTEGER, what TEXT); CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO log VALUES (NEW.k, 'in ' || NEW.v); END; INSERT INTO t SELECT n_nationkey + 100, 0, n_name FROM nation;", "SELECT k, what FROM log", "nation"), "SELECT n_nationkey::BIGINT + 100 AS k, 'in ' || n_name AS what FROM nation"),
    "trigger_row_update": (_database(_NATION + "CREATE TABLE total (r INTEGER PRIMARY KEY, n INTEGER); INSERT INTO total VALUES (0, 0), (1, 0); CREATE TRIGGER a AFTER DELETE ON t BEGIN UPDATE total SET n = n + 1 WHERE r = OLD.r; END; DELETE FROM t WHERE k IN (0, 1, 2);", "SELECT r, n FROM total", "nation"), "SELECT r::BIGINT AS r, (SELECT COUNT(*) FROM nation WHERE n_nationkey IN (0, 1, 2) AND n_regionkey = r) AS n FROM (VALUES (0), (1)) x(r)"),
    "trigger_instead_of": (_database(_NATION + "CREATE VIEW w AS SELECT k, v FROM t WHERE k < 3; CREATE TRIGGER a INSTEAD OF INSERT ON w BEGIN INSERT INTO t VALUES (NEW.k, 9, NEW.v); END; INSERT INTO w VALUES (70, 'via');", "SELECT k, r, v FROM t", "nation"), f"{_ALL} UNION ALL SELECT 70, 9, 'via'"),
    "transaction_commit": (_database(_NATION + "BEGIN; DELETE FROM t WHERE r = 1; COMMIT; BEGIN; DELETE FROM t; ROLLBACK;", "SELECT k FROM t", "nation"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey <> 1"),
    "register_filtered": (lambda spark, sf_dir: _registered(spark, sf_dir), "SELECT n_nationkey, n_regionkey * 2 AS r2 FROM nation WHERE n_regionkey = 3"),
    "recursive_union_sql": (_result("", "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 7 + 3) % 25 FROM r JOIN nation ON n_nationkey = k) SELECT k FROM r", "nation"), "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 7 + 3) % 25 FROM r) SELECT k::INT AS k FROM r"),
    "dump_and_restore": (_dump, "SELECT n_nationkey::BIGINT AS k, n_name || '''' AS v FROM nation WHERE n_regionkey < 2 AND n_nationkey > 3"),
    "executemany": (_many, "SELECT i + 1 AS k, 'it''s ' || i AS v, (i + 1)::DOUBLE AS w FROM range(199) t(i)"),
    "user_function": (_user_function, "SELECT n_nationkey, n_name || n_name AS t FROM nation"),
    "stream_counts": (_streamed, "SELECT event_type, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY event_type"),
}


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.database import Database

    db = Database(spark=spark)
    db.register("n3", _table(spark, sf_dir, "nation").where("n_regionkey = 3").withColumn("r2", F.col("n_regionkey") * 2))
    return db.query("SELECT n_nationkey, r2 FROM n3")


_DML: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_insert_select": (_database("CREATE TABLE big (k INTEGER PRIMARY KEY, name TEXT); INSERT INTO big SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000;", "SELECT k, name FROM big", "customer"), "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000"),
    "dml_update": (_database("UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = UPPER(c_name) WHERE c_nationkey = 3;", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", "customer"), "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_delete": (_database("DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0);", "SELECT o_orderkey FROM orders", "orders", "customer"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "dml_upsert": (
        _database("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT INTO t VALUES (3, 'new'), (99, 'more') ON CONFLICT (k) DO UPDATE SET v = excluded.v;", "SELECT k, v FROM t", "nation"),
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS v FROM nation UNION ALL SELECT 99, 'more'",
    ),
    "dml_replace": (
        _database("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT OR REPLACE INTO t VALUES (3, 'new'); INSERT OR IGNORE INTO t VALUES (4, 'no'), (98, 'yes');", "SELECT k, v FROM t", "nation"),
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS v FROM nation UNION ALL SELECT 98, 'yes'",
    ),
    "dml_ctas_truncate": (_database("CREATE TABLE c AS SELECT r_regionkey AS k, r_name AS v FROM region; TRUNCATE TABLE c; INSERT INTO c VALUES (1, 'x');", "SELECT k, v FROM c", "region"), "SELECT 1::BIGINT AS k, 'x' AS v"),
    "fk_cascade": (
        _database("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p(id) ON DELETE CASCADE); INSERT INTO p SELECT r_regionkey, r_name FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 2;", "SELECT id, pid FROM c", "region", "nation"),
        "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS pid FROM nation WHERE n_regionkey <> 2",
    ),
    "trigger_audit": (
        _database("CREATE TABLE t (k INTEGER, v TEXT); CREATE TABLE log (k INTEGER, old TEXT, new TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; CREATE TRIGGER tr AFTER UPDATE ON t FOR EACH ROW WHEN NEW.k > 20 BEGIN INSERT INTO log VALUES (NEW.k, OLD.v, NEW.v); END; UPDATE t SET v = LOWER(v) WHERE k >= 20;", "SELECT k, old, new FROM log", "nation"),
        "SELECT n_nationkey::BIGINT AS k, n_name AS old, lower(n_name) AS new FROM nation WHERE n_nationkey > 20",
    ),
    "savepoint_rollback": (
        _database("CREATE TABLE t (k INTEGER); BEGIN; INSERT INTO t SELECT n_nationkey FROM nation; SAVEPOINT s; DELETE FROM t WHERE k < 10; ROLLBACK TO s; DELETE FROM t WHERE k > 20; COMMIT;", "SELECT k FROM t", "nation"),
        "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey <= 20",
    ),
    "analyze_stats": (lambda spark, sf_dir: relational.table_stats(_table(spark, sf_dir, "nation")), "SELECT * FROM (SELECT 'n_nationkey' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT n_nationkey) AS ndv FROM nation UNION ALL SELECT 'n_name', COUNT(*), COUNT(DISTINCT n_name) FROM nation UNION ALL SELECT 'n_regionkey', COUNT(*), COUNT(DISTINCT n_regionkey) FROM nation)"),
}

_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "cte_recursive_dedup": (_recursive_dedup, "WITH RECURSIVE r(k) AS (SELECT 0::BIGINT UNION SELECT (k * 7 + 3) % 25 FROM r) SELECT k FROM r"),
    "json_each": (_json_each, "SELECT event_id, j.key AS k, (props::JSON ->> j.key) AS v, '$.' || j.key AS path FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) j"),
    "natural_both_copies": (_natural, "SELECT n_regionkey AS a_id, n_name, r_regionkey AS b_id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "udaf_step_finalize": (lambda spark, sf_dir: tablefunc.user_aggregate_demo(_table(spark, sf_dir, "orders")), "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda s, d, q=v[0]: run_sql(s, d, q)) for k, v in _SQL.items()}
    return found | {k: v[0] for k, v in (_MORE | _DML | _STATEMENTS).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] or v[0] for k, v in _SQL.items()} | {k: v[1] for k, v in (_MORE | _DML | _STATEMENTS).items() if v[1]}
