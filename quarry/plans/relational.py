"""Filters, joins, aggregates, windows, ordering, set operations, subqueries and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quantified, recursive, relations
from .base import by_sql, load, query

D = "CAST({} AS DECIMAL(18,2))"
EXACT = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"

by_sql("pricing_summary", f"""
SELECT l_returnflag, l_linestatus, {EXACT("l_quantity")} AS sum_qty, {EXACT("l_extendedprice")} AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""")

# predicates
by_sql("filter_predicates", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 AND (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT') AND NOT o_custkey < 50")
by_sql("like_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE '%z_z%'")
by_sql("glob_match", "SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '^Brand#[1-3].*$'", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]*'")
by_sql("regex_match", "SELECT p_partkey, p_type FROM part WHERE p_type RLIKE '^[A-M]' AND NOT p_name RLIKE '(?i)x$'", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-M]') AND NOT regexp_matches(p_name, 'x$', 'i')")
by_sql("case_buckets", "SELECT CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END AS bucket, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, count(*) AS n FROM orders GROUP BY 1, 2")
by_sql("in_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 12 AND l_linenumber NOT IN (1, 2)")
by_sql("is_distinct", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END) IS DISTINCT FROM 'F' AS d, (nullif(o_orderstatus, 'P') IS NULL) IS TRUE AS t, (nullif(o_orderstatus, 'P') = 'F') IS NOT TRUE AS u FROM orders")
by_sql("int_arithmetic", "SELECT p_partkey, CAST(p_partkey div nullif(p_size - 10, 0) AS BIGINT) AS quot, CAST(try_mod(p_partkey, p_size - 10) AS BIGINT) AS rest, CAST(-p_partkey + 3 * 2 AS BIGINT) AS neg, try_divide(p_retailprice, p_size - 10) AS ratio FROM part",
       "SELECT p_partkey, CAST(p_partkey // nullif(p_size - 10, 0) AS BIGINT) AS quot, CAST(p_partkey % nullif(p_size - 10, 0) AS BIGINT) AS rest, CAST(-p_partkey + 3 * 2 AS BIGINT) AS neg, p_retailprice / nullif(p_size - 10, 0) AS ratio FROM part")
by_sql("bitwise_ops", "SELECT p_partkey, (p_partkey & 12) AS a, (p_partkey | 5) AS o, ~p_partkey AS n, CASE WHEN p_size >= 64 THEN 0L ELSE shiftleft(p_partkey, p_size % 20) END AS l, shiftright(p_partkey, 2) AS r FROM part",
       "SELECT p_partkey, (p_partkey & 12) AS a, (p_partkey | 5) AS o, ~p_partkey AS n, CASE WHEN p_size >= 64 THEN 0::BIGINT ELSE p_partkey << (p_size % 20) END AS l, p_partkey >> 2 AS r FROM part")
by_sql("casts", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS STRING) AS DOUBLE) AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS t, CAST(o_orderkey % 2 AS BOOLEAN) AS odd, try_cast(o_orderpriority AS DOUBLE) AS nothing FROM orders",
       "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderkey % 2 AS BOOLEAN) AS odd, try_cast(o_orderpriority AS DOUBLE) AS nothing FROM orders")
by_sql("concat_operator", "SELECT c_custkey, c_name || '-' || c_nationkey || ':' || nullif(c_mktsegment, 'BUILDING') AS label FROM customer")

# joins
by_sql("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000")
by_sql("join_left", f"SELECT c_custkey, count(o_orderkey) AS n, {EXACT('o_totalprice')} AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
by_sql("join_right", "SELECT o_orderkey, s_name, r_name FROM supplier RIGHT JOIN orders ON o_custkey = s_suppkey LEFT JOIN region ON r_regionkey = o_orderkey % 7")
by_sql("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey")
by_sql("join_cross", "SELECT a.r_name AS left_name, b.n_name AS right_name FROM region a CROSS JOIN nation b")

@query("SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal <= a.s_acctbal + 100")
def join_theta_band(spark, sf_dir):
    """The balances above, up to 100."""
    s = load(spark, sf_dir, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("low"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("high"), F.col("s_acctbal").alias("y"))
    return relations.band(a, b, "x", "y", 100.0).select("low", "high")


by_sql("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
by_sql("join_nullsafe", "SELECT a.o_orderkey AS a_key, b.r_regionkey AS b_key FROM (SELECT o_orderkey, nullif(o_orderkey % 6, 5) AS k FROM orders) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 4) AS k FROM region) b ON a.k <=> b.k",
       "SELECT a.o_orderkey AS a_key, b.r_regionkey AS b_key FROM (SELECT o_orderkey, nullif(o_orderkey % 6, 5) AS k FROM orders) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 4) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
by_sql("join_numeric_text", "SELECT n_name, t.s FROM nation JOIN (SELECT concat('0', r_regionkey) AS s FROM region UNION ALL SELECT r_name FROM region) t ON try_cast(t.s AS DOUBLE) = n_nationkey",
       "SELECT n_name, t.s FROM nation JOIN (SELECT concat('0', r_regionkey) AS s FROM region UNION ALL SELECT r_name FROM region) t ON try_cast(t.s AS DOUBLE) = n_nationkey")


@query("SELECT a.k AS k, a.v AS v, b.w AS w FROM (SELECT c_custkey AS k, c_name AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_name AS w FROM supplier) b ON a.k = b.k")
def join_using(spark, sf_dir):
    """The key of USING stays the left side's, null where only the right side has a row."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("w"))
    return relations.join_using(a, b, ["k"], "full")


by_sql("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
by_sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
by_sql("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
by_sql("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT nullif(r_regionkey, 9) FROM region)")

# aggregates
by_sql("agg_basic", f"SELECT event_type, count(*) AS n, count(value) AS nv, {EXACT('value')} AS total, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(event_id) AS last_id, min(event_type) AS t FROM events GROUP BY event_type")
by_sql("agg_sum_int", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_orderkey) AS BIGINT) AS k FROM lineitem")
by_sql("agg_stddev_var", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag")
by_sql("agg_single_sample", "SELECT n_nationkey, stddev_samp(n_regionkey) AS sd, var_samp(n_regionkey) AS v, stddev_pop(n_regionkey) AS sdp FROM nation GROUP BY n_nationkey")
by_sql("agg_bool", "SELECT o_orderstatus, bool_and(o_totalprice > 900) AS all_over, bool_or(o_totalprice > 400000) AS any_over FROM orders GROUP BY o_orderstatus")
by_sql("agg_total", "SELECT n_regionkey, coalesce(sum(CAST(n_nationkey AS DOUBLE)) FILTER (WHERE n_nationkey > 20), CAST(0 AS DOUBLE)) AS total FROM nation GROUP BY n_regionkey")
by_sql("agg_string", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ', ') AS names, array_join(array_sort(collect_set(substr(n_name, 1, 1))), '') AS initials FROM nation GROUP BY n_regionkey",
       "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(DISTINCT substr(n_name, 1, 1), '' ORDER BY substr(n_name, 1, 1)) AS initials FROM nation GROUP BY n_regionkey")
by_sql("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total, round(avg(DISTINCT o_custkey), 6) AS mean FROM orders GROUP BY o_orderpriority")
by_sql("agg_filter", f"SELECT event_type, count(*) FILTER (WHERE value > 50) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) AS s, max(event_id) FILTER (WHERE value IS NULL) AS m FROM events GROUP BY event_type")
by_sql("agg_global_empty", "SELECT count(*) AS n, sum(value) AS s, max(event_type) AS m FROM events WHERE event_id < 0")
by_sql("group_expr_alias", "SELECT o_custkey % 10 AS bucket, upper(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY bucket, 2")
by_sql("having_filter", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3 AND max(o_totalprice) > 1000")
by_sql("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
by_sql("group_first_row", "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n FROM orders GROUP BY o_custkey")

# windows
W = "(PARTITION BY o_custkey ORDER BY o_orderkey)"
by_sql("win_ranking", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
by_sql("win_ntile_dist", "SELECT o_orderkey, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS nt, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS pr, cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS cd FROM orders")
by_sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER {W} AS prev, lag(o_orderstatus, 2, 'none') OVER {W} AS prev2, lead(o_orderkey, 1) OVER {W} AS nxt FROM orders")
by_sql("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER {W} AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER {W} AS second FROM orders")
by_sql("win_running_sum", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER {W} AS DOUBLE) AS running, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders")
by_sql("win_moving_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS earlier FROM orders")

@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM events WHERE value IS NOT NULL")
def win_range_offset(spark, sf_dir):
    """Each count from frames that only grow, which Spark fills in one pass: others are filled anew for every row.

    All rows of a user are at most ``value + 5`` or at least ``value - 5``, and the near ones are both.
    """
    rows = load(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", "user_id", "event_type", "value")
    # the few types would each be one task of all their rows: their windows go over users
    users = rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("event_type").orderBy(F.col("user_id").desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    users = users.select(F.col("event_type").alias("_type"), F.col("user_id").alias("_user"), F.sum("n").over(after).alias("rest"))
    user = Window.partitionBy("user_id")
    below = F.count(F.lit(1)).over(user.orderBy("value").rangeBetween(Window.unboundedPreceding, 5))
    above = F.count(F.lit(1)).over(user.orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, 5))
    near = rows.select("event_id", "user_id", "event_type", (below + above - F.count(F.lit(1)).over(user)).alias("near"))
    same = F.col("event_type").eqNullSafe(F.col("_type")) & F.col("user_id").eqNullSafe(F.col("_user"))
    return near.join(users, same).select("event_id", "near", "rest")


by_sql("win_groups_as_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
by_sql("win_over_group", "SELECT o_custkey, CAST(rank() OVER (ORDER BY count(*) DESC, o_custkey) AS BIGINT) AS rk, count(*) AS n FROM orders GROUP BY o_custkey")
by_sql("win_string_agg", "SELECT n_name, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '+') AS upto FROM nation", "SELECT n_name, string_agg(n_name, '+') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS upto FROM nation")
by_sql("win_filter", f"SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER {W} AS done FROM orders", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER {W} AS done FROM orders")


@query("SELECT o_orderkey, lag(o_orderkey, CAST(o_orderkey % 3 AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders")
def win_lag_by_row(spark, sf_dir):
    """An offset that differs by row joins each row to the one at that place."""
    return relations.lag_by(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", F.col("o_orderkey") % 3, "back").select("o_orderkey", "back")


# order, limits
by_sql("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
by_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
by_sql("nulls_order", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey LIMIT 30")
by_sql("distinct_order_hidden", "SELECT c_mktsegment FROM (SELECT c_mktsegment, min(c_acctbal) AS least FROM customer GROUP BY c_mktsegment) t ORDER BY least LIMIT 3")

# set operations
A, B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
for name, op in (("union_distinct", "UNION"), ("union_all", "UNION ALL"), ("intersect_distinct", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except_distinct", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    by_sql(name, f"({A}) {op} ({B})")
by_sql("setop_left_assoc", f"(({A}) UNION ({B})) INTERSECT (SELECT r_regionkey AS k FROM region)")

# subqueries
by_sql("scalar_subquery", "SELECT o_orderkey, (SELECT max(c_acctbal) FROM customer) AS top, (SELECT n_name FROM nation WHERE n_nationkey = -1) AS nothing FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
by_sql("correlated_avg", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
by_sql("derived_table", "SELECT t.status, t.n FROM (SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus) AS t(status, n)")
by_sql("cte_multi", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000), c(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT c_name, n FROM c JOIN customer ON c_custkey = k")
by_sql("values_source", "SELECT column1, column2, r_name FROM (VALUES (1, 'x'), (2, 'y'), (9, NULL)) AS v(column1, column2) LEFT JOIN region ON r_regionkey = column1")
by_sql("select_no_from", "SELECT 1 AS one, 'a' AS a, CAST(NULL AS STRING) AS n")
by_sql("array_any", "SELECT n_nationkey FROM nation WHERE array_contains(array(1, 3, 5), n_regionkey) AND NOT array_contains(array(2, 3), n_nationkey)", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY([1, 3, 5]) AND NOT list_contains([2, 3], n_nationkey)")


@query("SELECT s_suppkey, s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey) AS hit FROM supplier")
def quantified_all(spark, sf_dir):
    """``x > ALL (subquery)``, true over an empty one, null where a null leaves it open."""
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    return quantified.quantified(s, c, {"s_nationkey": "c_nationkey"}, s.s_acctbal, ">", c.c_acctbal, "all", "hit").select("s_suppkey", "hit")


@query("SELECT s_suppkey, s_acctbal < ANY (SELECT nullif(c_acctbal, 0) FROM customer WHERE c_nationkey = s_nationkey) AS hit FROM supplier")
def quantified_any(spark, sf_dir):
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer").withColumn("v", F.expr("nullif(c_acctbal, 0)"))
    return quantified.quantified(s, c, {"s_nationkey": "c_nationkey"}, s.s_acctbal, "<", c.v, "any", "hit").select("s_suppkey", "hit")


# recursion, series, rows from arrays
by_sql("generate_series", "SELECT id AS g FROM range(3, 1001, 7)", "SELECT generate_series AS g FROM generate_series(3, 1000, 7)")
by_sql("unnest_ordinality", "SELECT doc_id, word, CAST(pos + 1 AS BIGINT) AS ordinality FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, word) FROM documents)",
       "SELECT doc_id, unnest(str_split(text, ' ')) AS word, CAST(generate_subscripts(str_split(text, ' '), 1) AS BIGINT) AS ordinality FROM documents")
by_sql("recursive_series", "WITH RECURSIVE s(n) AS (SELECT 1L UNION ALL SELECT n + 3 FROM s WHERE n < 200) SELECT n FROM s", "WITH RECURSIVE s(n) AS (SELECT 1::BIGINT UNION ALL SELECT n + 3 FROM s WHERE n < 200) SELECT n FROM s")


@query("WITH RECURSIVE r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT o_orderkey FROM r JOIN orders ON o_custkey = r.node) SELECT node FROM r")
def recursive_reachability(spark, sf_dir):
    """Recursive UNION: rounds of the frontier against all that was seen, until nothing is new."""
    edges = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    start = spark.range(1, 2).toDF("node")
    return recursive.union_fixpoint(start, lambda f: f.join(edges, f.node == edges.src).select(F.col("dst").alias("node")))


@query("WITH RECURSIVE h AS (SELECT n_nationkey AS id, n_nationkey // 3 AS boss FROM nation), r(id, depth) AS (SELECT id, CAST(0 AS BIGINT) FROM h WHERE id = 1 UNION ALL SELECT h.id, depth + 1 FROM h JOIN r ON h.boss = r.id AND h.id <> r.id) SELECT id, depth FROM r")
def recursive_hierarchy(spark, sf_dir):
    h = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CAST(n_nationkey div 3 AS INT) AS boss")
    h.createOrReplaceTempView("h")
    return spark.sql("WITH RECURSIVE r(id, depth) AS (SELECT id, 0L FROM h WHERE id = 1 UNION ALL SELECT h.id, depth + 1 FROM h JOIN r ON h.boss = r.id AND h.id <> r.id) SELECT id, depth FROM r")


by_sql("json_each_rows", "SELECT event_id, key, CAST(value AS BIGINT) AS value FROM (SELECT event_id, explode(from_json(props, 'map<string,string>')) AS (key, value) FROM events)",
       "SELECT event_id, k AS key, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
by_sql("point_and_multi_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, 99, 1200) OR o_orderkey = 5")
by_sql("range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 400")
