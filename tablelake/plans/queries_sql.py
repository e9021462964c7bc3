"""Open SQL surface: each statement passes the read-only gate and runs whole.

Windows run over rows already aggregated to a bounded number per group, or
over time blocks, so that no statement hands one hot key's rows to one task.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.operators.exact import exact_percentiles, except_all, intersect_all
from tablelake.plans.registry import query
from tablelake.plans.sqlgate import run_sql


def statement(name: str, spark_sql: str, other: str | None = None) -> None:
    @query(name, other or spark_sql)
    def build(tables, text=spark_sql):
        tables.register(text)
        return run_sql(tables.spark, text, cap=None)


CAPPED = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey"""


@query("sql_capped", f"""
SELECT *, CASE WHEN n_fetched > 500 THEN 1 ELSE 0 END AS truncated FROM (
  SELECT *, CAST(count(*) OVER () AS BIGINT) AS n_fetched,
         CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS position
  FROM (SELECT * FROM ({CAPPED}) LIMIT 501)) WHERE position <= 500""")
def sql_capped(tables):
    tables.register(CAPPED)
    fetched = run_sql(tables.spark, CAPPED)
    # At most 501 rows are left here, so one window over all of them is small.
    everything = Window.partitionBy(F.lit(0))
    return (
        fetched.withColumn("n_fetched", F.count(F.lit(1)).over(everything))
        .withColumn("position", F.row_number().over(everything.orderBy(F.desc("o_totalprice"), "o_orderkey")))
        .where("position <= 500")
        .withColumn("truncated", F.when(F.col("n_fetched") > 500, 1).otherwise(0))
    )


statement("p_filter_project", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0.02 THEN 'mid' ELSE 'low' END AS discount_band,
       coalesce(nullif(l_returnflag, 'N'), 'none') AS flag
FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'N') AND l_linestatus LIKE 'F%'
  AND lower(l_returnflag) NOT LIKE '%r%'""")

statement("p_join_inner", """
SELECT n.n_name, CAST(year(o.o_orderdate) AS INT) AS order_year, count(*) AS n_lines,
       CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_name, year(o.o_orderdate)""")

statement("p_join_outer", """
WITH spend AS (
  SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
rich AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000),
f AS (SELECT coalesce(c_mktsegment, 'none') AS segment, c_custkey, o_custkey, n_orders
      FROM rich FULL OUTER JOIN spend ON c_custkey = o_custkey),
l AS (SELECT c_custkey, n_orders FROM rich LEFT JOIN spend ON c_custkey = o_custkey),
r AS (SELECT c_custkey, o_custkey FROM rich RIGHT JOIN spend ON c_custkey = o_custkey)
SELECT segment, count(*) AS n_rows, count(c_custkey) AS n_left, count(o_custkey) AS n_right,
       CAST(coalesce(sum(n_orders), 0) AS BIGINT) AS n_orders,
       (SELECT count(*) FROM l WHERE n_orders IS NULL) AS left_unmatched,
       (SELECT count(*) FROM r WHERE c_custkey IS NULL) AS right_unmatched
FROM f GROUP BY segment""")

statement("p_semi_anti", """
SELECT c_mktsegment,
       count(*) AS n_customers,
       CAST(sum(CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) THEN 1 ELSE 0 END) AS BIGINT) AS n_near
FROM customer c
WHERE EXISTS (SELECT 1 FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o
              WHERE o.o_custkey = c.c_custkey)
  AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) o
                  WHERE o.o_custkey = c.c_custkey AND o.top > 480000)
GROUP BY c_mktsegment""")

statement("p_join_range", """
WITH bands AS (
  SELECT 0 AS bucket, 0 AS lo, 50000 AS hi, 'low' AS band UNION ALL
  SELECT 0, 50000, 100000, 'medium' UNION ALL SELECT 1, 100000, 200000, 'upper' UNION ALL
  SELECT 2, 200000, 300000, 'high' UNION ALL SELECT 3, 300000, 400000, 'higher' UNION ALL
  SELECT 4, 400000, 500000, 'highest')
SELECT b.band, o.o_orderstatus, count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders o JOIN bands b
  ON b.bucket = floor(o.o_totalprice / 100000) AND o.o_totalprice >= b.lo AND o.o_totalprice < b.hi
GROUP BY b.band, o.o_orderstatus""")

statement("p_yoy", """
WITH y AS (
  SELECT c.c_nationkey, CAST(year(o.o_orderdate) AS INT) AS order_year,
         sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  GROUP BY c.c_nationkey, year(o.o_orderdate))
SELECT a.c_nationkey, b.order_year, CAST(a.total AS DOUBLE) AS previous, CAST(b.total AS DOUBLE) AS total,
       CAST(b.total - a.total AS DOUBLE) AS change
FROM y a JOIN y b ON b.c_nationkey = a.c_nationkey AND b.order_year = a.order_year + 1""")

statement("p_asof", """
WITH e AS (
  SELECT user_id, event_id, event_type, ts, date_trunc('HOUR', ts) AS hr
  FROM events WHERE event_type IN ('view', 'purchase')),
near AS (
  SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (
    PARTITION BY user_id, hr ORDER BY ts, event_type DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e),
ends AS (
  SELECT user_id, hr, max(CASE WHEN event_type = 'view' THEN ts END) AS seen FROM e GROUP BY user_id, hr),
carried AS (
  SELECT user_id, hr, max(seen) OVER (
    PARTITION BY user_id ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ends)
SELECT near.event_id, near.user_id,
       CAST(coalesce(near.seen, carried.seen) AS STRING) AS last_view
FROM near JOIN carried ON near.user_id = carried.user_id AND near.hr = carried.hr
WHERE near.event_type = 'purchase' AND coalesce(near.seen, carried.seen) IS NOT NULL""", """
SELECT event_id, user_id, CAST(last_view AS VARCHAR) AS last_view FROM (
  SELECT p.event_id, p.user_id,
    (SELECT max(v.ts) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS last_view
  FROM events p WHERE p.event_type = 'purchase') WHERE last_view IS NOT NULL""")

statement("p_group_having", """
SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INT) AS ship_year, count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc_price,
       CAST(round(avg(l_quantity), 6) AS DOUBLE) AS avg_qty, min(l_discount) AS min_disc, max(l_tax) AS max_tax
FROM lineitem
GROUP BY l_returnflag, l_linestatus, year(l_shipdate) HAVING count(*) > 10""")

statement("p_distinct", """
SELECT o_orderstatus, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       count(DISTINCT o_orderpriority) AS n_priorities
FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderpriority, o_orderdate FROM orders) d
GROUP BY o_orderstatus""")

statement("p_agg_filter", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS pending_total
FROM orders GROUP BY o_orderpriority""")

statement("p_grouping_sets", """
SELECT coalesce(r_name, 'all') AS region_name, coalesce(order_year, 'all') AS order_year,
       count(*) AS n_orders, CAST(sum(price) AS DOUBLE) AS total, CAST(grouping(r_name) AS INT) AS all_regions
FROM (SELECT r.r_name, CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) AS order_year,
             CAST(o.o_totalprice AS DECIMAL(18,2)) AS price
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey) d
GROUP BY CUBE (r_name, order_year)""")

_SPREAD = """
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd_bal, round(var_pop(c_acctbal), 2) AS var_bal,
       round(corr(c_acctbal, c_nationkey), 6) AS corr_nation
FROM customer GROUP BY c_mktsegment"""


@query("p_stats", f"""
SELECT s.*, m.median_bal, m.p90_bal FROM ({_SPREAD}) s JOIN (
  SELECT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS median_bal,
         round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90_bal
  FROM customer GROUP BY c_mktsegment) m ON m.c_mktsegment = s.c_mktsegment""")
def p_stats(tables):
    """Moments by SQL; exact percentiles by counting, as SQL would hold a segment's balances in one buffer."""
    tables.register(_SPREAD)
    ranks = exact_percentiles(tables.customer, "c_mktsegment", "c_acctbal", {"median_bal": 0.5, "p90_bal": 0.9})
    return run_sql(tables.spark, _SPREAD, cap=None).join(ranks, "c_mktsegment").withColumns({c: F.round(c, 4) for c in ("median_bal", "p90_bal")})


statement("p_string_agg", """
SELECT region_name, string_agg(label, ', ') WITHIN GROUP (ORDER BY label) AS labels
FROM (SELECT DISTINCT r.r_name AS region_name, n.n_name || '/' || c.c_mktsegment AS label
      FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey) d
GROUP BY region_name""", """
SELECT region_name, string_agg(label, ', ' ORDER BY label) AS labels
FROM (SELECT DISTINCT r.r_name AS region_name, n.n_name || '/' || c.c_mktsegment AS label
      FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey) d
GROUP BY region_name""")

statement("p_rank_windows", """
WITH m AS (
  SELECT c.c_nationkey, CAST(year(o.o_orderdate) AS INT) AS y, CAST(month(o.o_orderdate) AS INT) AS mon,
         count(*) AS n, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  GROUP BY c.c_nationkey, year(o.o_orderdate), month(o.o_orderdate))
SELECT c_nationkey, y, mon,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, y, mon) AS INT) AS rn,
       CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS INT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS INT) AS drk,
       CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY total DESC, y, mon) AS INT) AS quarter,
       round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY total), 6) AS prank
FROM m""")

statement("p_analytic_windows", """
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, CAST(day AS STRING) AS day, n, v,
       CAST(coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY day), -1) AS BIGINT) AS previous_n,
       CAST(coalesce(lead(n) OVER (PARTITION BY user_id ORDER BY day), -1) AS BIGINT) AS next_n,
       first_value(v) OVER (PARTITION BY user_id ORDER BY day) AS first_v,
       last_value(v) OVER (PARTITION BY user_id ORDER BY day
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v
FROM d""")

_FRAMES = """
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, CAST(day AS STRING) AS day,
       CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three,
       CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day
                         RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS two_days
FROM d"""
statement("p_frames", _FRAMES)

statement("p_topk", """
SELECT 'per customer' AS kind, o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) t WHERE rn <= 3
UNION ALL
SELECT 'overall', o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5) u""")

statement("p_set_ops", """
SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier) a
UNION ALL
SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier) b
UNION ALL
SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) c
UNION ALL
SELECT 'intersect all', k FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer) d
UNION ALL
SELECT 'except all', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) e""")

@query("p_bag_ops", """
SELECT 'intersect all' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) d
UNION ALL
SELECT 'except all', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) e""")
def p_bag_ops(tables):
    """Bag operations on keys with very many copies."""
    left, right = tables.customer.select(F.col("c_nationkey").alias("k")), tables.supplier.select(F.col("s_nationkey").alias("k"))
    both = intersect_all(left, right).withColumn("op", F.lit("intersect all"))
    return both.unionByName(except_all(left, right).withColumn("op", F.lit("except all")))


statement("p_subqueries", """
WITH priced AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT p.o_orderkey, p.o_custkey, CAST(p.price AS DOUBLE) AS price
FROM priced p
WHERE p.price * (SELECT count(*) FROM priced q WHERE q.o_custkey = p.o_custkey)
      > (SELECT sum(r.price) FROM priced r WHERE r.o_custkey = p.o_custkey) * 2
  AND p.price > (SELECT min(price) FROM priced) * 10""")

statement("p_recursive", """
WITH RECURSIVE years (y) AS (
  SELECT 1994 UNION ALL SELECT y + 1 FROM years WHERE y < 2003)
SELECT y, coalesce(o.n, 0) AS n_orders
FROM years LEFT JOIN (SELECT CAST(year(o_orderdate) AS INT) AS order_year, count(*) AS n FROM orders
                      GROUP BY CAST(year(o_orderdate) AS INT)) o ON o.order_year = y""")

statement("p_strings", r"""
SELECT p_partkey, upper(p_name) AS upper_name, initcap(p_name) AS title_name, length(p_name) AS n_chars,
       split_part(p_brand, '#', 2) AS brand_no, substring(p_type, 1, 3) AS type_prefix,
       regexp_replace(p_name, '[aeiou]', '*') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
       p_brand || '/' || p_type AS path, trim(concat('  ', p_name, ' ')) AS trimmed,
       lpad(CAST(p_size AS STRING), 4, '0') AS padded, reverse(p_brand) AS reversed,
       replace(p_type, 'A', '@') AS replaced, position('i' IN p_name) AS i_at
FROM part""", r"""
SELECT p_partkey, upper(p_name) AS upper_name,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title_name,
       CAST(length(p_name) AS INT) AS n_chars,
       split_part(p_brand, '#', 2) AS brand_no, substring(p_type, 1, 3) AS type_prefix,
       regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
       p_brand || '/' || p_type AS path, trim(concat('  ', p_name, ' ')) AS trimmed,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, reverse(p_brand) AS reversed,
       replace(p_type, 'A', '@') AS replaced, CAST(position('i' IN p_name) AS INT) AS i_at
FROM part""")

statement("p_dates", """
SELECT CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS month_start,
       CAST(extract(QUARTER FROM o_orderdate) AS INT) AS quarter, count(*) AS n_orders,
       CAST(min(o_orderdate + INTERVAL '7' DAY) AS STRING) AS first_due,
       CAST(max(extract(DAY FROM o_orderdate)) AS INT) AS last_day,
       CAST(sum(datediff(o_orderdate, TIMESTAMP '1995-01-01 00:00:00')) AS BIGINT) AS days
FROM orders GROUP BY date_trunc('MONTH', o_orderdate), extract(QUARTER FROM o_orderdate)""", """
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start,
       CAST(extract(QUARTER FROM o_orderdate) AS INT) AS quarter, count(*) AS n_orders,
       CAST(min(o_orderdate + INTERVAL 7 DAY) AS VARCHAR) AS first_due,
       CAST(max(extract(DAY FROM o_orderdate)) AS INT) AS last_day,
       CAST(sum(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)) AS BIGINT) AS days
FROM orders GROUP BY ALL""")

statement("p_math", """
SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS seventh, l_orderkey % 7 AS rest,
       round(l_extendedprice / 7, 3) AS part_price, CAST(floor(l_quantity / 4) AS BIGINT) AS fours,
       CAST(ceil(l_tax * 10) AS BIGINT) AS tax_up, abs(l_discount - 0.05) AS off_mid, sign(l_discount - 0.05) AS side,
       round(coalesce(try_divide(l_tax, l_discount), -1), 6) AS tax_ratio, round(sqrt(l_quantity), 6) AS root,
       round(power(l_discount, 2), 6) AS squared, greatest(l_tax, l_discount) AS larger
FROM lineitem""", """
SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS seventh, l_orderkey % 7 AS rest,
       round(l_extendedprice / 7, 3) AS part_price, CAST(floor(l_quantity / 4) AS BIGINT) AS fours,
       CAST(ceil(l_tax * 10) AS BIGINT) AS tax_up, abs(l_discount - 0.05) AS off_mid,
       CAST(sign(l_discount - 0.05) AS DOUBLE) AS side,
       round(coalesce(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, -1), 6) AS tax_ratio,
       round(sqrt(l_quantity), 6) AS root, round(power(l_discount, 2), 6) AS squared, greatest(l_tax, l_discount) AS larger
FROM lineitem""")

statement("p_json", """
SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n
FROM events GROUP BY event_type, CAST(get_json_object(props, '$.k') AS INT)""", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n
FROM events GROUP BY ALL""")

statement("p_arrays", """
SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT lang, doc_id, explode(split(text, ' ')) AS word FROM documents) w
WHERE length(word) > 2 GROUP BY lang, word""", """
SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT lang, doc_id, unnest(string_split(text, ' ')) AS word FROM documents) w
WHERE length(word) > 2 GROUP BY lang, word""")

statement("p_pivot", """
SELECT * FROM (SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS y FROM orders)
PIVOT (count(*) FOR y IN (1995 AS y1995, 1996 AS y1996, 1997 AS y1997, 1998 AS y1998, 1999 AS y1999, 2000 AS y2000, 2001 AS y2001))""", """
SELECT o_orderpriority, count(*) FILTER (WHERE y = 1995) AS y1995, count(*) FILTER (WHERE y = 1996) AS y1996,
       count(*) FILTER (WHERE y = 1997) AS y1997, count(*) FILTER (WHERE y = 1998) AS y1998,
       count(*) FILTER (WHERE y = 1999) AS y1999, count(*) FILTER (WHERE y = 2000) AS y2000, count(*) FILTER (WHERE y = 2001) AS y2001
FROM (SELECT o_orderpriority, year(o_orderdate) AS y FROM orders) GROUP BY o_orderpriority""")

statement("p_rates", """
WITH cohort AS (SELECT user_id, min(CAST(ts AS DATE)) AS joined FROM events GROUP BY user_id)
SELECT CAST(c.joined AS STRING) AS joined, count(*) AS n_events,
       count(*) FILTER (WHERE e.event_type = 'view') AS n_views,
       count(*) FILTER (WHERE e.event_type = 'purchase') AS n_purchases,
       round(coalesce(try_divide(count(*) FILTER (WHERE e.event_type = 'purchase'),
                                 count(*) FILTER (WHERE e.event_type = 'view')), 0), 6) AS rate
FROM events e JOIN cohort c ON c.user_id = e.user_id GROUP BY c.joined""", """
WITH cohort AS (SELECT user_id, min(CAST(ts AS DATE)) AS joined FROM events GROUP BY user_id),
s AS (SELECT c.joined, count(*) AS n_events, count(*) FILTER (WHERE e.event_type = 'view') AS n_views,
             count(*) FILTER (WHERE e.event_type = 'purchase') AS n_purchases
      FROM events e JOIN cohort c ON c.user_id = e.user_id GROUP BY c.joined)
SELECT CAST(joined AS VARCHAR) AS joined, n_events, n_views, n_purchases,
       round(CASE WHEN n_views = 0 THEN 0 ELSE n_purchases / n_views END, 6) AS rate FROM s""")

statement("p_shares", """
WITH s AS (SELECT l_returnflag, l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
           FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, CAST(total AS DOUBLE) AS total,
       round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 6) AS share,
       round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) AS share_in_flag
FROM s""")

statement("p_code_rollup", """
SELECT substring(p.p_brand, 1, 7) AS brand_group, substring(p.p_type, 1, 2) AS type_group,
       count(*) AS n_lines, count(DISTINCT p.p_type) AS n_types,
       CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY substring(p.p_brand, 1, 7), substring(p.p_type, 1, 2)""")

statement("p_form_switch", """
SELECT role, nation_name, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM (
  SELECT 'customer' AS role, n_name AS nation_name,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE -c_acctbal END AS amount
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL
  SELECT 'supplier', n_name, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END
  FROM supplier JOIN nation ON n_nationkey = s_nationkey) f
GROUP BY role, nation_name""")


@query("entity_attributes", """
SELECT o.o_orderkey, o.o_orderstatus, c.c_name, c.c_mktsegment, n.n_name
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def entity_attributes(tables):
    from tablelake.operators.catalog import with_attributes

    placed = with_attributes(tables.customer, tables.nation, "c_nationkey", "n_nationkey")
    return with_attributes(tables.orders, placed, "o_custkey", "c_custkey").select(
        "o_orderkey", "o_orderstatus", "c_name", "c_mktsegment", "n_name")
