"""SQL statements run as they are: one per category of the batch SQL surface."""

from __future__ import annotations

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
)

STATEMENTS = {
    # Outer joins keep customers without orders; money is summed as whole cents.
    "sql_joins": """
        SELECT r.r_name, n.n_name, c.c_mktsegment,
               count(DISTINCT c.c_custkey) AS customers,
               count(o.o_orderkey) AS orders,
               CAST(sum(CAST(round(coalesce(o.o_totalprice, 0) * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM region r
        JOIN nation n ON n.n_regionkey = r.r_regionkey
        JOIN customer c ON c.c_nationkey = n.n_nationkey
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus <> 'F'
        GROUP BY r.r_name, n.n_name, c.c_mktsegment
    """,
    "sql_semi_anti": """
        SELECT 'with' AS side, c_mktsegment, count(*) AS customers
        FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
        GROUP BY c_mktsegment
        UNION ALL
        SELECT 'without' AS side, c_mktsegment, count(*) AS customers
        FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
        GROUP BY c_mktsegment
    """,
    "sql_grouping_sets": """
        SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g_flag, grouping(l_linestatus) AS g_status,
               count(*) AS line_count,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
               min(l_shipdate) AS first_ship, max(l_quantity) AS max_quantity
        FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())
    """,
    # Months are folded first, so a window group is a customer's months, not its orders.
    "sql_windows": """
        WITH months AS (
            SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS ym,
                   count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
            FROM orders GROUP BY o_custkey, year(o_orderdate) * 12 + month(o_orderdate)
        )
        SELECT o_custkey, ym, cents,
               row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, ym) AS rn,
               rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS rk,
               dense_rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS drk,
               lag(cents) OVER (PARTITION BY o_custkey ORDER BY ym) AS prev_cents,
               CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY ym
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_cents,
               max(cents) OVER (PARTITION BY o_custkey ORDER BY ym
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_max
        FROM months
    """,
    "sql_setops": """
        SELECT 'both' AS side, k FROM (
            SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
            INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') a
        UNION ALL
        SELECT 'first only' AS side, k FROM (
            SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
            EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b
        UNION ALL
        SELECT 'either' AS side, k FROM (
            SELECT o_custkey AS k FROM orders UNION SELECT c_custkey AS k FROM customer) c
    """,
    "sql_topk": """
        SELECT o_orderkey, o_custkey, o_totalprice
        FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
    """,
    # Every line shipped within a year of its order's date, by range condition on an equal key.
    "sql_range_join": """
        SELECT l.l_returnflag, o.o_orderstatus, count(*) AS line_count
        FROM lineitem l JOIN orders o
          ON l.l_orderkey = o.o_orderkey
         AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL '365' DAY
        GROUP BY l.l_returnflag, o.o_orderstatus
    """,
    "sql_rollup": """
        SELECT p_brand, p_size, count(*) AS parts,
               CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM part GROUP BY ROLLUP (p_brand, p_size)
    """,
    "sql_cube": """
        SELECT event_type, dayofweek(ts) AS dow, count(*) AS n
        FROM (SELECT event_type, CAST(ts AS DATE) AS ts FROM events) e
        GROUP BY CUBE (event_type, dayofweek(ts))
    """,
    "sql_scalars": """
        SELECT p_partkey,
               upper(p_brand) AS brand_upper,
               substring(p_name, 1, 3) AS name_head,
               length(p_name) AS name_length,
               replace(p_type, ' ', '_') AS type_code,
               concat(lpad(CAST(p_size AS STRING), 4, '0'), '/', p_brand) AS size_brand,
               abs(p_size - 25) AS size_gap,
               CAST(floor(p_retailprice) AS BIGINT) AS whole_price,
               CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
               coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand_or_none,
               greatest(p_size, 20) AS size_floor,
               split(p_type, ' ')[0] AS type_head
        FROM part
    """,
    # A chain of days: each step joins the one before it, as deep as the calendar of the data goes.
    "sql_recursive": """
        WITH RECURSIVE daily AS (
            SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)
        ),
        edges AS (SELECT min(day) AS first_day, max(day) AS last_day FROM daily),
        calendar(day, last_day) AS (
            SELECT first_day, last_day FROM edges
            UNION ALL
            SELECT CAST(day + INTERVAL 1 DAY AS DATE), last_day FROM calendar WHERE day < last_day
        )
        SELECT c.day, coalesce(d.n, 0) AS events,
               sum(coalesce(d.n, 0)) OVER (ORDER BY c.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
        FROM calendar c LEFT JOIN daily d ON d.day = c.day
    """,
    # One derived table per outer row, and a scalar subquery that looks at that row.
    "sql_lateral": """
        SELECT c.c_mktsegment, n.n_name, best.orders, best.cents,
               (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers
        FROM nation n
        JOIN (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) c ON c.c_nationkey = n.n_nationkey,
        LATERAL (
            SELECT count(*) AS orders, CAST(coalesce(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents
            FROM orders o JOIN customer k ON k.c_custkey = o.o_custkey
            WHERE k.c_nationkey = n.n_nationkey AND k.c_mktsegment = c.c_mktsegment AND o.o_orderstatus = 'P'
        ) best
    """,
    "sql_pivot": """
        WITH wide AS (
            SELECT * FROM (
                SELECT o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
            PIVOT (sum(cents) FOR o_orderstatus IN ('F' AS filled, 'O' AS open, 'P' AS partial))
        )
        SELECT o_custkey, status, cents FROM wide UNPIVOT (cents FOR status IN (filled, open, partial))
    """,
    # Lists, maps and JSON of an order's lines, and dates of them.
    "sql_nested": """
        WITH baskets AS (
            SELECT l_orderkey,
                   array_sort(collect_list(struct(l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS d))) AS a
            FROM lineitem GROUP BY l_orderkey
        ),
        dated AS (SELECT *, array_min(transform(a, x -> x.d)) AS first_ship, array_max(transform(a, x -> x.d)) AS last_ship FROM baskets)
        SELECT l_orderkey,
               size(a) AS line_count,
               array_join(transform(a, x -> CAST(x.q AS STRING)), ',') AS quantities,
               aggregate(a, CAST(0 AS BIGINT), (s, x) -> s + x.q) AS total,
               size(filter(a, x -> x.q >= 25)) AS large_lines,
               exists(a, x -> x.q = 50) AS has_full_line,
               element_at(map_from_entries(transform(a, (x, i) -> struct(i, x.q))), 0) AS first_quantity,
               map_contains_key(map_from_arrays(sequence(1, size(a)), a), 3) AS has_third,
               CAST(get_json_object(to_json(named_struct('n', size(a), 'q', transform(a, x -> x.q))), '$.q[0]') AS BIGINT) AS json_first,
               datediff(last_ship, first_ship) AS days,
               add_months(first_ship, 1) AS next_month,
               last_day(first_ship) AS month_end,
               CAST(date_trunc('QUARTER', first_ship) AS DATE) AS quarter_start,
               extract(WEEK FROM first_ship) AS week
        FROM dated
    """,
}
