"""The queries' SQL counterparts, run by DuckDB over the same tables.

Written apart from the Spark expressions: staging in SQL, parsing by pattern
and TRY_CAST, ordering by recursive paths.
"""

from __future__ import annotations

_RAW_ORDERS = """
raw_orders AS (
  SELECT o_orderkey + 2 AS row_number,
    CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE WHEN o_orderkey % 23 = 0 THEN '   ' ELSE c_name END AS customer_name,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL
         WHEN o_orderkey % 5 = 0 THEN ' ' || lower(r_name) || ' ' ELSE r_name END AS region,
    o_orderpriority AS product,
    CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN '-1' WHEN 3 THEN '0'
         WHEN 4 THEN 'abc' WHEN 5 THEN 'nan' WHEN 6 THEN '2.5'
         WHEN 7 THEN ' ' || CAST(o_orderkey % 50 + 1 AS VARCHAR) || ' '
         ELSE CAST(o_orderkey % 50 + 1 AS VARCHAR) END AS quantity,
    CASE o_orderkey % 17 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-3.5'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS unit_price,
    CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS order_date
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

_PARSED = (
    _RAW_ORDERS
    + """,
words AS (
  SELECT *,
    array_to_string(list_transform(regexp_extract_all(lower(trim(customer_name)), '[a-z]+|[^a-z]+'),
      lambda w: upper(w[1]) || w[2:]), '') AS customer_title,
    array_to_string(list_transform(regexp_extract_all(lower(trim(region)), '[a-z]+|[^a-z]+'),
      lambda w: upper(w[1]) || w[2:]), '') AS region_title,
    array_to_string(list_transform(regexp_extract_all(lower(trim(product)), '[a-z]+|[^a-z]+'),
      lambda w: upper(w[1]) || w[2:]), '') AS product_title,
    CASE WHEN regexp_full_match(trim(quantity), '[+-]?[0-9]+')
         THEN TRY_CAST(trim(quantity) AS BIGINT) END AS q,
    CASE WHEN regexp_full_match(trim(unit_price), '[+-]?[0-9]+(\\.[0-9]*)?')
         THEN TRY_CAST(trim(unit_price) AS DECIMAL(18,2)) END AS p,
    CASE WHEN regexp_full_match(trim(order_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}')
         THEN TRY_CAST(trim(order_date) AS DATE) END AS d,
    CASE WHEN regexp_full_match(trim(quantity), '[+-]?[0-9]+(\\.[0-9]*)?')
          AND CAST(trim(quantity) AS DOUBLE) > 0 THEN CAST(trim(quantity) AS DOUBLE) END AS q_pos,
    CASE WHEN regexp_full_match(trim(unit_price), '[+-]?[0-9]+(\\.[0-9]*)?')
          AND CAST(trim(unit_price) AS DOUBLE) > 0 THEN CAST(trim(unit_price) AS DOUBLE) END AS p_pos
  FROM raw_orders
),
clean AS (
  SELECT row_number, trim(order_id) AS order_id, customer_title AS customer_name,
    coalesce(region_title, '') AS region, product_title AS product, d AS order_date, q AS quantity,
    p AS unit_price, CAST(q * p AS DECIMAL(18,2)) AS order_value
  FROM words WHERE q IS NOT NULL AND p IS NOT NULL AND d IS NOT NULL
),
flags AS (
  SELECT row_number, unnest([
    {'o': 0, 'c': 'order_id', 'r': 'required', 'bad': coalesce(trim(order_id), '') = ''},
    {'o': 1, 'c': 'customer_name', 'r': 'required', 'bad': coalesce(trim(customer_name), '') = ''},
    {'o': 2, 'c': 'region', 'r': 'required', 'bad': coalesce(trim(region), '') = ''},
    {'o': 3, 'c': 'product', 'r': 'required', 'bad': coalesce(trim(product), '') = ''},
    {'o': 4, 'c': 'quantity', 'r': 'required', 'bad': coalesce(trim(quantity), '') = ''},
    {'o': 5, 'c': 'unit_price', 'r': 'required', 'bad': coalesce(trim(unit_price), '') = ''},
    {'o': 6, 'c': 'order_date', 'r': 'required', 'bad': coalesce(trim(order_date), '') = ''},
    {'o': 7, 'c': 'quantity', 'r': 'positive', 'bad': q_pos IS NULL},
    {'o': 8, 'c': 'unit_price', 'r': 'positive', 'bad': p_pos IS NULL}]) AS f
  FROM words
),
issues AS (
  SELECT row_number, CAST(f.o AS INTEGER) AS rule_order, f.c AS column_name, f.r AS rule,
    'row ' || row_number || ': ' || CASE f.r WHEN 'required' THEN 'missing ' || f.c
      ELSE f.c || ' must be positive' END AS message
  FROM flags WHERE f.bad
)"""
)

_SALES = """
sales AS (
  SELECT l_orderkey AS order_id, r_name AS region, p_name AS product,
    CAST(o_orderdate AS DATE) AS order_date, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS order_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
by_region AS (
  SELECT region, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS units, sum(order_value) AS revenue,
    min((order_date, order_id)) AS seen
  FROM sales GROUP BY region
),
by_product AS (
  SELECT product, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS units, sum(order_value) AS revenue,
    min((order_date, order_id)) AS seen
  FROM sales GROUP BY product
),
top_region AS (SELECT * FROM by_region ORDER BY revenue DESC, seen, region LIMIT 1),
top_product AS (SELECT * FROM by_product ORDER BY revenue DESC, seen, product LIMIT 1),
totals AS (
  SELECT count(*) AS total_orders, CAST(sum(quantity) AS BIGINT) AS total_units,
    CAST(sum(order_value) AS DOUBLE) AS total_revenue,
    min(order_date) AS first_order_date, max(order_date) AS last_order_date
  FROM sales
)"""

_STAGES = """
numbered AS (
  SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS pipeline_id, CAST(p_partkey % 10 AS INTEGER) AS i FROM part
),
stages AS (
  SELECT pipeline_id, i,
    CASE WHEN pipeline_id % 2 = 1 THEN 9 - i ELSE i END AS position,
    CASE WHEN pipeline_id % 7 = 3 AND i = 5 THEN 'stage_4' ELSE 'stage_' || i END AS name,
    CASE WHEN i = 0 THEN '' WHEN i <= 2 THEN ' stage_0 '
         ELSE 'stage_' || (i-2) || ', stage_' || (i-3) || ',,stage_' || (i-2) END
    || CASE WHEN pipeline_id % 7 = 2 AND i = 9 THEN ',ghost' ELSE '' END
    || CASE WHEN pipeline_id % 7 = 5 AND i = 2 THEN ',stage_6' ELSE '' END AS deps_text
  FROM numbered
),
split AS (
  SELECT pipeline_id, i, position, name, trim(unnest(string_split(deps_text, ','))) AS dependency,
    unnest(range(len(string_split(deps_text, ',')))) AS spot
  FROM stages
),
edges AS (
  SELECT pipeline_id, i, position, name, dependency, min(spot) AS spot
  FROM split WHERE dependency <> '' GROUP BY ALL
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY pipeline_id, i ORDER BY spot) - 1 AS INTEGER) AS dependency_order
  FROM edges
),
duplicates AS (
  SELECT pipeline_id, name, count(*) AS copies FROM stages GROUP BY ALL HAVING count(*) > 1
),
missing AS (
  SELECT r.pipeline_id, r.position, r.name, r.dependency, r.dependency_order, r.name || ' -> ' || r.dependency AS message
  FROM ranked r WHERE NOT EXISTS (
    SELECT 1 FROM stages s WHERE s.pipeline_id = r.pipeline_id AND s.name = r.dependency)
),
sound AS (
  SELECT * FROM stages WHERE pipeline_id NOT IN (SELECT pipeline_id FROM duplicates)
    AND pipeline_id NOT IN (SELECT pipeline_id FROM missing)
)"""

_ORDER = """
RECURSIVE behind AS (
  SELECT e.pipeline_id, e.name, e.dependency AS ancestor FROM edges e
  WHERE e.pipeline_id IN (SELECT pipeline_id FROM sound)
  UNION
  SELECT b.pipeline_id, b.name, e.dependency FROM behind b
  JOIN edges e ON e.pipeline_id = b.pipeline_id AND e.name = b.ancestor
),
on_cycle AS (SELECT pipeline_id, name FROM behind WHERE name = ancestor),
stuck AS (
  SELECT s.pipeline_id, s.name, s.position FROM sound s
  WHERE EXISTS (SELECT 1 FROM on_cycle c WHERE c.pipeline_id = s.pipeline_id AND c.name = s.name)
  OR EXISTS (SELECT 1 FROM behind b JOIN on_cycle c ON c.pipeline_id = b.pipeline_id AND c.name = b.ancestor
    WHERE b.pipeline_id = s.pipeline_id AND b.name = s.name)
),
free AS (
  SELECT s.* FROM sound s WHERE NOT EXISTS (
    SELECT 1 FROM stuck t WHERE t.pipeline_id = s.pipeline_id AND t.name = s.name)
),
paths AS (
  SELECT pipeline_id, name, [position] AS trail FROM free f
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.pipeline_id = f.pipeline_id AND e.name = f.name)
  UNION
  SELECT f.pipeline_id, f.name, list_append(p.trail, f.position) FROM paths p
  JOIN edges e ON e.pipeline_id = p.pipeline_id AND e.dependency = p.name
  JOIN free f ON f.pipeline_id = e.pipeline_id AND f.name = e.name
),
levels AS (
  SELECT pipeline_id, name, CAST(max(len(trail)) - 1 AS INTEGER) AS level FROM paths GROUP BY ALL
),
trails AS (
  SELECT p.pipeline_id, p.name, l.level, max(p.trail) AS trail
  FROM paths p JOIN levels l ON l.pipeline_id = p.pipeline_id AND l.name = p.name AND len(p.trail) = l.level + 1
  GROUP BY ALL
)"""


def _ordered(select: str) -> str:
    head, _, rest = _ORDER.partition("RECURSIVE")
    return f"WITH RECURSIVE {_STAGES.strip()},\n{rest.strip()}\n{select}"


_RESULTS = """
stage_results AS (
  SELECT 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline, 'r' || CAST(user_id AS VARCHAR) AS run_id,
    event_id AS seq, 'stage_' || CAST(event_id % 6 AS VARCHAR) AS name,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END AS status,
    ts AS started_at,
    ts + INTERVAL '1' SECOND * CAST(CASE WHEN event_id % 50 = 0 THEN -5 ELSE floor(value) END AS INT) AS finished_at,
    CASE WHEN event_type = 'error' THEN CAST(1 + event_id % 3 AS INT) ELSE 0 END AS return_code,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN ' boom ' ELSE '' END AS stderr,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'src_' || CAST(event_id % 6 AS VARCHAR) END AS source,
    props AS outputs
  FROM events
)"""

_RUNS = (
    _RESULTS
    + """,
registry AS (
  SELECT 'p' || (user_id % 10) AS pipeline, 'r' || user_id AS run_id, ts AS run_started_at FROM events WHERE event_id % 7 = 0
  UNION SELECT 'p' || (user_id % 10), 'x' || event_id, ts FROM events WHERE event_id % 97 = 0
),
starts AS (
  FROM registry
  UNION ALL SELECT pipeline, run_id, min(started_at) FROM stage_results s GROUP BY pipeline, run_id
  HAVING min(started_at) < coalesce((SELECT min(run_started_at) FROM registry g
    WHERE g.pipeline = s.pipeline AND g.run_id = s.run_id), TIMESTAMP '9999-01-01')
),
results AS (
  SELECT r.*, s.run_started_at FROM stage_results r ASOF JOIN starts s
    ON r.pipeline = s.pipeline AND r.run_id = s.run_id AND r.started_at >= s.run_started_at
),
ends AS (
  SELECT 'x' || event_id AS run_id, ts + INTERVAL '5' SECOND AS ended_at,
    CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'succeeded' END AS status
  FROM events WHERE event_id % 97 = 0 AND (event_id % 2 = 0 OR event_id % 3 = 0)
),
runs AS (
  SELECT s.pipeline, s.run_id, s.run_started_at,
    CASE WHEN bool_or(r.status = 'failed') OR any_value(e.status) = 'failed' THEN 'failed'
         WHEN count(r.seq) > 0 OR any_value(e.status) = 'succeeded' THEN 'succeeded' ELSE 'running' END AS status,
    coalesce(min(r.started_at), any_value(s.run_started_at)) AS started_at,
    coalesce(max(r.finished_at), any_value(e.ended_at)) AS completed_at, count(r.seq) AS stages
  FROM starts s LEFT JOIN results r USING (pipeline, run_id, run_started_at) LEFT JOIN ends e ON e.run_id = s.run_id
  GROUP BY s.pipeline, s.run_id, s.run_started_at
),
last_results AS (
  SELECT * FROM results
  QUALIFY row_number() OVER (PARTITION BY pipeline, run_id, run_started_at, name ORDER BY seq DESC) = 1
)"""
)

_LOG = """
log_lines AS (
  SELECT 'w' || CAST(user_id AS VARCHAR) AS log_file, event_id AS line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || CASE event_type
      WHEN 'signup' THEN 'Pipeline started | {"name": "p' || CAST(user_id AS VARCHAR) || '", "run_id": "r' || CAST(event_id % 5 AS VARCHAR) || '"}'
      WHEN 'click' THEN 'Stage started | {"mode": "callable", "stage": "stage_' || CAST(event_id % 3 AS VARCHAR) || '"}'
      WHEN 'purchase' THEN 'Stage finished | {"mode": "callable", "stage": "stage_' || CAST(event_id % 3 AS VARCHAR) || '", "status": "succeeded"}'
      WHEN 'error' THEN 'Pipeline failed | {"error": "boom", "name": "p' || CAST(user_id AS VARCHAR) || '", "run_id": "r' || CAST((event_id + 1) % 6 AS VARCHAR) || '"}'
      ELSE 'Pipeline completed | {"name": "p' || CAST(user_id AS VARCHAR) || '", "run_id": "r' || CAST((event_id + 2) % 6 AS VARCHAR) || '", "stages": 3}' END AS value
  FROM events
),
parts AS (
  SELECT log_file, line_no,
    regexp_extract(value, '^(.{19}),([0-9]{3}) (.*?)(?: \\| (\\{.*\\}))?$', ['time', 'ms', 'message', 'body']) AS m
  FROM log_lines
),
log_events AS (
  SELECT log_file, line_no, CAST(m.time || '.' || m.ms AS TIMESTAMP) AS ts, m.message AS message,
    m.body ->> '$.run_id' AS run_id, m.body ->> '$.name' AS name, m.body ->> '$.stage' AS stage,
    m.body ->> '$.mode' AS mode, m.body ->> '$.status' AS status, m.body ->> '$.stages' AS stages,
    m.body ->> '$.error' AS error
  FROM parts
),
starts AS (SELECT log_file, line_no, ts, run_id FROM log_events WHERE message = 'Pipeline started'),
of_runs AS (
  SELECT e.* REPLACE (coalesce(e.run_id, (SELECT max_by(s.run_id, s.line_no) FROM starts s
      WHERE s.log_file = e.log_file AND s.line_no <= e.line_no)) AS run_id),
    (SELECT max_by(s.ts, s.line_no) FROM starts s WHERE s.log_file = e.log_file AND s.line_no <= e.line_no
      AND (e.run_id IS NULL OR s.run_id = e.run_id)) AS run_started_at
  FROM log_events e
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


_TIME = "%Y-%m-%d %H:%M:%S.%g"

ORACLES: dict[str, str] = {
    "q_scan_orders": _with(
        _RAW_ORDERS,
        """SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 31 = 0
          THEN customer_name || chr(10) || ' "second" line,' ELSE customer_name END AS customer_name,
        region, product, nullif(quantity, '') AS quantity,
        nullif(unit_price, '') AS unit_price, nullif(order_date, '') AS order_date FROM raw_orders""",
    ),
    "q_record_numbers": _with(
        _RAW_ORDERS,
        "SELECT count(*) AS records, CAST(0 AS BIGINT) AS misnumbered FROM raw_orders",
    ),
    "q_blank_counts": _with(
        _PARSED,
        """SELECT c AS column_name, count(*) FILTER (WHERE b) AS blanks FROM (
          SELECT f.c AS c, f.bad AS b FROM flags WHERE f.r = 'required') GROUP BY c""",
    ),
    "q_positive_number": _with(
        _PARSED, "SELECT order_id, q_pos AS quantity, p_pos AS unit_price FROM words"
    ),
    "q_title_case": _with(
        _PARSED,
        """SELECT order_id, customer_title AS customer_name, region_title AS region,
        product_title AS product FROM words""",
    ),
    "q_row_issues": _with(_PARSED, "SELECT * FROM issues"),
    "q_validation_report": _with(
        _PARSED,
        """SELECT (SELECT count(*) FROM words) AS record_count, (SELECT count(*) FROM issues) AS issue_count,
        (SELECT count(*) FROM issues) = 0 AS passed,
        (SELECT min(nullif(trim(order_date), '')) FROM words) AS first_order_date,
        (SELECT max(nullif(trim(order_date), '')) FROM words) AS last_order_date""",
    ),
    "q_unique_regions": _with(
        _PARSED, "SELECT DISTINCT region_title AS region FROM words WHERE coalesce(trim(region), '') <> ''"
    ),
    "q_clean_orders": _with(
        _PARSED,
        """SELECT order_id, customer_name, region, product, order_date, quantity,
        CAST(unit_price AS DOUBLE) AS unit_price, CAST(order_value AS DOUBLE) AS order_value FROM clean""",
    ),
    "q_rejects": _with(
        _PARSED,
        """SELECT row_number, order_id, customer_name, region, product, quantity, unit_price, order_date,
        CASE WHEN q IS NULL THEN 'quantity is not a whole number'
             WHEN p IS NULL THEN 'unit_price is not a decimal amount'
             ELSE 'order_date is not an ISO date' END AS reason
        FROM words WHERE q IS NULL OR p IS NULL OR d IS NULL""",
    ),
    "q_clean_summary": _with(
        _PARSED,
        """SELECT count(*) AS row_count, CAST(sum(order_value) AS DOUBLE) AS total_revenue,
        round(CAST(sum(order_value) AS DOUBLE) / count(*), 2) AS average_order_value FROM clean""",
    ),
    "q_clean_values": _with(
        _PARSED,
        """SELECT 'region' AS column_name, region AS value FROM clean GROUP BY ALL
        UNION ALL SELECT 'product', product FROM clean GROUP BY ALL""",
    ),
    "q_orders_sorted": _with(
        _PARSED, "SELECT order_date, row_number, order_id, region FROM clean ORDER BY order_date, row_number"
    ),
    "q_sink_clean_csv": _with(
        _PARSED,
        """SELECT order_id, customer_name, region, product, order_date, quantity,
        CAST(unit_price AS DOUBLE) AS unit_price, CAST(order_value AS DOUBLE) AS order_value FROM clean""",
    ),
    "q_sink_report_json": _with(
        _PARSED,
        """SELECT (SELECT count(*) FROM words) AS record_count, (SELECT count(*) FROM issues) AS issue_count,
        (SELECT count(*) FROM issues) AS listed_issues, (SELECT count(*) FROM issues) = 0 AS passed,
        (SELECT min(nullif(trim(order_date), '')) FROM words) AS first_order_date,
        (SELECT max(nullif(trim(order_date), '')) FROM words) AS last_order_date,
        (SELECT string_agg(r, '|' ORDER BY r) FROM (SELECT DISTINCT region_title AS r FROM words
          WHERE coalesce(trim(region), '') <> '')) AS unique_regions""",
    ),
    "q_validate_clean_report": _with(
        _PARSED,
        """SELECT 'record_count' AS item, CAST(count(*) AS DOUBLE) AS value FROM words
        UNION ALL SELECT 'issue_count', count(*) FROM issues
        UNION ALL SELECT 'row_count', count(*) FROM clean
        UNION ALL SELECT 'average_order_value', round(CAST(sum(order_value) AS DOUBLE) / count(*), 2) FROM clean
        UNION ALL SELECT 'total_orders', count(*) FROM clean
        UNION ALL SELECT 'total_revenue', CAST(sum(order_value) AS DOUBLE) FROM clean
        UNION ALL SELECT 'revenue ' || region, CAST(sum(order_value) AS DOUBLE) FROM clean GROUP BY region""",
    ),
    "q_revenue_by_region": _with(
        _SALES, "SELECT region, CAST(revenue AS DOUBLE) AS revenue FROM by_region"
    ),
    "q_orders_by_region": _with(_SALES, "SELECT region, orders FROM by_region"),
    "q_units_by_product": _with(_SALES, "SELECT product, units FROM by_product"),
    "q_revenue_by_product": _with(
        _SALES, "SELECT product, CAST(revenue AS DOUBLE) AS revenue FROM by_product"
    ),
    "q_sales_grouping_sets": _with(
        _SALES,
        """SELECT 'region' AS dimension, region AS key, orders, units, CAST(revenue AS DOUBLE) AS revenue FROM by_region
        UNION ALL SELECT 'product', product, orders, units, CAST(revenue AS DOUBLE) FROM by_product
        UNION ALL SELECT 'total', NULL, total_orders, total_units, total_revenue FROM totals""",
    ),
    "q_sales_totals": _with(_SALES, "SELECT * FROM totals"),
    "q_sales_summary": _with(
        _SALES,
        """SELECT total_orders, total_revenue, (SELECT region FROM top_region) AS top_region,
        (SELECT product FROM top_product) AS top_product, first_order_date, last_order_date FROM totals""",
    ),
    "q_sales_summary_long": _with(
        _SALES,
        """SELECT 'revenue_by_region' AS field, region AS key, CAST(revenue AS DOUBLE) AS value FROM by_region
        UNION ALL SELECT 'orders_by_region', region, orders FROM by_region
        UNION ALL SELECT 'units_by_product', product, units FROM by_product
        UNION ALL SELECT 'revenue_by_product', product, CAST(revenue AS DOUBLE) FROM by_product""",
    ),
    "q_top_region": _with(
        _SALES, "SELECT region, CAST(revenue AS DOUBLE) AS revenue FROM top_region"
    ),
    "q_top_product": _with(
        _SALES, "SELECT product, CAST(revenue AS DOUBLE) AS revenue FROM top_product"
    ),
    "q_top_over_files": _with(
        _PARSED,
        """, placed AS (
          SELECT coalesce(region_title, '') AS region, 'Item ' || order_id AS product, date_trunc('year', d) AS first_day,
            2 - CAST(order_id AS BIGINT) % 3 AS folder, CAST(order_id AS BIGINT) AS key FROM words WHERE d IS NOT NULL
        )
        SELECT region, product FROM placed
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY first_day, folder, key) = 1
        UNION ALL SELECT * FROM (SELECT 'all', product FROM placed ORDER BY first_day, folder, key LIMIT 1)""",
    ),
    "q_region_breakdown": _with(
        _SALES, "SELECT region, orders, CAST(revenue AS DOUBLE) AS revenue FROM by_region ORDER BY region"
    ),
    "q_sink_summary_json": _with(
        _SALES,
        """SELECT total_orders, total_revenue, r.region AS top_region, p.product AS top_product,
        CAST(first_order_date AS VARCHAR) AS first_order_date, CAST(last_order_date AS VARCHAR) AS last_order_date,
        (SELECT count(*) FROM by_product) AS products, p.units AS top_product_units,
        CAST(r.revenue AS DOUBLE) AS top_region_revenue
        FROM totals, top_region r, top_product p""",
    ),
    "q_dep_normalize": _with(
        _STAGES,
        """SELECT s.pipeline_id, s.position, s.name,
        coalesce(string_agg(r.dependency, ',' ORDER BY r.dependency_order), '') AS dependencies
        FROM stages s LEFT JOIN ranked r ON r.pipeline_id = s.pipeline_id AND r.i = s.i
        GROUP BY s.pipeline_id, s.position, s.name, s.i""",
    ),
    "q_dep_append": _with(
        _STAGES,
        """, every AS (
          SELECT pipeline_id, i, position, dependency, dependency_order AS spot FROM ranked
          UNION ALL SELECT pipeline_id, i, position, 'audit', 100 FROM stages
          UNION ALL SELECT pipeline_id, i, position, 'stage_' || (i - 3), 101 FROM stages
        ), firsts AS (
          SELECT pipeline_id, i, position, dependency, min(spot) AS spot FROM every GROUP BY ALL
        )
        SELECT pipeline_id, position, string_agg(dependency, ',' ORDER BY spot) AS dependencies
        FROM firsts GROUP BY pipeline_id, position, i""",
    ),
    "q_dep_lookup": _with(
        _STAGES,
        """, mapping AS (
          SELECT pipeline_id, CASE i % 5 WHEN 0 THEN 'stage_' || i WHEN 1 THEN 'stage_' || i || '.v1.py'
            WHEN 2 THEN 'stage_' || i || '.v1' WHEN 3 THEN '/jobs/stage_' || i || '.v1.py'
            ELSE 'unused_stage_' || i END AS key, 'dep_stage_' || i AS dependencies FROM stages
          UNION ALL SELECT pipeline_id, '/jobs/stage_' || i || '.v1.py', 'late_stage_' || i FROM stages WHERE i % 5 <> 3
        )
        SELECT s.pipeline_id, s.name, coalesce(a.dependencies, b.dependencies, c.dependencies, d.dependencies, '') AS dependencies
        FROM stages s
        LEFT JOIN mapping a ON a.pipeline_id = s.pipeline_id AND a.key = s.name
        LEFT JOIN mapping b ON b.pipeline_id = s.pipeline_id AND b.key = s.name || '.v1.py'
        LEFT JOIN mapping c ON c.pipeline_id = s.pipeline_id AND c.key = s.name || '.v1'
        LEFT JOIN mapping d ON d.pipeline_id = s.pipeline_id AND d.key = '/jobs/' || s.name || '.v1.py'""",
    ),
    "q_duplicate_stages": _with(_STAGES, "SELECT * FROM duplicates"),
    "q_missing_dependencies": _with(
        _STAGES, "SELECT pipeline_id, position, name, dependency, message FROM missing"
    ),
    "q_dep_levels": _ordered("SELECT pipeline_id, name, level FROM trails"),
    "q_topo_order": _ordered(
        """SELECT pipeline_id, name, level,
        row_number() OVER (PARTITION BY pipeline_id ORDER BY level, trail) - 1 AS place
        FROM trails WHERE pipeline_id NOT IN (SELECT pipeline_id FROM stuck)"""
    ),
    "q_cycle_members": _ordered("SELECT pipeline_id, name, position FROM stuck"),
    "q_graph_verdict": _ordered(
        """, counts AS (
          SELECT g.pipeline_id,
            (SELECT count(*) FROM duplicates d WHERE d.pipeline_id = g.pipeline_id) AS doubled,
            (SELECT count(*) FROM missing m WHERE m.pipeline_id = g.pipeline_id) AS absent,
            (SELECT count(*) FROM stuck t WHERE t.pipeline_id = g.pipeline_id) AS stopped
          FROM (SELECT DISTINCT pipeline_id FROM stages) g
        )
        SELECT c.pipeline_id,
          CASE WHEN doubled > 0 THEN 'duplicate' WHEN absent > 0 THEN 'missing' WHEN stopped > 0 THEN 'cycle' ELSE 'ok' END AS verdict,
          CASE WHEN doubled > 0 THEN doubled WHEN absent > 0 THEN absent ELSE stopped END AS problems,
          CASE WHEN doubled > 0 THEN 'Duplicate stage names are not allowed:'
            WHEN absent > 0 THEN 'Unknown stage dependencies:'
            WHEN stopped > 0 THEN 'Stage graph contains a cycle or unresolved dependencies:' END AS message
        FROM counts c""".replace("\n        SELECT c.", "\nSELECT c.", 1)
    ),
    "q_graph_findings": _ordered(
        """SELECT pipeline_id, 'duplicate' AS rule, CAST(0 AS INTEGER) AS place, CAST(0 AS INTEGER) AS dependency_order, name AS text FROM duplicates
        UNION ALL SELECT pipeline_id, 'missing', CAST(position AS INTEGER), CAST(dependency_order AS INTEGER), message FROM missing
        UNION ALL SELECT pipeline_id, 'cycle', CAST(position AS INTEGER), CAST(0 AS INTEGER), name FROM stuck"""
    ),
    "q_stage_issues": _with(
        _STAGES,
        """SELECT pipeline_id, position, CAST(0 AS INTEGER) AS rule_order, 'named' AS rule,
          'Stage name cannot be empty.' AS message FROM stages WHERE (pipeline_id + i) % 11 = 0
        UNION ALL SELECT pipeline_id, position, 1, 'sourced', 'Stage ''' || name || ''' does not define a source.'
        FROM stages WHERE (pipeline_id + i) % 11 <> 0 AND (pipeline_id + i) % 3 = 0""",
    ),
    "q_run_inputs": _with(
        _STAGES,
        """SELECT s.pipeline_id, s.name, r.dependency_order, r.dependency
        FROM stages s LEFT JOIN ranked r ON r.pipeline_id = s.pipeline_id AND r.i = s.i""",
    ),
    "q_stage_durations": _with(
        _RESULTS,
        """SELECT run_id, seq, name,
        greatest(epoch_us(finished_at) - epoch_us(started_at), 0) / 1e6 AS duration_seconds FROM stage_results""",
    ),
    "q_run_status": _with(
        _RUNS,
        f"""SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at, status,
        strftime(started_at, '{_TIME}') AS started_at, strftime(completed_at, '{_TIME}') AS completed_at,
        stages, status = 'succeeded' AS succeeded FROM runs""",
    ),
    "q_run_ids": _with(
        _RESULTS,
        """, hashed AS (
          SELECT seq, started_at, sha256(pipeline || ':python:' || strftime(started_at, '%Y-%m-%dT%H:%M:%S')
            || CASE WHEN epoch_us(started_at) % 1000000 = 0 THEN '' ELSE strftime(started_at, '.%f') END || '+00:00') AS hash
          FROM stage_results
        )
        SELECT seq, strftime(started_at, '%Y-%m-%d_%H%M%S') || '_' || hash[1:8] AS run_id, hash, hash[1:8] AS short_hash
        FROM hashed""",
    ),
    "q_exit_classify": _with(
        _RESULTS,
        """SELECT seq, return_code, CASE WHEN return_code = 0 THEN 'succeeded' ELSE 'failed' END AS status,
        CASE WHEN return_code = 0 THEN NULL WHEN trim(stderr) = '' THEN 'Subprocess returned a non-zero exit code.'
          ELSE trim(stderr) END AS error FROM stage_results""",
    ),
    "q_result_defaults": _with(
        _RESULTS,
        """SELECT seq, name, coalesce(source, 'default_' || name) AS source,
        CASE status WHEN 'pending' THEN 'succeeded' ELSE status END AS status FROM stage_results""",
    ),
    "q_run_parameters": """
WITH given AS (
  SELECT 'p' || (user_id % 10) AS pipeline, 'e' || event_id AS run_id, event_id, user_id, event_type, props FROM events
)
SELECT pipeline, run_id, 'name' AS key, 'n' || user_id AS value FROM given
UNION ALL SELECT pipeline, run_id, 'backend', CASE WHEN event_id % 3 = 0 THEN 'python' ELSE 'spark' END FROM given
UNION ALL SELECT pipeline, run_id, 'work_dir', NULL FROM given
UNION ALL SELECT pipeline, run_id, 'log_dir', CASE WHEN event_id % 2 = 0 THEN props ELSE 'logs' END FROM given
UNION ALL SELECT pipeline, run_id, 'data_dir', 'data' FROM given
UNION ALL SELECT pipeline, run_id, 'allow_subprocess_fallback', 'true' FROM given
UNION ALL SELECT pipeline, run_id, 'python_executable', NULL FROM given
UNION ALL SELECT pipeline, run_id, 'kind', event_type FROM given
UNION ALL SELECT pipeline, run_id, 'owner', 'x' || event_id FROM given
UNION ALL SELECT pipeline, run_id, 'reason', props FROM given WHERE event_id % 2 <> 0""",
    "q_run_manifest": _with(
        _RUNS,
        f"""SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at,
        row_number() OVER (PARTITION BY pipeline, run_id, results.run_started_at ORDER BY seq) - 1 AS place, name, outputs,
        seq = max(seq) OVER (PARTITION BY pipeline, run_id, results.run_started_at, name) AS "last" FROM results""",
    ),
    "q_sink_manifests": _with(
        _RUNS,
        f""", listed AS (
          SELECT pipeline, run_id, run_started_at, name,
            row_number() OVER (PARTITION BY pipeline, run_id, run_started_at ORDER BY seq) - 1 AS place FROM results
        ),
        kept AS (SELECT pipeline, run_id, run_started_at, count(*) AS n FROM last_results GROUP BY ALL)
        SELECT r.pipeline, r.run_id, strftime(r.run_started_at, '{_TIME}') AS run_started_at, r.status,
          r.stages AS stages_listed, coalesce(k.n, 0) AS outputs_listed, l.place, l.name, o.outputs
        FROM runs r
        LEFT JOIN kept k ON k.pipeline = r.pipeline AND k.run_id = r.run_id AND k.run_started_at = r.run_started_at
        LEFT JOIN listed l ON l.pipeline = r.pipeline AND l.run_id = r.run_id AND l.run_started_at = r.run_started_at
        LEFT JOIN last_results o ON o.pipeline = r.pipeline AND o.run_id = r.run_id
          AND o.run_started_at = r.run_started_at AND o.name = l.name""",
    ),
    "q_latest_run": _with(
        _RUNS,
        f"""SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at, status, stages FROM runs
        QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY runs.run_started_at DESC, run_id DESC) = 1""",
    ),
    "q_result_for": _with(
        _RUNS,
        f"""SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at, seq, status, outputs
        FROM results WHERE name = 'stage_3'
        QUALIFY row_number() OVER (PARTITION BY pipeline, run_id, results.run_started_at ORDER BY seq) = 1""",
    ),
    "q_handoff": _with(
        _RUNS,
        f""", named AS (
          SELECT DISTINCT ON (pipeline, run_id, run_started_at) pipeline, run_id, run_started_at, CAST(seq % 5 AS INTEGER) AS part
          FROM results WHERE name = 'stage_1' ORDER BY pipeline, run_id, run_started_at, seq DESC
        ),
        totals AS (
          SELECT CAST(o_orderkey % 5 AS INTEGER) AS part, count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS id_sum
          FROM orders GROUP BY ALL
        ),
        taken AS (
          SELECT r.*, coalesce(n.part, 4) AS part FROM (SELECT DISTINCT pipeline, run_id, run_started_at FROM results) r
          LEFT JOIN named n ON r.pipeline = n.pipeline AND r.run_id = n.run_id AND r.run_started_at = n.run_started_at
        )
        SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at, 'part ' || taken.part AS part, records, id_sum
        FROM taken LEFT JOIN totals ON taken.part = totals.part""",
    ),
    "q_results_dedup": _with(
        _RUNS,
        f"""SELECT pipeline, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at, name, seq, status, outputs
        FROM last_results""",
    ),
    "q_upstream_outputs": _with(
        _RUNS,
        f""", asked AS (
          SELECT pipeline, run_id, run_started_at, name, 'stage_' || (CAST(name[7:] AS INT) - back) AS dependency
          FROM last_results, (VALUES (1), (2)) AS b(back) WHERE CAST(name[7:] AS INT) >= back
        )
        SELECT a.pipeline, a.run_id, strftime(a.run_started_at, '{_TIME}') AS run_started_at, a.name, a.dependency,
          u.status AS upstream_status, u.outputs AS upstream_outputs
        FROM asked a LEFT JOIN last_results u ON u.pipeline = a.pipeline AND u.run_id = a.run_id
          AND u.run_started_at = a.run_started_at AND u.name = a.dependency""",
    ),
    "q_not_run": _with(
        _RUNS,
        f"""SELECT r.pipeline, r.run_id, strftime(r.run_started_at, '{_TIME}') AS run_started_at, 'stage_' || n AS name
        FROM runs r, range(6) AS t(n) WHERE r.status IN ('failed', 'running') AND NOT EXISTS (
          SELECT 1 FROM results s WHERE s.pipeline = r.pipeline AND s.run_id = r.run_id
            AND s.run_started_at = r.run_started_at AND s.name = 'stage_' || n)""",
    ),
    "q_log_events": _with(
        _LOG,
        f"""SELECT log_file, line_no, strftime(ts, '{_TIME}') AS ts, message, run_id, name, stage, mode, status,
        stages, error FROM log_events""",
    ),
    "q_log_attribution": _with(
        _LOG,
        f"""SELECT log_file, line_no, message, run_id, strftime(run_started_at, '{_TIME}') AS run_started_at
        FROM of_runs""",
    ),
    "q_log_stage_durations": _with(
        _LOG,
        """SELECT log_file, run_id, stage, greatest(
          epoch_us(max(ts) FILTER (WHERE message = 'Stage finished'))
            - epoch_us(min(ts) FILTER (WHERE message = 'Stage started')),
          CASE WHEN count(DISTINCT message) = 2 THEN 0 END) / 1e6 AS duration_seconds
        FROM of_runs WHERE stage IS NOT NULL GROUP BY log_file, run_id, run_started_at, stage""",
    ),
    "q_run_wall_time": _with(
        _LOG,
        """SELECT log_file, run_id,
        greatest(epoch_us(max(ts) FILTER (WHERE message IN ('Pipeline failed', 'Pipeline completed')))
          - epoch_us(run_started_at), 0) / 1e6 * CASE WHEN count(*) FILTER (
            WHERE message IN ('Pipeline failed', 'Pipeline completed')) > 0 AND run_started_at IS NOT NULL THEN 1 END AS wall_seconds,
        count(*) FILTER (WHERE message = 'Stage finished') AS stages_finished,
        max(CAST(stages AS BIGINT)) AS stages_logged
        FROM of_runs WHERE run_id IS NOT NULL GROUP BY log_file, run_id, run_started_at""",
    ),
    "q_failed_runs": _with(
        _LOG,
        "SELECT log_file, line_no, run_id, name, error FROM of_runs WHERE message = 'Pipeline failed'",
    ),
}
