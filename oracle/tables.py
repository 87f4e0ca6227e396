"""Twins of the sinks and table maintenance."""
from oracle.parts import NOW, daily, r, rank

_FACT = """SELECT date, route_id, category_id, CASE max(rk) WHEN 0 THEN 'none' WHEN 1 THEN 'rain' WHEN 2 THEN 'heavy' ELSE 'extreme' END AS severity, """
_OLD = "TIMESTAMP '2024-01-14 06:00:00'"

SQL = {
    "src_tables": """SELECT p_type AS category, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY 1""",
    "sink_raw_partitioned": "SELECT CAST(kafka_ts AS DATE) AS date, count(*) AS rows, count(event_id) AS with_id FROM b_checked GROUP BY 1",
    "sink_quarantine": "SELECT reason, event_id FROM b_checked WHERE reason IS NOT NULL",
    "sink_two_phase": "SELECT type, count(*) AS json_rows, count(*) AS table_rows FROM b_clean GROUP BY 1",
    "sink_multi": "SELECT type, count(*) AS json_rows, count(*) AS table_rows FROM b_clean GROUP BY 1",
    "sink_jdbc_append": "SELECT type, CAST(1 AS INTEGER) AS batch_id, count(*) AS rows FROM b_clean GROUP BY 1",
    "sink_bulk_load": f"SELECT {daily('rain_mm')} AS severity, count(*) AS rows, {r('sum(rain_mm)', 1)} AS rain_mm FROM b_daily GROUP BY 1",
    "merge_upsert_orders": f"""SELECT order_id, {r(f'CASE WHEN created_at <= {_OLD} THEN value_inr ELSE value_inr + 1 END', 2)} AS value_inr, status, dispatched_at, delivered_at, delay_min FROM b_orders""",
    "merge_additive_rollup": _FACT + "CAST(sum(orders) AS BIGINT) AS orders, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("exposed", "affected", "delayed", "sla_breaches")) + ", "
        + ", ".join(f"{r(f'sum({c})', 2)} AS {c}" for c in ("delay_min_sum", "cost_transport", "cost_reship", "cost_sla")) + f" FROM (SELECT *, {rank('severity')} AS rk FROM b_star) GROUP BY 1, 2, 3",
    "merge_insert_ignore": """SELECT order_id, product_id, qty, price_inr FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY src, qty, price_inr) AS n FROM (
        SELECT 0 AS src, order_id, 'P'||((k*3 + i*31)%200) AS product_id, CAST(i + 1 AS INTEGER) AS qty, CAST(i + 1 AS DOUBLE) AS price_inr FROM (SELECT order_id, k, unnest(range(1 + k%3)) AS i FROM b_book)
        UNION ALL SELECT 1, 'O'||l_orderkey, 'P'||l_partkey, CAST(l_quantity AS INTEGER), l_extendedprice FROM lineitem)) WHERE n = 1""",
    "merge_delete_keys": """SELECT 'P'||l_partkey AS product_id, count(*) AS lines FROM lineitem WHERE 'O'||l_orderkey NOT IN (SELECT order_id FROM b_orders WHERE (status = 'delivered' AND
        delivered_at < TIMESTAMP '2024-01-14 18:00:00') OR (status IN ('scheduled','assigned') AND planned_dispatch < TIMESTAMP '2024-01-16 12:00:00')) GROUP BY 1""",
    "retention_prune": "SELECT event_id, type, kafka_ts FROM b_clean WHERE kafka_ts >= TIMESTAMP '2024-01-22'",
    "distinct_rows": "SELECT DISTINCT city_id, date, rain_mm FROM b_daily",
}
