"""Twins of the order lifecycle queries, from the plan of each order."""
from oracle.parts import NOW, by_class, expected, WEIGHTS, probs, promised, r, rank, sla

_FOLDED = "SELECT * EXCLUDE (created_at, planned_dispatch, promised_at), created_at, planned_dispatch, promised_at FROM b_orders"
_DONE = f"SELECT *, done_at > promised_at AS breached FROM b_book WHERE done_at <= {NOW}"
_ROLLUP = f"""SELECT CAST(done_at AS DATE) AS date, route_id, category_id, CASE max({rank('trip_class')}) WHEN 0 THEN 'none' WHEN 1 THEN 'rain' WHEN 2 THEN 'heavy' ELSE 'extreme' END AS severity, count(*) AS orders,
    count(*) FILTER (trip_class <> 'none') AS exposed, count(*) FILTER (weather_min >= 5) AS affected, count(*) FILTER (weather_min + k%30 >= 30) AS delayed, count(*) FILTER (breached) AS sla_breaches,
    {r('sum(weather_min)', 2)} AS delay_min_sum, {r('sum(weather_min/60*38)', 2)} AS cost_transport, {r('sum(' + by_class('trip_class', (0, .002, .008, .03)) + '*220)', 2)} AS cost_reship,
    {r(f"sum(CASE WHEN breached AND trip_class <> 'none' THEN {sla('tier')} ELSE 0 END)", 2)} AS cost_sla FROM ({_DONE}) GROUP BY 1, 2, 3"""
_REPLAY = "SELECT ts AS emitted_at, ts - to_days(CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE))//10*10 AS INTEGER)) AS sim_time FROM events"
_LAPS = f"""SELECT emitted_at, sum(CASE WHEN sim_time < before - INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (ORDER BY emitted_at) AS lap FROM
    (SELECT *, lag(sim_time) OVER (ORDER BY emitted_at) AS before FROM ({_REPLAY}))"""
_X = f"""SELECT 1.0::DOUBLE AS x0, {r(f"({promised('normal_eta_h', 'tier')} - normal_eta_h)/normal_eta_h", 6)} AS x1, {r('sensitivity*w', 6)} AS x2, {r('distance_km/1000', 6)} AS x3, y FROM
    (SELECT *, {expected(WEIGHTS)} AS w FROM (SELECT *, {probs('rk', 'lead_h')} FROM (SELECT *, {rank('trip_class')} AS rk, (1 + k%48)::DOUBLE AS lead_h, CASE WHEN done_at > promised_at THEN 1 ELSE 0 END AS y
    FROM b_book WHERE status = 'delivered')))"""

SQL = {
    "fold_orders": "SELECT * EXCLUDE (weather_delay_min), weather_delay_min FROM b_orders",
    "stream_order_state": "SELECT * FROM b_orders",
    "stream_interval_join": "SELECT * FROM b_orders",
    "stream_state_ttl": f"""SELECT trip_id, route_id, CASE WHEN arrive_at <= {NOW} THEN 'at_hub' ELSE 'in_transit' END AS status, greatest(last_move, planned, CASE WHEN weather_min >= 15 AND slip_at <= {NOW} THEN slip_at ELSE planned END,
        CASE WHEN arrive_at <= {NOW} THEN arrive_at ELSE planned END) AS last_report, CASE WHEN arrive_at <= {NOW} THEN arrive_at END AS arrived_at FROM
        (SELECT *, planned + to_minutes(30*CAST(least(epoch_us({NOW}) - epoch_us(planned), epoch_us(arrive_at) - epoch_us(planned) - 1)//1800000000 AS INTEGER)) AS last_move FROM b_trip0 WHERE planned <= {NOW})
        WHERE NOT (arrive_at <= {NOW} AND arrive_at + INTERVAL 48 HOUR < {NOW} - INTERVAL 1 HOUR)""",
    "fold_trips": "SELECT * FROM b_trips",
    "fold_items": """SELECT order_id, product_id, min(qty) AS qty, CAST(min(qty) AS DOUBLE) AS price_inr FROM (SELECT order_id, 'P'||((k*3 + i*31)%200) AS product_id, CAST(i + 1 AS INTEGER) AS qty FROM
        (SELECT order_id, k, unnest(range(1 + k%3)) AS i FROM b_book)) GROUP BY 1, 2""",
    "join_trip_members": f"""SELECT order_id, plan_trip AS trip_id, CASE WHEN planned <= {NOW} THEN planned END AS dispatched_at, CASE WHEN slipped THEN weather_min END AS delay_min,
        CASE WHEN arrive_at <= {NOW} THEN arrive_at END AS arrived_at FROM b_book WHERE assign_at <= {NOW}""",
    "delivered_rollup": _ROLLUP,
    "stream_rollup": _ROLLUP,
    "stream_recovery": f"SELECT date, route_id, category_id, severity, orders, sla_breaches FROM ({_ROLLUP})",
    "expire_orders": """SELECT order_id, status, planned_dispatch, delivered_at FROM b_orders WHERE NOT coalesce((status = 'delivered' AND delivered_at < TIMESTAMP '2024-01-14 18:00:00')
        OR (status IN ('scheduled','assigned') AND planned_dispatch < TIMESTAMP '2024-01-16 12:00:00'), false)""",
    "changed_orders": f"""SELECT order_id FROM b_book WHERE (created_at > TIMESTAMP '2024-01-15 04:00:00' AND created_at <= {NOW}) OR (assign_at > TIMESTAMP '2024-01-15 04:00:00' AND assign_at <= {NOW})
        OR (done_at > TIMESTAMP '2024-01-15 04:00:00' AND done_at <= {NOW}) OR (planned > TIMESTAMP '2024-01-15 04:00:00' AND planned <= {NOW})
        OR (weather_min >= 15 AND slip_at > TIMESTAMP '2024-01-15 04:00:00' AND slip_at <= {NOW}) OR (arrive_at > TIMESTAMP '2024-01-15 04:00:00' AND arrive_at <= {NOW})""",
    "replay_wrap": f"SELECT CAST(lap AS BIGINT) AS lap, count(*) AS events, min(emitted_at) AS first_at, max(emitted_at) AS last_at FROM ({_LAPS}) GROUP BY 1",
    "high_water_mark": f"SELECT emitted_at, max(sim_time) OVER (ORDER BY emitted_at) AS high_water FROM ({_REPLAY})",
    "src_replay_log": f"SELECT route_id, status, count(*) AS orders, {r('sum(value_inr)', 2)} AS value FROM b_orders GROUP BY 1, 2",
    "training_features": f"SELECT x0, x1, x2, x3, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive FROM ({_X}) GROUP BY 1, 2, 3, 4",
    "auc": f"""SELECT {r('(sum(CASE WHEN y = 1 THEN rk END) - p*(p+1)/2)/(p*q)', 6)} AS auc, CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives FROM (SELECT *, sum(y) OVER () AS p, sum(1-y) OVER () AS q,
        rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0::DOUBLE AS rk FROM (SELECT round(o_totalprice/100)*100 AS score, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders)) GROUP BY p, q""",
    "sort_order_events": f"""SELECT order_id, 'ORDER_CREATED'||CASE WHEN assign_at <= {NOW} THEN '>ORDER_ASSIGNED' ELSE '' END||CASE WHEN done_at <= {NOW} THEN '>DELIVERY_COMPLETED' ELSE '' END AS types FROM b_book""",
    "join_order_detail": f"""SELECT o.order_id, r.code AS route, c.name AS city, c.state, w.name AS warehouse, h.name AS hub, o.category_id[1]||lower(o.category_id[2:]) AS category, o.status,
        CAST(coalesce(i.n, 0) AS INTEGER) AS items, CAST(1 + CASE WHEN assign_at <= {NOW} THEN 1 ELSE 0 END + CASE WHEN done_at <= {NOW} THEN 1 ELSE 0 END AS INTEGER) AS events,
        CASE WHEN done_at <= {NOW} THEN 'DELIVERY_COMPLETED' WHEN assign_at <= {NOW} THEN 'ORDER_ASSIGNED' ELSE 'ORDER_CREATED' END AS last_event, p.score, CAST(m.n AS INTEGER) AS history_rows
        FROM b_book o JOIN b_routes r ON r.route_id = o.route_id JOIN b_city c ON c.city_id = o.city_id JOIN b_wh w ON w.warehouse_id = o.warehouse_id JOIN b_hub h ON h.hub_id = o.hub_id
        LEFT JOIN (SELECT 'O'||l_orderkey AS order_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) i ON i.order_id = o.order_id
        LEFT JOIN b_risk p ON p.route_id = o.route_id AND p.tier = o.tier AND p.dispatch = o.planned LEFT JOIN (SELECT route_id, count(*) AS n FROM b_impact GROUP BY 1) m ON m.route_id = o.route_id""",
}
