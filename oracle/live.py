"""Twins of the risk, outlook, impact and order-book queries."""
from oracle.parts import (FAILS, MULTS, NOW, WEIGHTS, by_class, breach, category, class_of, expected, hourly, likeliest, mult, probs, promised, r, rank, sla, whole)

_RISK = "route_id, tier, dispatch, city_id, warehouse_id, orders, score, category, expected_class, p_rain, expected_delay_min, p_breach"
_DETAIL = {
    "rainfall": ("Rain on the way", 30, f"'forecast on the way: '||expected_class||', odds of rain '||{whole('p_rain_max*100')}||'%'"),
    "route_history": ("Past delays of the route", 20, f"'past delay on '||code||' in class '||wet_class||': +'||{whole('wet_ratio*100')}||'% of travel time'"),
    "exposure": ("Hours in the rain", 15, f"'wet hours: '||{whole('exposed_share*100')}||'% of '||hours"),
    "load": ("Warehouse under rain", 10, f"'exposed orders of the warehouse: '||{whole('load_share*100')}||'%'"),
    "timing": ("Hour of arrival", 8, "'local arrival hour '||lpad(CAST(CAST(floor(arrival) AS INTEGER) AS VARCHAR), 2, '0')||CASE WHEN evening THEN ', after dark' ELSE '' END"),
    "sla": ("Time to spare", 12, f"'minutes late / to spare: '||{whole('delay_h*60')}||' / '||{whole('slack_h*60')}"),
    "performance": ("Dry on-time record", 5, f"'on time when dry: '||{whole('none_on_time*100')}||'%'"),
}
_PARTS = " UNION ALL ".join(
    f"SELECT route_id, tier, dispatch, {i} AS ord, '{k}' AS key, '{label}' AS label, {r(f'raw_{k}', 1)} AS points, {cap} AS cap, {detail} AS detail FROM b_raw"
    for i, (k, (label, cap, detail)) in enumerate(_DETAIL.items()))
_RANKED = f"SELECT *, CAST(row_number() OVER (PARTITION BY route_id, tier, dispatch ORDER BY points DESC, ord) - 1 AS INTEGER) AS place FROM ({_PARTS})"


def _sum_where(c):
    return f"CAST(coalesce(sum(CASE WHEN {c} THEN orders ELSE 0 END), 0) AS BIGINT)"


_SUMMARY = f"""SELECT horizon_h, CAST(coalesce(sum(orders), 0) AS BIGINT) AS scheduled, {_sum_where('p_rain >= 0.5')} AS exposed, {_sum_where("expected_class IN ('heavy','extreme')")} AS heavy_exposed,
    {_sum_where("category = 'High'")} AS high, {_sum_where("category = 'Critical'")} AS critical, {r('coalesce(sum(expected_delay_min*orders)/greatest(sum(orders), 1), 0)', 1)} AS expected_delay_min,
    {whole('coalesce(sum(p_breach*orders), 0)')} AS sla_breaches FROM (SELECT CAST(unnest([6,12,24,48]) AS INTEGER) AS horizon_h) h LEFT JOIN b_risk ON dispatch <= {NOW} + to_hours(horizon_h) GROUP BY 1"""
_GRIDFC = f"""SELECT step, demand, {r('1 - prob_none', 4)} AS wet FROM (SELECT *, {probs('rk', 'step')} FROM (SELECT g.*, {rank('(' + hourly('coalesce(h.mm, 0)') + ')')} AS rk FROM
    (SELECT city_id, demand, CAST(unnest(range(48)) AS INTEGER) AS step FROM b_city) g LEFT JOIN b_hourly h ON h.city_id = g.city_id AND h.hour = {NOW} + to_hours(step)))"""
_TIMELINE = f"""SELECT s.step, {NOW} + to_hours(s.step) AS hour, CAST(coalesce(orders, 0) AS BIGINT) AS orders, {r('coalesce(score_sum/orders, 0)', 1)} AS avg_score,
    CAST(coalesce(high_plus, 0) AS BIGINT) AS high_plus, CAST(coalesce(sla_breaches, 0) AS BIGINT) AS sla_breaches, rain_probability FROM (SELECT CAST(unnest(range(48)) AS INTEGER) AS step) s
    LEFT JOIN (SELECT date_trunc('hour', dispatch) AS hour, sum(orders) AS orders, sum(score*orders) AS score_sum, sum(CASE WHEN category IN ('High','Critical') THEN orders ELSE 0 END) AS high_plus,
      {whole('sum(p_breach*orders)')} AS sla_breaches FROM b_risk GROUP BY 1) w ON w.hour = {NOW} + to_hours(s.step)
    LEFT JOIN (SELECT step, {r('sum(wet*demand)/sum(demand)', 3)} AS rain_probability FROM ({_GRIDFC}) GROUP BY 1) f ON f.step = s.step"""
_EXPOSURE = f"""SELECT o.*, t.delay_min AS tdelay, coalesce(t.near_city, w.city_id) AS near, coalesce(wt.severity, 'none') <> 'none' OR coalesce(wn.severity, 'none') <> 'none' AS exposed
    FROM b_orders o LEFT JOIN b_trips t USING (trip_id) LEFT JOIN b_wh w ON w.warehouse_id = o.warehouse_id LEFT JOIN b_weather wt ON wt.city_id = o.city_id
    LEFT JOIN b_weather wn ON wn.city_id = coalesce(t.near_city, w.city_id) WHERE o.status IN ('in_transit','at_hub')"""
_KPI = f"""SELECT d.total_orders, m.in_transit, m.weather_exposed, m.affected_now + d.affected_done AS weather_affected, m.late_now + d.late_done AS delayed,
    CAST(k.at_risk + m.late_now AS BIGINT) AS sla_risk, {r('d.delay', 1)} AS avg_delay_min, {whole('m.cost_now + d.cost_done')} AS weather_cost_inr, d.delivered_today,
    {r('1 - d.breached/greatest(d.delivered_today, 1)', 4)} AS on_time_rate, t.active_trips, t.delayed_trips, wc.wet_cities FROM
    (SELECT count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-15') AS total_orders, count(*) FILTER (done) AS delivered_today, count(*) FILTER (done AND weather_delay_min >= 5) AS affected_done,
      count(*) FILTER (done AND delay_min >= 30) AS late_done, count(*) FILTER (done AND sla_breached) AS breached, coalesce(avg(delay_min) FILTER (done), 0) AS delay,
      coalesce(sum(weather_delay_min/60*38 + CASE WHEN sla_breached AND weather_class <> 'none' THEN {sla('tier')} ELSE 0 END) FILTER (done), 0) AS cost_done
      FROM (SELECT *, coalesce(status = 'delivered' AND CAST(delivered_at AS DATE) = DATE '2024-01-15', false) AS done FROM b_orders)) d,
    (SELECT count(*) AS in_transit, count(*) FILTER (exposed) AS weather_exposed, count(*) FILTER (tdelay >= 5) AS affected_now, count(*) FILTER (eta_at > promised_at) AS late_now,
      coalesce(sum(tdelay/60*38) FILTER (tdelay >= 5), 0) AS cost_now FROM ({_EXPOSURE})) m,
    (SELECT count(*) FILTER (status = 'in_transit') AS active_trips, count(*) FILTER (status = 'in_transit' AND delay_min >= 15) AS delayed_trips FROM b_trips) t,
    (SELECT coalesce(sum(orders) FILTER (dispatch <= {NOW} + INTERVAL 24 HOUR AND p_breach >= 0.5), 0) AS at_risk FROM b_risk) k,
    (SELECT string_agg(city_id, ',' ORDER BY city_id) AS wet_cities FROM b_weather WHERE severity <> 'none') wc"""
_TOP3 = "SELECT * FROM b_ri ORDER BY avg_delay_min DESC, route_id LIMIT 3"
_ALERTS = f"""SELECT 'high' AS level, 'network' AS kind, CAST(NULL AS VARCHAR) AS id, CAST(12 AS INTEGER) AS window_h, 'Heavy rain threatens orders leaving within 12 h: '||format('{{:,}}', heavy_exposed) AS text
      FROM ({_SUMMARY}) WHERE horizon_h = 12 AND heavy_exposed > 0
    UNION ALL SELECT 'high', 'route', (SELECT route_id FROM b_ri ORDER BY delayed_trips DESC, in_transit DESC, route_id DESC LIMIT 1), NULL, 'Trips held up by rain: '||delayed_trips FROM ({_KPI}) WHERE delayed_trips > 0
    UNION ALL SELECT 'medium', 'route', first(route_id ORDER BY avg_delay_min DESC, route_id), NULL, 'Slowest routes: '||string_agg(code||' '||{whole('avg_delay_min')}||' min', '; ' ORDER BY avg_delay_min DESC, route_id) FROM ({_TOP3}) WHERE avg_delay_min >= 15 HAVING count(*) > 0
    UNION ALL (SELECT 'medium', 'route', route_id, 24, 'Promises at risk on '||code||': '||sla_risk FROM (SELECT * FROM b_ri ORDER BY sla_risk DESC, route_id LIMIT 2) WHERE sla_risk >= 5)
    UNION ALL SELECT 'info', 'warehouse', id, 12, 'Largest share of exposed orders: '||name||', '||{whole('exposed/total*100')}||'%' FROM
      (SELECT * FROM (SELECT id, exposed, sum(exposed) OVER () AS total FROM b_roll WHERE level = 'warehouse') ORDER BY exposed DESC, id LIMIT 1) JOIN b_wh ON warehouse_id = id WHERE total > 0 AND exposed/total >= 0.25"""


# ---- scenarios: reroute only, and all levers -------------------------------
def _scenario(shift, reroute, hub, scale):
    """CTEs x0..xe giving each cohort's chosen trip."""
    local = f"SELECT 'LOCAL-'||city_id AS route_id, city_id, 'local' AS role, 35.0::DOUBLE AS distance_km, {r('greatest(0.7::DOUBLE, sensitivity - 0.1::DOUBLE)', 2)} AS sensitivity, [city_id] AS path, 2.0::DOUBLE + 35.0::DOUBLE/50 AS normal_eta_h FROM b_routes WHERE role = 'primary' AND city_id = '{hub}'"
    every = "SELECT route_id, city_id, role, distance_km, sensitivity, path, normal_eta_h FROM b_routes" + (f" UNION ALL {local}" if hub else "")
    is_local = f"city_id = '{hub}'" if hub else "false"
    k = f"{min(1.0, abs(scale - 1))}::DOUBLE"
    p = [f"prob_{c}" for c in ("none", "rain", "heavy", "extreme")]
    scaled = (f"{p[0]} - {p[0]}*{k} AS prob_none, {p[1]} - {p[1]}*{k} + {p[0]}*{k} AS prob_rain, {p[2]} - {p[2]}*{k} + {p[1]}*{k} AS prob_heavy, {p[3]} + {p[2]}*{k} AS prob_extreme"
              if scale > 1 else ", ".join(p))
    wet = "1 - prob_none" if scale != 1 else r("1 - prob_none", 4)
    move = "base.exposed_share > 0 AND coalesce(spare.weight < base.weight, false)" if reroute else "false"
    pick = lambda c: f"CASE WHEN {move} THEN spare.{c} ELSE base.{c} END AS {c}"
    return f"""x_every AS ({every}),
    x_plan AS (SELECT CASE WHEN {is_local} THEN 'LOCAL-'||city_id ELSE route_id END AS route_id, city_id, tier, greatest({NOW}, dispatch + INTERVAL {shift} HOUR) AS dispatch, orders, {is_local} AS local FROM b_cohort),
    x_alt AS (SELECT a.route_id, b.route_id AS alt FROM b_routes a JOIN b_routes b ON a.city_id = b.city_id AND a.route_id <> b.route_id),
    x_legs AS (SELECT route_id, dispatch FROM x_plan UNION SELECT alt, dispatch FROM x_plan JOIN x_alt USING (route_id)),
    x_th AS (SELECT t.route_id, t.dispatch, hours, step, path[least(len(path)-1, CAST(round_even(step/greatest(1, hours-1)*(len(path)-1), 0) AS BIGINT)) + 1] AS city_id, dispatch + to_hours(step) AS at
      FROM (SELECT *, CAST(unnest(range(hours)) AS INTEGER) AS step FROM (SELECT l.*, e.path, greatest(1, CAST(floor(e.normal_eta_h + 0.999::DOUBLE) AS INTEGER)) AS hours FROM x_legs l JOIN x_every e USING (route_id))) t),
    x_f0 AS (SELECT t.*, {rank('(' + hourly('coalesce(h.mm, 0)') + ')')} AS rk, greatest(0.0::DOUBLE, (epoch_us(at) - epoch_us({NOW}))/3.6e9) AS lead_h FROM x_th t LEFT JOIN b_hourly h ON h.city_id = t.city_id AND h.hour = date_trunc('hour', at)),
    x_f1 AS (SELECT route_id, dispatch, step, hours, {scaled} FROM (SELECT *, {probs('rk', 'lead_h')} FROM x_f0)),
    x_f2 AS (SELECT *, {wet} AS wet, {expected(WEIGHTS)} AS w FROM x_f1),
    x_exp AS (SELECT w.*, {r('w.w', 4)} AS weight, {r('g.share', 4)} AS exposed_share, e.distance_km, e.sensitivity, e.normal_eta_h FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, dispatch ORDER BY w DESC, step) AS n FROM x_f2) WHERE n = 1) w
      JOIN (SELECT route_id, dispatch, avg(CASE WHEN wet >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM x_f2 GROUP BY 1, 2) g USING (route_id, dispatch) JOIN x_every e USING (route_id)),
    x_pick AS (SELECT p.city_id, p.tier, p.dispatch, p.orders, p.local, {move} AS rerouted, CASE WHEN {move} THEN greatest(0.0::DOUBLE, spare.distance_km - base.distance_km) ELSE 0.0::DOUBLE END AS extra_km,
      {', '.join(pick(c) for c in ('route_id', 'weight', 'exposed_share', 'distance_km', 'sensitivity', 'normal_eta_h', *p))}
      FROM x_plan p JOIN x_exp base USING (route_id, dispatch) LEFT JOIN x_alt a ON a.route_id = p.route_id LEFT JOIN x_exp spare ON spare.route_id = a.alt AND spare.dispatch = p.dispatch),
    x_eval AS (SELECT *, normal_eta_h*({expected(MULTS)} - 1)*sensitivity AS delay_h, {breach('normal_eta_h', 'tier', 'sensitivity', 'weight', 'distance_km')} AS p_breach, {expected(FAILS)} AS p_failed FROM x_pick)"""


def _totals(hub):
    cost = f"sum(orders*delay_h*38) + sum(orders*p_breach*{sla('tier')}) + sum(orders*p_failed*220) + coalesce(sum(orders*extra_km*0.15::DOUBLE) FILTER (rerouted), 0) + {300000 if hub else 0}"
    n = "CAST(coalesce(sum(orders) FILTER ({}), 0) AS BIGINT)"
    return f"""SELECT CAST(sum(orders) AS BIGINT) AS orders, {n.format('exposed_share > 0')} AS exposed, {n.format('delay_h*60 >= 45')} AS late, {whole('sum(orders*p_breach)')} AS sla_breaches,
    {r('sum(orders*delay_h*60)/greatest(1, sum(orders))', 1)} AS avg_delay_min, {whole(cost)} AS cost_inr, {whole('sum(orders*delay_h*38)')} AS cost_delay, {whole(f"sum(orders*p_breach*{sla('tier')})")} AS cost_sla,
    {whole('sum(orders*p_failed*220)')} AS cost_reship, {whole(f"coalesce(sum(orders*extra_km*0.15::DOUBLE) FILTER (rerouted), 0) + {300000 if hub else 0}")} AS cost_ops,
    {n.format('rerouted')} AS rerouted, {n.format('local')} AS local FROM x_eval"""


_ALL = (2, True, "C2", 1.5)
_CURRENT = f"(WITH {_scenario(0, False, None, 1.0)} {_totals(None)})"
_SIMULATED = f"(WITH {_scenario(*_ALL)} {_totals('C2')})"
_BOTH = f"SELECT *, 'current' AS variant FROM {_CURRENT} UNION ALL SELECT *, 'simulated' AS variant FROM {_SIMULATED}"
_DRILL = " UNION ALL ".join(
    [f"SELECT c.city_id AS id, c.name AS label, coalesce(l.score, 0) AS score, coalesce(l.orders, 0) AS orders, 'ASIA' AS parent FROM b_city c LEFT JOIN b_roll l ON l.level = 'city' AND l.id = c.city_id WHERE c.state = 'ASIA'"]
    + [f"SELECT r.route_id, r.code, coalesce(i.score, 0), coalesce(i.orders, 0), '{v}' FROM b_routes r LEFT JOIN b_ri i USING (route_id) WHERE r.{k} = '{v}'"
       for k, v in (("city_id", "C2"), ("warehouse_id", "W0"), ("hub_id", "H3"))])

SQL = {
    "filter_upcoming": f"SELECT order_id, route_id, tier, status, planned_dispatch FROM b_upcoming WHERE planned_dispatch <= {NOW} + INTERVAL 24 HOUR",
    "cohorts": "SELECT * FROM b_cohort",
    "trip_hours": "SELECT * FROM b_th",
    "join_trip_weather": f"SELECT route_id, dispatch, step, hours, city_id, at, {r('mm', 4)} AS mm, {hourly('mm')} AS class FROM b_fc0",
    "trip_exposure": "SELECT * FROM b_exp",
    "actual_trip_class": f"SELECT route_id, dispatch, {class_of('max(rk)')} AS class FROM b_fc0 GROUP BY 1, 2",
    "weather_eta": f"""SELECT r.route_id, s.severity AS class, {r('normal_eta_h*(1 + (' + mult('s.severity') + ' - 1)*sensitivity)', 2)} AS eta_h,
        {r('(normal_eta_h*(1 + (' + mult('s.severity') + ' - 1)*sensitivity) - normal_eta_h)*60', 2)} AS delay_min, s.rows FROM b_routes r JOIN (SELECT route_id, severity, count(*) AS rows FROM b_star GROUP BY 1, 2) s USING (route_id)""",
    "expected_delay": f"SELECT e.route_id, e.dispatch, {r(expected(WEIGHTS), 6)} AS expected_weight, {r(f'r.normal_eta_h*({expected(MULTS)} - 1)*r.sensitivity*60', 4)} AS expected_delay_min FROM b_exp e JOIN b_routes r USING (route_id)",
    "warehouse_load": f"SELECT warehouse_id, orders, exposed, {r('load_share', 6)} AS exposed_share FROM b_load",
    "breach_probability": "SELECT route_id, tier, dispatch, p_breach FROM b_scored",
    "risk_score": f"SELECT route_id, tier, dispatch, place, key, label, points, CAST(cap AS INTEGER) AS cap, detail FROM ({_RANKED})",
    "sort_contributions": f"SELECT route_id, tier, dispatch, place, key, points FROM ({_RANKED})",
    "cohort_risk": f"SELECT {_RISK} FROM b_risk",
    "replace_predictions": "SELECT route_id, tier, dispatch AS dispatch_hour, orders, score, category, expected_class, p_rain, expected_delay_min, p_breach, 7 AS contributions FROM b_risk",
    "order_risk": "SELECT order_id, score, category, p_breach FROM b_orders o JOIN b_risk p ON p.route_id = o.route_id AND p.tier = o.tier AND p.dispatch = o.planned_dispatch",
    "future_summary": _SUMMARY,
    "stream_tick": _SUMMARY,
    "risk_timeline": _TIMELINE,
    "timeline_2h": f"""SELECT CAST(step//2 AS BIGINT) AS wave, min(hour) AS hour, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(high_plus) AS BIGINT) AS high_plus, CAST(sum(sla_breaches) AS BIGINT) AS sla_breaches,
        max(rain_probability) AS rain_probability, {r('CASE WHEN sum(orders) > 0 THEN sum(avg_score*orders)/sum(orders) ELSE 0 END', 2)} AS avg_score FROM ({_TIMELINE}) GROUP BY 1""",
    "latest_city_weather": "SELECT * FROM b_weather",
    "merge_current_weather": "SELECT w.*, l.score AS impact_score FROM b_weather w JOIN b_roll l ON l.level = 'city' AND l.id = w.city_id",
    "wet_cities": "SELECT city_id FROM b_weather WHERE severity <> 'none'",
    "join_live_exposure": f"SELECT order_id, trip_id, near, coalesce(tdelay, 0) AS trip_delay_min, exposed FROM ({_EXPOSURE})",
    "live_kpis": _KPI,
    "route_impact_live": "SELECT * FROM b_ri",
    "impact_rollup": "SELECT * FROM b_roll",
    "union_levels": "SELECT * FROM b_levels",
    "join_live_structural": "SELECT * FROM b_blend",
    "blended_impact_index": f"""SELECT state, CAST(sum(orders) AS BIGINT) AS orders, {r('CASE WHEN sum(orders) > 0 THEN sum(impact_index*orders)/sum(orders) ELSE avg(impact_index) END', 1)} AS impact_index,
        {r('CASE WHEN sum(orders) > 0 THEN sum(historical_score*orders)/sum(orders) ELSE avg(historical_score) END', 1)} AS historical_score FROM b_blend GROUP BY 1""",
    "join_drilldown": _DRILL,
    "top_by_level": """SELECT level, CAST(place AS INTEGER) AS place, id, score, orders FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, orders DESC, id) AS place FROM b_levels WHERE level <> 'hub')
        WHERE place <= CASE level WHEN 'state' THEN 6 WHEN 'city' THEN 6 WHEN 'route' THEN 8 ELSE 5 END""",
    "critical_orders": """SELECT order_id, route_id, tier, dispatch AS planned_dispatch, score, category, expected_class, p_rain, expected_delay_min, p_breach, "similar" FROM b_risk JOIN
        (SELECT route_id, tier, planned_dispatch AS dispatch, min(order_id) AS order_id, count(*) - 1 AS "similar" FROM b_orders WHERE status IN ('scheduled','assigned') GROUP BY 1, 2, 3) USING (route_id, tier, dispatch)
        WHERE category IN ('High','Critical') ORDER BY score DESC, dispatch, order_id LIMIT 12""",
    "alerts": _ALERTS,
    "join_future_orders": "SELECT * EXCLUDE (state) FROM b_future",
    "filter_future": f"SELECT order_id, route, tier, planned_dispatch, score FROM b_future WHERE planned_dispatch BETWEEN {NOW} AND {NOW} + INTERVAL 24 HOUR AND status IN ('scheduled','assigned') AND tier = 'standard' AND (order_id ILIKE '%nation_1%' OR route ILIKE '%nation_1%')",
    "page_future": f"""SELECT * EXCLUDE (state), (SELECT count(*) FROM b_future WHERE state = 'ASIA' AND status IN ('scheduled','assigned') AND planned_dispatch BETWEEN {NOW} AND {NOW} + INTERVAL 48 HOUR) AS total FROM b_future
        WHERE state = 'ASIA' AND status IN ('scheduled','assigned') AND planned_dispatch BETWEEN {NOW} AND {NOW} + INTERVAL 48 HOUR ORDER BY p_breach DESC, order_id LIMIT 25 OFFSET 25""",
    "next_page": f"""SELECT * EXCLUDE (state) FROM b_future
        WHERE state = 'ASIA' AND status IN ('scheduled','assigned') AND planned_dispatch BETWEEN {NOW} AND {NOW} + INTERVAL 48 HOUR ORDER BY p_breach DESC, order_id LIMIT 25 OFFSET 25""",
    "join_route_orders_left": """SELECT order_id, o.tier, status, planned_dispatch, promised_at, score, category, expected_delay_min, p_breach FROM b_orders o LEFT JOIN b_risk p ON p.route_id = o.route_id AND p.tier = o.tier
        AND p.dispatch = o.planned_dispatch WHERE status IN ('scheduled','assigned','in_transit','at_hub') ORDER BY score DESC NULLS LAST, planned_dispatch, order_id LIMIT 100""",
    "join_items_products": f"SELECT p_name AS name, count(*) AS lines, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS qty, {r('sum(l_extendedprice)', 2)} AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "search_entities": """(SELECT 'order' AS kind, order_id AS id, status AS label FROM b_orders WHERE order_id ILIKE '%12%' ORDER BY order_id LIMIT 6)
        UNION ALL (SELECT 'route', route_id, code FROM b_routes WHERE code ILIKE '%12%' OR replace(code, ' → ', '-') ILIKE '%12%' OR route_id ILIKE '%12%' ORDER BY code, route_id LIMIT 6)
        UNION ALL (SELECT 'city', city_id, name FROM b_city WHERE name ILIKE '%12%' OR city_id ILIKE '%12%' OR state ILIKE '%12%' ORDER BY name, city_id LIMIT 6)
        UNION ALL (SELECT 'warehouse', warehouse_id, name FROM b_wh WHERE name ILIKE '%12%' OR warehouse_id ILIKE '%12%' ORDER BY name, warehouse_id LIMIT 6)
        UNION ALL (SELECT 'hub', hub_id, name FROM b_hub WHERE name ILIKE '%12%' OR hub_id ILIKE '%12%' ORDER BY name, hub_id LIMIT 6)""",
    "limit_search": """SELECT kind, id, label, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY label, id) AS place FROM
        (SELECT 'order' AS kind, order_id AS id, status AS label FROM b_orders UNION ALL SELECT 'warehouse', warehouse_id, name FROM b_wh)) WHERE place <= 6""",
    "scenario_levers": f"""WITH {_scenario(*_ALL)} SELECT route_id, city_id, tier, dispatch, orders, local, rerouted, {r('extra_km', 3)} AS extra_km, {r('delay_h', 6)} AS delay_h, {r('p_breach', 6)} AS p_breach FROM x_eval""",
    "scenario_totals": f"SELECT * FROM (WITH {_scenario(0, True, None, 1.0)} {_totals(None)})",
    "scenario_eval": _BOTH,
    "scenario_delta": f"""SELECT s.late - c.late AS late, s.sla_breaches - c.sla_breaches AS sla_breaches, s.exposed - c.exposed AS exposed, s.cost_inr - c.cost_inr AS cost_inr,
        {r('s.avg_delay_min - c.avg_delay_min', 1)} AS avg_delay_min FROM {_CURRENT} c, {_SIMULATED} s""",
    "save_scenario": f"SELECT 'run-1' AS run_id, variant, CAST(48 AS INTEGER) AS window_h, orders, exposed, late, cost_inr FROM ({_BOTH})",
    "publish_views": """SELECT 'risk' AS view, count(*) AS rows FROM b_risk UNION ALL SELECT 'future', 4 UNION ALL SELECT 'timeline', 48 UNION ALL SELECT 'impact', count(*) FROM b_levels
        UNION ALL SELECT 'weather', count(*) FROM b_weather""",
}
for _view, _rows in (("kpis", _KPI), ("alerts", _ALERTS), ("top", SQL["top_by_level"]), ("critical", SQL["critical_orders"])):
    SQL["publish_views"] += f" UNION ALL SELECT '{_view}', count(*) FROM ({_rows})"
SQL["publish_views"] += " UNION ALL SELECT 'forecast', 48 * count(*) FROM b_city"
# A twin with its own WITH joins the shared CTE list instead of nesting.
SQL["scenario_levers"] = f"SELECT * FROM ({SQL['scenario_levers']})"
