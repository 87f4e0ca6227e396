"""Twins of the long-history queries."""
from oracle.parts import COST, MEASURES, SUMS, by_class, mult, promised, r, season, whole

_SUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS)
_YEARLY = f"SELECT CAST(year(date) AS INTEGER) AS year, {MEASURES}, CAST(max(date) - min(date) + 1 AS INTEGER) AS days FROM b_fact GROUP BY 1"
_SEVERITY = (f"SELECT severity, {MEASURES}, {r('CASE WHEN sum(exposed) > 0 THEN sum(delay_min_sum)/sum(exposed) END', 1)} AS delay_per_exposed_min, "
             f"{r('sum(sla_breaches)/sum(orders)', 4)} AS breach_rate FROM b_fact GROUP BY 1")
_CAT = "b_fact JOIN part ON p_partkey = l_partkey"
_MONEY = ", ".join(f"{r(f'sum({c})', 2)} AS {c}" for c in ("delay_min_sum", "cost_transport", "cost_reship", "cost_sla"))

_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erfc(x):
    t = f"(1/(1 + 0.3275911::DOUBLE*abs({x})))"
    poly = "0::DOUBLE"
    for a in reversed(_A):
        poly = f"(({poly}) + {a}::DOUBLE)*{t}"
    return f"(CASE WHEN {x} >= 0 THEN ({poly})*exp(-({x})*({x})) ELSE 2 - ({poly})*exp(-({x})*({x})) END)"


def _over(threshold, mean):
    return f"(CASE WHEN {mean} > 0 THEN 0.5::DOUBLE*{_erfc(f'((ln({threshold}) - (ln({mean}) - 0.045::DOUBLE))/0.3::DOUBLE/sqrt(2.0::DOUBLE))')} ELSE 0 END)"


_BREACH = " + ".join(f"{m}::DOUBLE*" + _over(f"greatest(1e-6, ({promised('normal_eta_h', repr(t))} - normal_eta_h)*60)", "mean_min")
                     for t, m in (("express", 0.2), ("standard", 0.65), ("economy", 0.15)))
_EXPECTED = f"""
SELECT date, route_id, category_id, severity, {r('rain_mm', 1)} AS rain_mm, {r('orders', 3)} AS orders, {r('exposed', 3)} AS exposed, {r('affected', 3)} AS affected,
  {r('least(orders, orders*0.055::DOUBLE + affected*p_late)', 3)} AS delayed, {r('least(orders, orders*0.022::DOUBLE + affected*p_wb)', 3)} AS sla_breaches,
  {r('affected*mean_min', 1)} AS delay_min_sum, {whole('affected*mean_min/60*38')} AS cost_transport,
  {whole('exposed*' + by_class('severity', (0, .002, .008, .03)) + '*220')} AS cost_reship, {whole('affected*p_wb*72.75::DOUBLE')} AS cost_sla FROM (
SELECT *, exposed*{by_class('severity', (0, .45, .8, .95))} AS affected FROM (
SELECT d.*, s.category_id, volume*s.share AS orders, volume*s.share*CASE severity WHEN 'none' THEN 0::DOUBLE WHEN 'rain' THEN greatest(0::DOUBLE, least(0.9::DOUBLE, 0.25::DOUBLE + rain_mm/80)) WHEN 'heavy' THEN 0.9::DOUBLE ELSE 0.97::DOUBLE END AS exposed FROM (
SELECT *, {_over('30.0::DOUBLE', 'mean_min')} AS p_late, {_BREACH} AS p_wb FROM (
SELECT rr.*, r.normal_eta_h, r.normal_eta_h*(1 + ({mult('rr.severity')} - 1)*r.sensitivity)*60 - r.normal_eta_h*60 AS mean_min,
  9000*pow(1.25::DOUBLE, datediff('day', DATE '2021-01-01', date)/365.25::DOUBLE)*[1.04, 1.0, 0.98, 0.99, 1.02, 1.08, 0.92][isodow(date)]::DOUBLE
  *[0.90, 0.92, 0.97, 0.97, 1.0, 0.98, 0.97, 1.02, 1.05, 1.35, 1.30, 1.08][month(date)]::DOUBLE*(c.demand/(SELECT sum(demand) FROM b_city)*r.share) AS volume
FROM b_rr rr JOIN b_routes r USING (route_id) JOIN b_city c ON c.city_id = r.city_id)) d,
(SELECT unnest(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']) AS category_id, unnest([0.18, 0.24, 0.22, 0.16, 0.12, 0.08])::DOUBLE AS share) s))"""

SQL = {
    "join_history_star": "SELECT route_id, route_code, warehouse_id, hub_id, city_id, city_name, state, count(*) AS rows FROM b_star GROUP BY ALL",
    "join_category": f"SELECT p_type AS category_id, p_type[1]||lower(p_type[2:]) AS category_name, count(*) AS rows, CAST(sum(exposed) AS BIGINT) AS exposed FROM {_CAT} GROUP BY 1, 2",
    "agg_measures": f"SELECT p_type AS category_id, severity, {MEASURES} FROM {_CAT} GROUP BY 1, 2",
    "filter_history": f"SELECT city_id, category_id, {MEASURES} FROM b_star WHERE year(date) = 1998 AND month(date) = 7 AND state = 'ASIA' AND severity = 'heavy' GROUP BY 1, 2",
    "filter_monsoon": f"SELECT CAST(month(date) AS INTEGER) AS month, {MEASURES} FROM b_fact WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1",
    "filter_last_12_months": f"""SELECT CAST(date_trunc('month', date) AS DATE) AS month, {MEASURES} FROM b_fact
        WHERE date_trunc('month', date) > date_trunc('month', (SELECT max(date) FROM b_fact)) - INTERVAL 12 MONTH GROUP BY 1""",
    "hist_totals": f"SELECT {MEASURES}, min(date) AS first_day, max(date) AS last_day FROM b_fact",
    "hist_monthly": f"SELECT strftime(date, '%Y-%m') AS month, {MEASURES} FROM b_fact GROUP BY 1",
    "hist_yearly": _YEARLY,
    "hist_seasons": f"SELECT {season('month(date)')} AS season, {MEASURES} FROM b_fact GROUP BY 1",
    "hist_geography": f"SELECT state AS id, min(state) AS name, {MEASURES} FROM b_star GROUP BY 1 ORDER BY weather_cost DESC NULLS LAST, id LIMIT 25",
    "topk_geography": f"SELECT route_id AS id, min(route_code) AS name, {MEASURES} FROM b_star WHERE city_id = 'C2' GROUP BY 1 ORDER BY weather_cost DESC NULLS LAST, id LIMIT 25",
    "hist_categories": f"SELECT p_type AS id, min(p_type[1]||lower(p_type[2:])) AS name, {MEASURES} FROM {_CAT} GROUP BY 1",
    "hist_severity": _SEVERITY,
    "hist_yoy_growth": f"""SELECT year, orders, days, {r('per_day', 4)} AS per_day, {r('per_day/lag(per_day) OVER (ORDER BY year) - 1', 4)} AS growth
        FROM (SELECT *, orders/greatest(days, 1) AS per_day FROM ({_YEARLY}))""",
    "hist_per_1000": f"""SELECT year, orders, {r('weather_cost*1000/orders', 2)} AS cost_per_1000, {r('affected/orders', 4)} AS affected_share, {r('exposed/orders', 4)} AS exposed_share FROM ({_YEARLY})""",
    "hist_heavy_vs_rain": f"""SELECT *, {r('heavy_delay_min/greatest(1.0::DOUBLE, rain_delay_min)', 1)} AS heavy_to_rain FROM (SELECT max(delay_per_exposed_min) FILTER (severity = 'heavy') AS heavy_delay_min,
        max(delay_per_exposed_min) FILTER (severity = 'rain') AS rain_delay_min, max(breach_rate) FILTER (severity = 'none') AS dry_breach_rate,
        max(breach_rate) FILTER (severity = 'heavy') AS heavy_breach_rate FROM ({_SEVERITY}))""",
    "mv_monthly": f"""SELECT CAST(date_trunc('month', date) AS DATE) AS month, route_id, category_id, severity, {_SUM}, {_MONEY}, min(date) AS first_day, max(date) AS last_day FROM b_star GROUP BY 1, 2, 3, 4""",
    "weather_impact": f"""SELECT route_id, severity, count(DISTINCT date) AS days, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(exposed) AS BIGINT) AS exposed, CAST(sum(affected) AS BIGINT) AS affected,
        {r('sum(delay_min_sum)', 2)} AS delay_min_sum, {r(f'sum({COST})', 2)} AS weather_cost FROM b_star GROUP BY 1, 2""",
    "route_weather_impact": "SELECT * FROM b_impact",
    "structural_impact": "SELECT * FROM b_struct",
    "location_history": f"""SELECT strftime(date, '%Y-%m') AS month, {MEASURES} FROM b_star WHERE state = 'ASIA' AND date_trunc('month', date) >
        date_trunc('month', (SELECT max(date) FROM b_star)) - INTERVAL 12 MONTH GROUP BY 1 UNION ALL SELECT 'monsoon', {MEASURES} FROM b_star WHERE state = 'ASIA' AND month(date) BETWEEN 6 AND 9""",
    "options_distinct": """SELECT DISTINCT 'year' AS kind, CAST(year(date) AS VARCHAR) AS id, CAST(year(date) AS VARCHAR) AS label FROM b_fact UNION ALL SELECT DISTINCT 'state', state, state FROM b_city
        UNION ALL SELECT 'city', city_id, name FROM b_city UNION ALL SELECT 'warehouse', warehouse_id, name FROM b_wh UNION ALL SELECT 'hub', hub_id, name FROM b_hub
        UNION ALL SELECT 'route', route_id, code FROM b_routes UNION ALL SELECT 'category', category_id, name FROM b_category
        UNION ALL SELECT 'severity', s, s FROM (SELECT unnest(['none','rain','heavy','extreme']) AS s)""",
    "expected_route_day": _EXPECTED,
    "reset_from_date": "SELECT date, CAST(count(*) AS BIGINT) AS orders FROM b_fact WHERE date < DATE '1999-01-01' GROUP BY 1",
    "materialize_monthly": f"""SELECT month, count(*) AS rows, {_SUM}, {r('sum(delay_min_sum)', 2)} AS delay_min_sum FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, route_id, category_id, severity,
        {_SUM}, sum(delay_min_sum) AS delay_min_sum FROM b_star GROUP BY 1, 2, 3, 4) GROUP BY 1""",
    "src_model": """SELECT *, -1.089::DOUBLE AS coef_0, -9.163::DOUBLE AS coef_1, 8.7489::DOUBLE AS coef_2, -4.2773::DOUBLE AS coef_3 FROM b_wide""",
    "join_route_history": "SELECT * FROM b_hist",
}
