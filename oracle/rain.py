"""Twins of the rain queries."""
from oracle.parts import WEIGHTS, daily, expected, hourly, probs, r, rank

_FROM = "TIMESTAMP '2024-01-01'"
_FC = f"SELECT city_id, at, lead_h, mm, {probs('rk', 'lead_h')} FROM (SELECT city_id, hour AS at, mm, {rank('(' + hourly('mm') + ')')} AS rk, (epoch_us(hour) - epoch_us({_FROM}))/3.6e9 AS lead_h FROM b_hourly)"
_P = [f"prob_{c}" for c in ("none", "rain", "heavy", "extreme")]


def _scaled(i):
    k = "least(1.0::DOUBLE, abs(scale - 1))"
    up = f"{_P[i]}" + (f" - {_P[i]}*{k}" if i < 3 else "") + (f" + {_P[i-1]}*{k}" if i else "")
    down = f"{_P[i]}" + (f" - {_P[i]}*{k}" if i else "") + (f" + {_P[i+1]}*{k}" if i < 3 else "")
    return f"{r(f'CASE WHEN scale > 1 THEN {up} WHEN scale < 1 THEN {down} ELSE {_P[i]} END', 6)} AS {_P[i]}"


SQL = {
    "weather_history": f"SELECT city_id, date, {daily('rain_mm')} AS severity, count(*) AS readings, max(rain_mm) AS rain_mm FROM b_daily GROUP BY 1, 2, 3",
    "climatology": "SELECT * FROM b_clim",
    "join_climatology_month": "SELECT city_id, name, state, lat, lon, mean_mm, median_mm, p75_mm, p90_mm, p_rainy, p_heavy, monthly_total_mm, season FROM b_city JOIN b_clim USING (city_id) WHERE month = 7",
    "rainfall_by_state": f"""SELECT state, {r('avg(monthly_total_mm)', 1)} AS monthly_total_mm, {r('avg(p_rainy)', 4)} AS p_rainy, {r('avg(p_heavy)', 4)} AS p_heavy, count(*) AS cities
        FROM b_city JOIN b_clim USING (city_id) WHERE month = 7 GROUP BY 1""",
    "climatology_by_city": "SELECT month, mean_mm, p_rainy, p_heavy, monthly_total_mm, season FROM b_clim WHERE city_id = 'C3'",
    "join_route_day_rain": "SELECT * FROM b_rr",
    "forecast_probs": f"SELECT city_id, at, lead_h, {', '.join(_P)}, {r('1 - prob_none', 4)} AS p_rain, {r('mm', 1)} AS mmph FROM ({_FC})",
    "scale_rain": f"SELECT city_id, at, scale, {', '.join(_scaled(i) for i in range(4))} FROM (SELECT *, unnest([0.5, 1.0, 1.4, 2.0])::DOUBLE AS scale FROM ({_FC}))",
    "expected_weight": f"SELECT city_id, at, {r(expected(WEIGHTS), 6)} AS weight FROM ({_FC})",
    "forecast_grid": f"""SELECT city_id, step, hour, {r('1 - prob_none', 4)} AS p_rain, {r('mm', 1)} AS mmph, CASE greatest({', '.join(_P)}) WHEN prob_none THEN 'none' WHEN prob_rain THEN 'rain'
        WHEN prob_heavy THEN 'heavy' ELSE 'extreme' END AS class FROM (SELECT city_id, step, hour, mm, {probs('rk', 'step')} FROM (
        SELECT g.*, coalesce(h.mm, 0) AS mm, {rank('(' + hourly('coalesce(h.mm, 0)') + ')')} AS rk FROM (SELECT city_id, step, TIMESTAMP '2024-01-15 06:00:00' + to_hours(step) AS hour
        FROM (SELECT city_id, CAST(unnest(range(48)) AS INTEGER) AS step FROM b_city)) g LEFT JOIN b_hourly h USING (city_id, hour)))""",
    "src_hourly_rain": f"""SELECT city_id, hour, {r('coalesce(mm, 0)', 4)} AS mm FROM (SELECT city_id, day + to_hours(CAST(h AS INTEGER)) AS hour FROM (SELECT city_id, day, unnest(range(24)) AS h FROM
        (SELECT DISTINCT city_id, date_trunc('day', hour)::TIMESTAMP AS day FROM b_hourly))) LEFT JOIN b_hourly USING (city_id, hour)""",
    "src_daily_rain": f"SELECT city_id, CAST(year(date) AS INTEGER) AS year, {daily('rain_mm')} AS severity, count(*) AS days, {r('avg(rain_mm)', 2)} AS mean_mm FROM b_daily GROUP BY 1, 2, 3",
}
