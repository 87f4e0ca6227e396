"""Twins of the scalar-expression queries."""
from oracle.parts import category, daily, destination, haversine, hourly, promised, r, rank, class_of, season, sla, tier

_LANES = """(SELECT 'W'||l_suppkey AS warehouse_id, 'C'||c_nationkey AS city_id, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) l JOIN b_wh w USING (warehouse_id) JOIN b_city c ON c.city_id = l.city_id"""
_D = haversine("w.lat", "w.lon", "c.lat", "c.lon")
_LAT, _LON = destination("lat", "lon", "(number*37%360)::DOUBLE", "(4 + number%60)::DOUBLE")
_X = "a*cos(radians(lat1))*cos(radians(lon1)) + b*cos(radians(lat2))*cos(radians(lon2))"
_Y = "a*cos(radians(lat1))*sin(radians(lon1)) + b*cos(radians(lat2))*sin(radians(lon2))"
_Z = "a*sin(radians(lat1)) + b*sin(radians(lat2))"
_HOURS = [0.35, 0.2, 0.12, 0.1, 0.12, 0.25, 0.5, 0.8, 1.0, 1.2, 1.4, 1.55, 1.6, 1.5, 1.35, 1.25, 1.2, 1.25, 1.4, 1.6, 1.75, 1.7, 1.3, 0.75]
_DC = rank("(" + daily("rain_mm") + ")")
_T = tier("o_orderpriority")

SQL = {
    "daily_class": f"SELECT {daily('rain_mm')} AS class, count(*) AS rows, min(rain_mm) AS lowest, max(rain_mm) AS highest FROM b_daily GROUP BY 1",
    "hourly_class": f"SELECT {hourly('value/10')} AS class, count(*) AS rows, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1",
    "season_of": f"SELECT {season('month(o_orderdate)')} AS season, count(*) AS orders FROM orders GROUP BY 1",
    "severity_rank": f"SELECT city_id, CAST(sum({_DC}) AS BIGINT) AS rank_sum, max({_DC}) AS worst_rank FROM b_daily GROUP BY 1",
    "worst_class": f"SELECT city_id, CAST(date_trunc('month', date) AS DATE) AS month, {class_of(f'max({_DC})')} AS worst FROM b_daily GROUP BY 1, 2",
    "risk_category": f"SELECT {category('least(100, o_totalprice/5000)')} AS category, count(*) AS orders FROM orders GROUP BY 1",
    "haversine_km": f"SELECT l.warehouse_id, l.city_id, l.lines, {r(_D, 3)} AS km FROM {_LANES}",
    "intermediate_point": f"""SELECT warehouse_id, city_id, {r(f'CASE WHEN arc = 0 THEN lat1 ELSE degrees(atan2({_Z}, sqrt(pow({_X}, 2) + pow({_Y}, 2)))) END', 4)} AS lat,
        {r(f'CASE WHEN arc = 0 THEN lon1 ELSE degrees(atan2({_Y}, {_X})) END', 4)} AS lon FROM (SELECT *, CASE WHEN arc > 0 THEN sin(0.75::DOUBLE*arc)/sin(arc) END AS a, CASE WHEN arc > 0 THEN sin(0.25::DOUBLE*arc)/sin(arc) END AS b
        FROM (SELECT l.warehouse_id, l.city_id, w.lat AS lat1, w.lon AS lon1, c.lat AS lat2, c.lon AS lon2, {_D}/6371.0088::DOUBLE AS arc FROM {_LANES}))""",
    "destination_point": f"SELECT warehouse_id, {r(_LAT, 4)} AS lat, {r(_LON, 4)} AS lon FROM b_wh",
    "normal_eta_h": f"SELECT l_suppkey, {r('sum(2.0::DOUBLE + l_extendedprice/100/50)', 3)} AS hours, {r('max(2.0::DOUBLE + l_extendedprice/100/50)', 4)} AS longest FROM lineitem GROUP BY 1",
    "promised_h": f"SELECT tier, {r('sum(' + promised('normal', 'tier') + ')', 2)} AS promised, {r('sum(normal)', 2)} AS normal FROM (SELECT {_T} AS tier, 2.0::DOUBLE + o_totalprice/1000/50 AS normal FROM orders) GROUP BY 1",
    "expected_orders": f"""SELECT day, placed, {r("9000*pow(1.25::DOUBLE, datediff('day', DATE '2021-01-01', day)/365.25::DOUBLE)*[1.04, 1.0, 0.98, 0.99, 1.02, 1.08, 0.92][isodow(day)]::DOUBLE*[0.90, 0.92, 0.97, 0.97, 1.0, 0.98, 0.97, 1.02, 1.05, 1.35, 1.30, 1.08][month(day)]::DOUBLE", 3)} AS expected
        FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS placed FROM orders GROUP BY 1)""",
    "hourly_share": f"""SELECT ist_hour, events, {r(f'{_HOURS}[ist_hour+1]::DOUBLE/({sum(_HOURS)}::DOUBLE/24)', 6)} AS share FROM (SELECT CAST(hour(ts + INTERVAL 330 MINUTE) AS INTEGER) AS ist_hour, count(*) AS events FROM events GROUP BY 1)""",
    "sla_cost": f"SELECT {_T} AS tier, CAST(sum({sla(_T)}) AS BIGINT) AS cost FROM orders GROUP BY 1",
}
