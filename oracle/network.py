"""Twins of the network queries."""
from oracle.parts import haversine, r

_KM = haversine("w.lat", "w.lon", "c.lat", "c.lon")
_LEN = "(da+db+len)/2"
_STOPS = "SELECT route_id, unnest(path) AS city_id, unnest(range(1, len(path)+1)) AS at FROM b_routes"
_LEGS = f"SELECT s.route_id, s.at, a.lat AS lat1, a.lon AS lon1, lead(a.lat) OVER (PARTITION BY s.route_id ORDER BY s.at) AS lat2, lead(a.lon) OVER (PARTITION BY s.route_id ORDER BY s.at) AS lon2 FROM ({_STOPS}) s JOIN b_city a USING (city_id)"
_D = haversine("lat1", "lon1", "lat2", "lon2")
_X = "a*cos(radians(lat1))*cos(radians(lon1)) + b*cos(radians(lat2))*cos(radians(lon2))"
_Y = "a*cos(radians(lat1))*sin(radians(lon1)) + b*cos(radians(lat2))*sin(radians(lon2))"
_Z = "a*sin(radians(lat1)) + b*sin(radians(lat2))"

SQL = {
    "join_two_nearest": f"""SELECT place_id, site_id, {r('km', 3)} AS km, CASE n WHEN 1 THEN 'primary' ELSE 'secondary' END AS role FROM (SELECT c.city_id AS place_id, w.warehouse_id AS site_id,
        {_KM} AS km, row_number() OVER (PARTITION BY c.city_id ORDER BY {r(_KM, 6)}, w.warehouse_id) AS n FROM b_city c, b_wh w) WHERE n <= 2""",
    "join_corridor": f"""SELECT a_id||'>'||b_id AS pair_id, city_id, {r('da', 3)} AS da FROM (SELECT a.city_id AS a_id, b.city_id AS b_id, c.city_id, {haversine('a.lat', 'a.lon', 'c.lat', 'c.lon')} AS da,
        {haversine('b.lat', 'b.lon', 'c.lat', 'c.lon')} AS db, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS len FROM b_city a JOIN b_city b ON a.state = b.state AND a.city_id <> b.city_id
        JOIN b_city c ON c.city_id <> a.city_id AND c.city_id <> b.city_id WHERE a.city_id IN (SELECT city_id FROM b_wh))
        WHERE da + db <= len + 90 AND 2*sqrt(greatest({_LEN}*({_LEN}-da)*({_LEN}-db)*({_LEN}-len), 0))/len <= 45""",
    "route_build": "SELECT * EXCLUDE (path), array_to_string(path, '>') AS path FROM b_route",
    "src_dimensions": """SELECT 'city' AS dimension, city_id AS id, name FROM b_city UNION SELECT 'warehouse', warehouse_id, name FROM b_wh UNION SELECT 'hub', hub_id, name FROM b_hub
        UNION SELECT 'product', 'P'||p_partkey, p_name FROM part UNION SELECT 'customer', 'U'||c_custkey, c_name FROM customer""",
    "join_alternative_route": """SELECT a.route_id, a.city_id, a.role, a.distance_km, b.route_id AS alternative_id, b.role AS alternative_role, b.distance_km AS alternative_km
        FROM b_routes a JOIN b_routes b ON a.city_id = b.city_id AND a.route_id <> b.route_id""",
    "polyline_length_km": f"SELECT route_id AS line_id, {r(f'coalesce(sum({_D}) FILTER (lat2 IS NOT NULL), 0)', 3)} AS km FROM ({_LEGS}) GROUP BY 1",
    "sample_polyline": f"""SELECT line_id, seg, step, {r(f'CASE WHEN step = 0 THEN lat1 ELSE degrees(atan2({_Z}, sqrt(pow({_X}, 2) + pow({_Y}, 2)))) END', 4)} AS lat,
        {r(f'CASE WHEN step = 0 THEN lon1 ELSE degrees(atan2({_Y}, {_X})) END', 4)} AS lon FROM (
        SELECT line_id, seg, CAST(step AS INTEGER) AS step, lat1, lon1, lat2, lon2, CASE WHEN arc > 0 THEN sin((1 - step/parts)*arc)/sin(arc) END AS a, CASE WHEN arc > 0 THEN sin(step/parts*arc)/sin(arc) END AS b FROM (
        SELECT *, unnest(range(parts)) AS step FROM (SELECT route_id AS line_id, CAST(at AS INTEGER) AS seg, lat1, lon1, lat2, lon2, {_D}/6371.0088::DOUBLE AS arc,
        CASE WHEN lat2 IS NULL THEN 1 ELSE greatest(1, CAST(ceil({_D}/50) AS INTEGER)) END AS parts FROM ({_LEGS}))))""",
}
