"""Shared CTEs of the SQL twins."""
import re

NOW = "TIMESTAMP '2024-01-15 06:00:00'"
COEFS = (-1.089, -9.163, 8.7489, -4.2773)
CLASSES = ("none", "rain", "heavy", "extreme")


def r(x, places=0):
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {places}) AS DOUBLE)"


def whole(x):
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), 0) AS BIGINT)"


def by_class(c, values):
    return f"CASE ({c}) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in zip(CLASSES, values)) + " END"


def mult(c):
    return by_class(c, (1.0, 1.12, 1.3, 1.56))


def failed(c):
    return by_class(c, (0, 0.002, 0.008, 0.03))


def rank(c):
    return f"CASE ({c}) WHEN 'none' THEN 0 WHEN 'rain' THEN 1 WHEN 'heavy' THEN 2 WHEN 'extreme' THEN 3 END"


def class_of(n):
    return f"CASE ({n}) WHEN 0 THEN 'none' WHEN 1 THEN 'rain' WHEN 2 THEN 'heavy' WHEN 3 THEN 'extreme' END"


def classed(mm, edges):
    return f"CASE WHEN {mm} >= {edges[2]} THEN 'extreme' WHEN {mm} >= {edges[1]} THEN 'heavy' WHEN {mm} >= {edges[0]} THEN 'rain' ELSE 'none' END"


def daily(mm):
    return classed(mm, (2.5, 64.5, 115.6))


def hourly(mm):
    return classed(mm, (2.5, 7.6, 20.0))


def season(m):
    return (f"CASE WHEN {m} IN (1,2) THEN 'winter' WHEN {m} IN (3,4,5) THEN 'pre-monsoon' "
            f"WHEN {m} IN (6,7,8,9) THEN 'monsoon' ELSE 'post-monsoon' END")


def tier(p):
    return f"CASE WHEN {p}[1] IN ('1','2') THEN 'express' WHEN {p}[1] IN ('3','4') THEN 'standard' ELSE 'economy' END"


def promised(normal, t):
    return f"(CASE {t} WHEN 'express' THEN {normal}*1.25::DOUBLE WHEN 'standard' THEN {normal}*1.5::DOUBLE + 6 ELSE {normal}*2.0::DOUBLE + 18 END)"


def sla(t):
    return f"(CASE {t} WHEN 'express' THEN 150 WHEN 'standard' THEN 60 ELSE 25 END)"


def hours(ts, h):
    return f"make_timestamp(epoch_us({ts}) + CAST(round(({h})*3.6e9) AS BIGINT))"


def minutes(ts, m):
    return f"make_timestamp(epoch_us({ts}) + CAST(round(({m})*6e7) AS BIGINT))"


def haversine(a, b, c, d):
    return (f"(2*6371.0088::DOUBLE*asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c}-({a}))/2),2) + "
            f"cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2)))))")


def destination(lat, lon, bearing, km):
    arc = f"(({km})/6371.0088::DOUBLE)"
    p2 = f"asin(sin(radians({lat}))*cos({arc}) + cos(radians({lat}))*sin({arc})*cos(radians({bearing})))"
    turn = (f"atan2(sin(radians({bearing}))*sin({arc})*cos(radians({lat})), cos({arc}) - sin(radians({lat}))*"
            f"(sin(radians({lat}))*cos({arc}) + cos(radians({lat}))*sin({arc})*cos(radians({bearing}))))")
    return f"degrees({p2})", f"({lon}) + degrees({turn})"


def category(s):
    return f"CASE WHEN {s} >= 75 THEN 'Critical' WHEN {s} >= 50 THEN 'High' WHEN {s} >= 25 THEN 'Medium' ELSE 'Low' END"


def probs(rk, lead):
    """Four forecast probabilities of a class rank and lead."""
    hit = f"greatest(0.5::DOUBLE, 0.9::DOUBLE - 0.0085::DOUBLE*greatest({lead}, 0.0::DOUBLE))"
    out = []
    for i, c in enumerate(CLASSES):
        spill = f"((1 - {hit}) / (CASE WHEN {rk} IN (0,3) THEN 1 ELSE 2 END))"
        value = f"CASE WHEN {rk} = {i} THEN {hit} WHEN abs({rk} - {i}) = 1 THEN {spill} ELSE 0.0::DOUBLE END"
        out.append(f"{r(value, 4)} AS prob_{c}")
    return ", ".join(out)


def expected(values, prefix=""):
    return "(" + " + ".join(f"{prefix}prob_{c}*{v}::DOUBLE" for c, v in zip(CLASSES, values)) + ")"


WEIGHTS, MULTS, FAILS = (0.0, 0.35, 0.7, 1.0), (1.0, 1.12, 1.3, 1.56), (0.0, 0.002, 0.008, 0.03)


def likeliest(classes=CLASSES, prefix=""):
    best = "greatest(" + ", ".join(f"{prefix}prob_{c}" for c in classes) + ")"
    return "CASE " + " ".join(f"WHEN {prefix}prob_{c} = {best} THEN '{c}'" for c in classes) + " END"


def logistic(z):
    return f"(1/(1+exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {z})))))"


def breach(normal, t, sens, weight, km):
    p = promised(normal, t)
    z = (f"{COEFS[0]}::DOUBLE + {COEFS[1]}::DOUBLE*(({p}-{normal})/{normal}) + {COEFS[2]}::DOUBLE*({sens}*{weight}) + "
         f"{COEFS[3]}::DOUBLE*({km}/1000)")
    return logistic(z)


SUMS = ("orders", "exposed", "affected", "delayed", "sla_breaches")
COST = "cost_transport + cost_reship + cost_sla"
MEASURES = (", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS) + ", "
            + r("CASE WHEN sum(affected) > 0 THEN sum(delay_min_sum)/sum(affected) END", 1) + " AS avg_delay_min, "
            + r(f"sum({COST})", 0) + " AS weather_cost")

_HUB_LAT, _HUB_LON = destination("lat", "lon", "(num*37%360)::DOUBLE", "(4 + num%6)::DOUBLE")
_ENV_TYPE = ("CASE event_type WHEN 'signup' THEN 'ORDER_CREATED' WHEN 'view' THEN 'VEHICLE_MOVEMENT' WHEN 'click' THEN 'VEHICLE_DISPATCHED' "
             "WHEN 'purchase' THEN 'DELIVERY_COMPLETED' WHEN 'error' THEN 'DELIVERY_DELAY' END")

CTES = {
    "b_rr": f"""SELECT route_id, date, max(rain_mm) AS rain_mm, {daily("max(rain_mm)")} AS severity FROM (SELECT route_id, unnest(path) AS city_id FROM b_routes)
        JOIN (SELECT city_id, date, max(rain_mm) AS rain_mm FROM b_daily GROUP BY 1, 2) USING (city_id) GROUP BY 1, 2""",
    "b_city": """SELECT 'C'||n_nationkey AS city_id, n_nationkey AS num, n_name AS name, r_name AS state, (8+n_nationkey*7%25)::DOUBLE AS lat,
        (68+n_nationkey*11%25)::DOUBLE AS lon, (1+n_nationkey%10)::DOUBLE AS demand, 0.7::DOUBLE + (n_nationkey%8)*0.1::DOUBLE AS sensitivity
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "b_wh": """SELECT 'W'||s_suppkey AS warehouse_id, s_name AS name, city_id, lat + (s_suppkey%17)*0.03::DOUBLE AS lat,
        lon + (s_suppkey%23)*0.02::DOUBLE AS lon, s_suppkey AS number FROM supplier JOIN b_city ON num = s_nationkey""",
    "b_fc": """SELECT w.* FROM b_wh w JOIN (SELECT city_id, min(number) AS number FROM b_wh GROUP BY 1) l
        ON l.number = w.number""",
    "b_hub": f"""SELECT 'H'||num AS hub_id, name||' delivery hub' AS name, city_id, {r(_HUB_LAT, 4)} AS lat, {r(_HUB_LON, 4)} AS lon FROM b_city""",
    "b_near": f"""SELECT * FROM (SELECT c.city_id, f.warehouse_id, f.city_id AS origin, {haversine('f.lat', 'f.lon', 'c.lat', 'c.lon')} AS km,
        row_number() OVER (PARTITION BY c.city_id ORDER BY {r(haversine('f.lat', 'f.lon', 'c.lat', 'c.lon'), 6)}, f.warehouse_id) AS n
        FROM b_city c, b_fc f) WHERE n <= 2""",
    "b_via": f"""SELECT p.origin, p.city_id, list(p.via ORDER BY da, via) AS via FROM (
        SELECT n.origin, n.city_id, c.city_id AS via, {haversine('a.lat', 'a.lon', 'c.lat', 'c.lon')} AS da, {haversine('b.lat', 'b.lon', 'c.lat', 'c.lon')} AS db,
        {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS len FROM b_near n JOIN b_city a ON a.city_id = n.origin JOIN b_city b ON b.city_id = n.city_id
        JOIN b_city c ON c.city_id <> n.origin AND c.city_id <> n.city_id WHERE n.origin <> n.city_id) p
        WHERE da + db <= len + 90 AND 2*sqrt(greatest((da+db+len)/2*((da+db+len)/2-da)*((da+db+len)/2-db)*((da+db+len)/2-len), 0))/len <= 45 GROUP BY 1, 2""",
    "b_route": f"""SELECT 'R-'||n.origin||'-'||n.city_id AS route_id, a.name||' → '||b.name AS code, n.warehouse_id, h.hub_id, n.origin AS origin_city_id, n.city_id,
        CASE n.n WHEN 1 THEN 'primary' ELSE 'secondary' END AS role, CASE n.n WHEN 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS share,
        {r("CASE WHEN n.origin = n.city_id THEN 35.0::DOUBLE ELSE n.km*1.25::DOUBLE END", 1)} AS distance_km,
        {r("greatest(0.7::DOUBLE, least(1.4::DOUBLE, (a.sensitivity + 2*b.sensitivity)/3 + CASE WHEN n.origin <> n.city_id AND n.km*1.25::DOUBLE > 600 THEN 0.05::DOUBLE ELSE 0 END))", 2)} AS sensitivity,
        CASE WHEN n.origin = n.city_id THEN [n.city_id] ELSE [n.origin] || coalesce(v.via, []) || [n.city_id] END AS path
        FROM b_near n JOIN b_city a ON a.city_id = n.origin JOIN b_city b ON b.city_id = n.city_id JOIN b_hub h ON h.city_id = n.city_id
        LEFT JOIN b_via v ON v.origin = n.origin AND v.city_id = n.city_id""",
    "b_routes": "SELECT *, 2.0::DOUBLE + distance_km/50 AS normal_eta_h FROM b_route",
    "b_category": "SELECT DISTINCT p_type AS category_id, p_type[1]||lower(p_type[2:]) AS name FROM part",
    "b_line": f"""SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS date, greatest(l_quantity*4-60, 0) AS rain_mm,
        greatest(l_quantity*4-60, 0) >= 2.5 AS wet, greatest(l_quantity*4-60, 0) >= 2.5 AND l_returnflag = 'R' AS hit, l_discount*1000 AS slip, l_tax*500 AS other FROM lineitem""",
    "b_fact": f"""SELECT l_orderkey, l_partkey, date, rain_mm, {daily('rain_mm')} AS severity, 1 AS orders, CASE WHEN wet THEN 1 ELSE 0 END AS exposed,
        CASE WHEN hit THEN 1 ELSE 0 END AS affected, CASE WHEN (CASE WHEN hit THEN slip ELSE 0 END) + other >= 30 THEN 1 ELSE 0 END AS delayed,
        CASE WHEN (CASE WHEN hit THEN slip ELSE 0 END) + other >= 60 THEN 1 ELSE 0 END AS sla_breaches, CASE WHEN hit THEN slip ELSE 0 END AS delay_min_sum,
        CASE WHEN hit THEN slip ELSE 0 END/60*38 AS cost_transport, CASE WHEN wet THEN {failed(daily('rain_mm'))}*220 ELSE 0 END AS cost_reship,
        CASE WHEN wet AND (CASE WHEN hit THEN slip ELSE 0 END) + other >= 60 THEN 72.75::DOUBLE ELSE 0 END AS cost_sla FROM b_line""",
    "b_star": """SELECT f.*, r.route_id, r.code AS route_code, r.warehouse_id, r.hub_id, r.city_id, c.name AS city_name, c.state, p_type AS category_id
        FROM b_fact f JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
        JOIN b_routes r ON r.city_id = 'C'||c_nationkey AND r.role = CASE WHEN l_orderkey%4 < 3 THEN 'primary' ELSE 'secondary' END JOIN b_city c ON c.city_id = r.city_id""",
    "b_impact": f"""SELECT route_id, severity, count(DISTINCT date) AS days,
        {r("CASE WHEN sum(affected) > 0 THEN sum(delay_min_sum)/sum(affected) ELSE 0 END/(any_value(normal)*60)", 4)} AS delay_ratio,
        {r("1 - sum(sla_breaches)/greatest(sum(orders), 1)", 4)} AS on_time
        FROM (SELECT s.*, r.normal_eta_h AS normal FROM b_star s JOIN b_routes r USING (route_id)) GROUP BY 1, 2""",
    "b_wide": "SELECT route_id, " + ", ".join(
        f"max(CASE WHEN severity = '{c}' THEN delay_ratio END) AS {c}_delay_ratio, max(CASE WHEN severity = '{c}' THEN on_time END) AS {c}_on_time"
        for c in CLASSES) + " FROM b_impact GROUP BY 1 HAVING count(*) = 4",
    "b_hist": "SELECT r.route_id, " + ", ".join(
        f"coalesce(w.{c}_delay_ratio, ({m}::DOUBLE - 1)*r.sensitivity) AS {c}_delay_ratio, coalesce(w.{c}_on_time, 0.95::DOUBLE) AS {c}_on_time"
        for c, m in zip(CLASSES, MULTS)) + " FROM b_routes r LEFT JOIN b_wide w USING (route_id)",
    "b_daily": f"SELECT 'C'||(o_custkey%25) AS city_id, CAST(o_orderdate AS DATE) AS date, {r('o_totalprice/4000', 1)} AS rain_mm FROM orders",
    "b_hourly": "SELECT 'C'||(user_id%25) AS city_id, date_trunc('hour', ts) AS hour, max(value)/10 AS mm FROM events GROUP BY 1, 2",
    "b_clim": f"""SELECT city_id, CAST(month(date) AS INTEGER) AS month, {season('month(date)')} AS season, count(*) AS days, {r('avg(rain_mm)', 2)} AS mean_mm,
        {r('quantile_cont(rain_mm, 0.5)', 2)} AS median_mm, {r('quantile_cont(rain_mm, 0.75)', 2)} AS p75_mm, {r('quantile_cont(rain_mm, 0.9)', 2)} AS p90_mm,
        {r('avg(CASE WHEN rain_mm >= 2.5 THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS p_rainy, {r('avg(CASE WHEN rain_mm >= 64.5 THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS p_heavy,
        {r('avg(rain_mm)*30.4::DOUBLE', 1)} AS monthly_total_mm FROM b_daily GROUP BY 1, 2, 3""",
    # events as checked messages
    "b_msg": f"""SELECT event_id AS e, event_id%50 AS fault, ts, user_id, value, event_type, unnest(CASE WHEN event_id%97 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM events""",
    "b_parsed": f"""SELECT ts AS kafka_ts, e, value, CASE WHEN fault NOT IN (1, 6) THEN 'E'||e END AS event_id,
        CASE WHEN fault = 6 THEN NULL WHEN fault = 2 THEN 'ORDER_EXPLODED' WHEN fault IN (4, 7) THEN 'WEATHER_EVENT' WHEN fault = 3 THEN 'ORDER_ASSIGNED' ELSE {_ENV_TYPE} END AS type,
        CASE WHEN fault NOT IN (6, 8) THEN ts END AS sim_time, CASE WHEN fault = 6 THEN NULL WHEN fault = 5 THEN TIMESTAMP '2099-01-01' ELSE ts END AS emitted_at,
        CASE WHEN fault NOT IN (3, 6) THEN 'O'||user_id END AS order_id, CASE WHEN fault NOT IN (4, 6, 9) THEN 'C'||(user_id%25) END AS city_id,
        CASE WHEN fault <> 6 THEN 'R'||(user_id%50) END AS route_id, fault FROM b_msg""",
    "b_checked": """SELECT *, CASE WHEN event_id IS NULL OR sim_time IS NULL OR emitted_at IS NULL THEN 'unparseable' WHEN type = 'ORDER_EXPLODED' OR type IS NULL THEN 'unknown_type'
        WHEN type IN ('ORDER_CREATED','ORDER_ASSIGNED','DELIVERY_COMPLETED') AND order_id IS NULL THEN 'missing_order_id'
        WHEN type = 'WEATHER_EVENT' AND city_id IS NULL THEN 'missing_city_id' WHEN emitted_at > TIMESTAMP '2024-02-01 00:02:00' THEN 'future_timestamp' END AS reason FROM b_parsed""",
    "b_clean": "SELECT DISTINCT event_id, type, sim_time, emitted_at, order_id, city_id, route_id, kafka_ts, value FROM b_checked WHERE reason IS NULL",
    "b_window": """SELECT time_bucket(INTERVAL 30 SECOND, emitted_at) AS window_start, time_bucket(INTERVAL 30 SECOND, emitted_at) + INTERVAL 30 SECOND AS window_end,
        coalesce(city_id, 'ALL') AS city_id, count(*) AS events, CAST(count(*) FILTER (type = 'ORDER_CREATED') AS BIGINT) AS created,
        CAST(count(*) FILTER (type = 'VEHICLE_DISPATCHED') AS BIGINT) AS dispatched, CAST(count(*) FILTER (type = 'DELIVERY_COMPLETED') AS BIGINT) AS completed,
        CAST(count(*) FILTER (type = 'DELIVERY_DELAY') AS BIGINT) AS delays, round(avg(value) FILTER (type = 'DELIVERY_COMPLETED'), 4) AS avg_delay_min,
        max(sim_time) AS max_sim_time FROM b_clean GROUP BY 1, 2, 3""",
    # live order book
    "b_plan": f"""SELECT o_orderkey AS k, 'O'||o_orderkey AS order_id, 'U'||o_custkey AS customer_id, o_totalprice AS value_inr, {tier('o_orderpriority')} AS tier,
        ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][o_orderkey%6+1] AS category_id, o_orderkey*7%108 AS wave, o_orderkey//10000 AS block,
        {class_of('((o_orderkey*7%108)*5 + o_orderkey//10000)%4')} AS trip_class, r.*, {hours(NOW, 'o_orderkey*7%108 - 60')} AS planned
        FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN b_routes r ON r.city_id = 'C'||c_nationkey AND r.role = CASE WHEN o_orderkey%4 < 3 THEN 'primary' ELSE 'secondary' END""",
    "b_plan2": f"""SELECT *, {r('normal_eta_h*(' + mult('trip_class') + ' - 1)*sensitivity*60', 0)} AS weather_min, {hours('planned', '-48 - k%5')} AS created_at,
        {hours('planned', promised('normal_eta_h', 'tier'))} AS promised_at, planned - INTERVAL 30 MINUTE AS assign_at, planned + INTERVAL 60 MINUTE AS slip_at,
        'T-'||route_id||'-'||wave||'-'||block AS plan_trip, 'TRK-'||wave||'-'||block AS truck FROM b_plan""",
    "b_plan3": f"SELECT *, {minutes(hours('planned', 'normal_eta_h - 1'), 'weather_min')} AS arrive_at FROM b_plan2",
    "b_plan4": f"SELECT *, {minutes('arrive_at', '60 + k%30')} AS done_at FROM b_plan3",
    "b_book": f"""SELECT p.*, CASE WHEN done_at <= {NOW} THEN 'delivered' WHEN arrive_at <= {NOW} THEN 'at_hub' WHEN planned <= {NOW} THEN 'in_transit'
        WHEN assign_at <= {NOW} THEN 'assigned' ELSE 'scheduled' END AS status, weather_min >= 15 AND slip_at <= {NOW} AS slipped FROM b_plan4 p""",
    "b_orders": f"""SELECT order_id, customer_id, city_id, route_id, warehouse_id, hub_id, category_id, tier, value_inr, CAST(1 + k%3 AS INTEGER) AS items, status, created_at,
        planned AS planned_dispatch, promised_at, CASE WHEN planned <= {NOW} THEN planned END AS dispatched_at,
        CASE WHEN planned <= {NOW} THEN {minutes(hours('planned', 'normal_eta_h'), 'CASE WHEN slipped THEN weather_min ELSE 0 END')} END AS eta_at,
        CASE WHEN status = 'delivered' THEN done_at END AS delivered_at, CASE WHEN assign_at <= {NOW} THEN truck END AS vehicle_id,
        CASE WHEN assign_at <= {NOW} THEN plan_trip END AS trip_id, CASE WHEN status = 'delivered' OR slipped THEN trip_class END AS weather_class,
        CASE WHEN status = 'delivered' THEN weather_min + k%30 END AS delay_min, CASE WHEN status = 'delivered' THEN weather_min END AS weather_delay_min,
        CASE WHEN status = 'delivered' THEN done_at > promised_at END AS sla_breached FROM b_book""",
    "b_trip0": """SELECT plan_trip AS trip_id, any_value(route_id) AS route_id, any_value(truck) AS truck, any_value(planned) AS planned, any_value(arrive_at) AS arrive_at,
        any_value(slip_at) AS slip_at, any_value(assign_at) AS assign_at, any_value(weather_min) AS weather_min, any_value(trip_class) AS trip_class, any_value(path) AS path,
        count(*) FILTER (status <> 'delivered') AS open_orders FROM b_book GROUP BY 1""",
    "b_trip1": f"""SELECT *, epoch_us(arrive_at) - epoch_us(planned) AS span, least(epoch_us({NOW}) - epoch_us(planned), epoch_us(arrive_at) - epoch_us(planned) - 1)//1800000000 AS beats
        FROM b_trip0 WHERE assign_at <= {NOW} AND open_orders > 0""",
    "b_trips": f"""SELECT trip_id, route_id, CASE WHEN planned <= {NOW} THEN truck END AS vehicle_id, CASE WHEN planned <= {NOW} THEN planned END AS dispatched_at,
        CASE WHEN arrive_at <= {NOW} THEN 'at_hub' WHEN planned <= {NOW} THEN 'in_transit' END AS status,
        CASE WHEN weather_min >= 15 AND slip_at <= {NOW} THEN weather_min ELSE 0 END AS delay_min,
        CASE WHEN weather_min >= 15 AND slip_at <= {NOW} THEN trip_class ELSE 'none' END AS cause,
        CASE WHEN planned <= {NOW} AND beats >= 1 THEN path[least(len(path)-1, CAST(round_even(beats*1800000000/span*(len(path)-1), 0) AS BIGINT)) + 1] END AS near_city, open_orders FROM b_trip1""",
    "b_weather": f"""SELECT c.city_id, coalesce(w.mm, 0) AS rain_mmph, {hourly('coalesce(w.mm, 0)')} AS severity, w.hour AS sim_time FROM b_city c LEFT JOIN
        (SELECT city_id, max_by(mm, hour) AS mm, max(hour) AS hour FROM b_hourly WHERE hour <= {NOW} GROUP BY 1) w USING (city_id)""",
    # cohorts, exposure, risk
    "b_upcoming": f"SELECT * FROM b_orders WHERE status IN ('scheduled','assigned') AND planned_dispatch BETWEEN {NOW} AND {NOW} + INTERVAL 48 HOUR",
    "b_cohort": "SELECT route_id, city_id, tier, planned_dispatch AS dispatch, count(*) AS orders FROM b_upcoming GROUP BY 1, 2, 3, 4",
    "b_legs": "SELECT DISTINCT route_id, dispatch FROM b_cohort",
    "b_th0": "SELECT t.*, r.path, greatest(1, CAST(floor(r.normal_eta_h + 0.999::DOUBLE) AS INTEGER)) AS hours FROM b_legs t JOIN b_routes r USING (route_id)",
    "b_th": """SELECT route_id, dispatch, hours, step, path[least(len(path)-1, CAST(round_even(step/greatest(1, hours-1)*(len(path)-1), 0) AS BIGINT)) + 1] AS city_id,
        dispatch + to_hours(step) AS at FROM (SELECT *, CAST(unnest(range(hours)) AS INTEGER) AS step FROM b_th0)""",
    "b_fc0": f"""SELECT t.*, coalesce(h.mm, 0) AS mm, {rank('(' + hourly('coalesce(h.mm, 0)') + ')')} AS rk,
        greatest(0.0::DOUBLE, (epoch_us(date_trunc('hour', at)) - epoch_us({NOW}))/3.6e9) AS lead_h FROM b_th t LEFT JOIN b_hourly h ON h.city_id = t.city_id AND h.hour = date_trunc('hour', at)""",
    "b_fc1": f"SELECT *, {probs('rk', 'lead_h')} FROM b_fc0",
    "b_fc2": f"SELECT *, {r('1 - prob_none', 4)} AS wet, {expected(WEIGHTS)} AS w FROM b_fc1",
    "b_worst": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, dispatch ORDER BY w DESC, step) AS n FROM b_fc2) WHERE n = 1",
    "b_exp": f"""SELECT w.route_id, w.dispatch, w.prob_none, w.prob_rain, w.prob_heavy, w.prob_extreme, {r('w.w', 4)} AS weight, {likeliest(prefix='w.')} AS expected_class,
        {r('g.p_rain', 4)} AS p_rain_max, {r('g.share', 4)} AS exposed_share, g.last AS delivery_p_rain, w.hours FROM b_worst w JOIN
        (SELECT route_id, dispatch, max(wet) AS p_rain, avg(CASE WHEN wet >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS share, max_by(wet, step) AS last FROM b_fc2 GROUP BY 1, 2) g
        USING (route_id, dispatch)""",
    "b_ce": "SELECT c.*, e.* EXCLUDE (route_id, dispatch), r.code, r.warehouse_id, r.distance_km, r.sensitivity, r.normal_eta_h FROM b_cohort c JOIN b_exp e USING (route_id, dispatch) JOIN b_routes r USING (route_id)",
    "b_load": "SELECT warehouse_id, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(CASE WHEN exposed_share > 0 THEN orders ELSE 0 END) AS BIGINT) AS exposed, sum(CASE WHEN exposed_share > 0 THEN orders ELSE 0 END)/greatest(sum(orders), 1) AS load_share FROM b_ce GROUP BY 1",
    "b_in": f"""SELECT x.*, l.load_share, h.* EXCLUDE (route_id), {promised('normal_eta_h', 'tier')} - normal_eta_h AS slack_h,
        normal_eta_h*({expected(MULTS)} - 1)*sensitivity AS delay_h, {likeliest(CLASSES[1:])} AS wet_class, hour(dispatch) + 5.5::DOUBLE + normal_eta_h AS ch
        FROM b_ce x JOIN b_load l USING (warehouse_id) JOIN b_hist h USING (route_id)""",
    "b_in2": """SELECT *, ch - 24*floor(ch/24) AS arrival, CASE wet_class WHEN 'rain' THEN rain_delay_ratio WHEN 'heavy' THEN heavy_delay_ratio ELSE extreme_delay_ratio END AS wet_ratio FROM b_in""",
    "b_raw": """SELECT *, arrival >= 17 OR arrival < 6 AS evening, 30*weight AS raw_rainfall, 20*(p_rain_max*least(1.0::DOUBLE, wet_ratio/0.5)) AS raw_route_history,
        15*(exposed_share*(0.5::DOUBLE + 0.5::DOUBLE*least(1.0::DOUBLE, normal_eta_h/10))) AS raw_exposure, 10*least(1.0::DOUBLE, load_share/0.6) AS raw_load,
        8*(delivery_p_rain*CASE WHEN arrival >= 17 OR arrival < 6 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS raw_timing,
        12*CASE WHEN slack_h > 0 THEN least(1.0::DOUBLE, delay_h/slack_h) ELSE 1.0::DOUBLE END AS raw_sla,
        5*least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - none_on_time)/0.25) AS raw_performance FROM b_in2""",
    "b_scored": f"""SELECT *, {r('least(100.0::DOUBLE, raw_rainfall + raw_route_history + raw_exposure + raw_load + raw_timing + raw_sla + raw_performance)', 1)} AS score,
        {whole('delay_h*60')} AS expected_delay_min, {r(breach('normal_eta_h', 'tier', 'sensitivity', 'weight', 'distance_km'), 4)} AS p_breach FROM b_raw""",
    "b_risk": f"SELECT route_id, tier, dispatch, city_id, warehouse_id, orders, score, {category('score')} AS category, expected_class, p_rain_max AS p_rain, expected_delay_min, p_breach FROM b_scored",
    "b_ri0": f"""SELECT route_id, coalesce(orders, 0) AS orders, coalesce(exposed, 0) AS exposed, coalesce(score_sum, 0) AS score_sum, coalesce(delay_sum, 0) AS delay_sum,
        coalesce(breaches, 0) AS breaches, coalesce(in_transit, 0) AS in_transit, coalesce(delayed_trips, 0) AS delayed_trips FROM
        (SELECT route_id, sum(orders) AS orders, sum(CASE WHEN p_rain >= 0.5 THEN orders ELSE 0 END) AS exposed, sum(score*orders) AS score_sum,
          sum(expected_delay_min*orders) AS delay_sum, sum(p_breach*orders) AS breaches FROM b_risk WHERE dispatch <= {NOW} + INTERVAL 12 HOUR GROUP BY 1) a
        FULL JOIN (SELECT route_id, sum(open_orders) AS in_transit, count(*) FILTER (delay_min >= 15) AS delayed_trips FROM b_trips WHERE status = 'in_transit' GROUP BY 1) t USING (route_id)""",
    "b_ri1": f"""SELECT i.*, r.code, r.city_id, r.warehouse_id, r.hub_id, w.severity AS rain_now,
        least(100.0::DOUBLE, score_sum/greatest(1, orders) + 10*least(1, delayed_trips) + 5*{rank('w.severity')}) AS raw FROM b_ri0 i JOIN b_routes r USING (route_id) JOIN b_weather w ON w.city_id = r.city_id""",
    "b_ri": f"""SELECT route_id, code, city_id, warehouse_id, hub_id, {r('raw', 1)} AS score, {category('raw')} AS category, CAST(orders AS BIGINT) AS orders, CAST(exposed AS BIGINT) AS exposed,
        {r('delay_sum/greatest(1, orders)', 1)} AS avg_delay_min, {whole('breaches')} AS sla_risk, CAST(in_transit AS BIGINT) AS in_transit, CAST(delayed_trips AS BIGINT) AS delayed_trips, rain_now FROM b_ri1""",
    "b_places": """SELECT 'city' AS level, city_id AS id FROM b_city UNION ALL SELECT DISTINCT 'state', state FROM b_city UNION ALL SELECT 'warehouse', warehouse_id FROM b_wh
        UNION ALL SELECT 'hub', hub_id FROM b_hub""",
    "b_ril": """SELECT i.*, c.state FROM b_ri i JOIN b_city c USING (city_id)""",
    "b_rilev": """SELECT 'city' AS level, city_id AS id, * EXCLUDE (city_id) FROM b_ril UNION ALL BY NAME SELECT 'state' AS level, state AS id, * EXCLUDE (city_id) FROM b_ril
        UNION ALL BY NAME SELECT 'warehouse' AS level, warehouse_id AS id, * EXCLUDE (city_id) FROM b_ril UNION ALL BY NAME SELECT 'hub' AS level, hub_id AS id, * EXCLUDE (city_id) FROM b_ril""",
    "b_roll0": """SELECT level, id, sum(score*orders) AS score_sum, sum(orders) AS orders, sum(exposed) AS exposed, sum(CASE WHEN avg_delay_min >= 30 THEN exposed ELSE 0 END) AS potential_delays,
        sum(avg_delay_min*orders) AS delay_sum, sum(sla_risk) AS sla_risk, sum(in_transit) AS in_transit, max_by(code, {'a': score, 'b': orders, 'c': code}) AS top_route FROM b_rilev GROUP BY 1, 2""",
    "b_roll": f"""SELECT p.level, p.id, {r('CASE WHEN orders > 0 THEN score_sum/orders ELSE 0 END', 1)} AS score, {category('(CASE WHEN orders > 0 THEN score_sum/orders ELSE 0 END)')} AS category,
        CAST(coalesce(orders, 0) AS BIGINT) AS orders, CAST(coalesce(exposed, 0) AS BIGINT) AS exposed, CAST(coalesce(potential_delays, 0) AS BIGINT) AS potential_delays,
        {r('CASE WHEN orders > 0 THEN delay_sum/orders ELSE 0 END', 1)} AS avg_delay_min, CAST(coalesce(sla_risk, 0) AS BIGINT) AS sla_risk, CAST(coalesce(in_transit, 0) AS BIGINT) AS in_transit, top_route
        FROM b_places p LEFT JOIN b_roll0 USING (level, id)""",
    "b_levels": "SELECT 'route' AS level, route_id AS id, score, category, orders, exposed, avg_delay_min, sla_risk, in_transit FROM b_ri UNION ALL SELECT level, id, score, category, orders, exposed, avg_delay_min, sla_risk, in_transit FROM b_roll",
    "b_struct": f"""SELECT city_id AS id, state, CAST(sum(orders) AS BIGINT) AS orders, {r('sum(affected)/sum(orders)', 4)} AS affected_share, {r('sum(delay_min_sum)/sum(orders)', 2)} AS delay_per_order_min,
        {r('sum(sla_breaches)/sum(orders)', 4)} AS breach_rate, {r(f'sum({COST})/sum(orders)', 2)} AS cost_per_order FROM b_star WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1, 2""",
    "b_blend0": "SELECT id, 100*coalesce(cost_per_order, 0)/CASE WHEN (SELECT max(cost_per_order) FROM b_struct) > 0 THEN (SELECT max(cost_per_order) FROM b_struct) ELSE 1 END AS past, affected_share, breach_rate, delay_per_order_min FROM b_struct",
    "b_blend": f"""SELECT l.id, c.state, l.orders, l.score, {r('coalesce(past, 0)', 1)} AS historical_score, {r('0.6::DOUBLE*l.score + 0.4::DOUBLE*coalesce(past, 0)', 1)} AS impact_index,
        affected_share, breach_rate, delay_per_order_min FROM b_roll l LEFT JOIN b_blend0 USING (id) JOIN b_city c ON c.city_id = l.id WHERE l.level = 'city'""",
    "b_future": f"""SELECT o.order_id, r.code AS route, o.route_id, o.city_id, c.name AS city, o.warehouse_id, o.tier, o.category_id, o.value_inr, o.status, o.planned_dispatch, o.promised_at,
        {hours('o.planned_dispatch', 'r.normal_eta_h')} AS eta_at, p.score, p.category, p.expected_class, p.p_rain, p.expected_delay_min, p.p_breach, c.state FROM b_orders o
        JOIN b_risk p ON p.route_id = o.route_id AND p.tier = o.tier AND p.dispatch = o.planned_dispatch JOIN b_routes r ON r.route_id = o.route_id JOIN b_city c ON c.city_id = o.city_id""",
}

_RESERVED = re.compile(r"('(?:[^']|'')*')|\bat\b")  # a column name here, a keyword to the checker; text literals stay as they are
_WORD = re.compile(r"\bb_[a-z0-9]+\b")


def _needs(sql: str, found: dict) -> None:
    for name in _WORD.findall(sql):
        if name in CTES and name not in found:
            _needs(CTES[name], found)
            found[name] = CTES[name]


def quoted(sql: str) -> str:
    return _RESERVED.sub(lambda m: m.group(1) or '"at"', sql)


def complete(sql: str) -> str:
    found: dict = {}
    _needs(sql, found)
    if not found:
        return quoted(sql)
    # Materialised: a chain of CTEs would otherwise be inlined at every mention.
    shared = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in found.items())
    return quoted(f"WITH {shared}\n{sql}")
