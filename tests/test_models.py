import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import geo, numeric, rain, score, service
from raincourier.operators import climate, model, network, scenario, scoring, trips

NOW = datetime(2025, 7, 10, 4)
COEFS = (-3.0, -2.0, 6.0, 0.5)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_class_edges(spark):
    mm = [None, 2.4, 2.5, 64.4, 64.5, 115.5, 115.6]
    assert one(spark, *[rain.daily_class(F.lit(m).cast("double")) for m in mm]) == ("none", "none", "rain", "rain", "heavy", "heavy", "extreme")
    assert one(spark, *[rain.hourly_class(F.lit(m)) for m in (2.4, 2.5, 7.6, 20.0)]) == ("none", "rain", "heavy", "extreme")
    assert one(spark, *[rain.season_of(F.lit(m)) for m in (1, 4, 9, 12)]) == ("winter", "pre-monsoon", "monsoon", "post-monsoon")


def test_climatology_golden_month(spark):
    mm = [0, 0, 3, 10, 20, 70, 80, 120, 5, 2, None]
    rows = [("MUM", datetime(2024, 7, i + 1).date(), None if m is None else float(m)) for i, m in enumerate(mm)]
    r = climate.climatology(spark.createDataFrame(rows, "city_id string, date date, rain_mm double")).first()
    assert (r.days, r.mean_mm, r.median_mm, r.p_rainy, r.p_heavy, r.season) == (10, 31.0, 7.5, 0.7, 0.3, "monsoon")
    known = [m for m in mm if m is not None]
    assert (r.p75_mm, r.p90_mm) == (round(np.percentile(known, 75), 2), round(np.percentile(known, 90), 2))


@pytest.mark.parametrize("cls,lead,expected", [
    ("none", 0, (0.9, 0.1, 0, 0)), ("rain", 0, (0.05, 0.9, 0.05, 0)), ("extreme", 48, (0, 0, 0.5, 0.5)), ("heavy", 10, (0, 0.0925, 0.815, 0.0925))])
def test_forecast_spreads_to_neighbours(spark, cls, lead, expected):
    probs = rain.forecast_probs(F.lit(cls), F.lit(float(lead)))
    assert one(spark, *[probs[c] for c in rain.PROBABILITIES]) == pytest.approx(expected)


def test_scaled_rain_moves_mass_and_keeps_the_total(spark):
    p = {c: F.lit(v) for c, v in zip(rain.PROBABILITIES, (0.4, 0.3, 0.2, 0.1))}
    assert one(spark, *rain.scale_rain(p, 2.0).values()) == pytest.approx((0.0, 0.4, 0.3, 0.3))
    assert one(spark, *rain.scale_rain(p, 0.5).values()) == pytest.approx((0.55, 0.25, 0.15, 0.05))
    assert one(spark, *rain.scale_rain(p, 1.0).values()) == pytest.approx((0.4, 0.3, 0.2, 0.1))


def test_rounding_ignores_float_noise(spark):
    assert one(spark, numeric.rounded(F.lit(0.285), 2), numeric.rounded(F.lit(0.1) + F.lit(0.2), 1)) == (0.29, 0.3)


@pytest.mark.parametrize("x", [-3.0, -0.4, 0.0, 0.7, 2.5])
def test_erfc(spark, x):
    assert one(spark, numeric.complementary_error(F.lit(x)))[0] == pytest.approx(math.erfc(x), abs=2e-7)


def test_distances(spark):
    km = geo.haversine_km(*map(F.lit, (28.61, 77.21, 19.08, 72.88)))
    lat, lon = geo.destination_point(F.lit(19.0), F.lit(73.0), F.lit(90.0), F.lit(10.0))
    back = geo.haversine_km(F.lit(19.0), F.lit(73.0), lat, lon)
    same = geo.haversine_km(*map(F.lit, (19.0, 73.0, 19.0, 73.0)))
    got = one(spark, km, back, same)
    assert got[0] == pytest.approx(1148, abs=10) and got[1] == pytest.approx(10, abs=0.01) and got[2] == 0


def test_polyline_is_densified_and_keeps_vertices(spark):
    lon = 99.99 / 111.195
    lines = spark.createDataFrame([("a", [(0.0, 0.0), (0.0, lon)]), ("b", [(1.0, 2.0)])], "line_id string, points array<struct<lat double, lon double>>")
    rows = network.sample_polyline(lines, 5.0).orderBy("line_id", "seg", "step").collect()
    a = [(r.lat, r.lon) for r in rows if r.line_id == "a"]
    assert len(a) == 21 and a[0] == (0.0, 0.0) and a[-1] == (0.0, lon)
    assert [(r.lat, r.lon) for r in rows if r.line_id == "b"] == [(1.0, 2.0)]
    gaps = np.diff([p[1] for p in a]) * 111.195
    assert gaps.max() <= 5.01


def _km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * S.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(5)
    # spread points, a dense cluster, the poles and both sides of the date line
    places = [(float(a), float(o)) for a, o in zip(rng.uniform(-80, 80, 40), rng.uniform(-180, 180, 40))] + [(89.9, 10.0), (0.0, 179.99), (0.0, -179.99)]
    sites = [(float(a), float(o)) for a, o in zip(rng.uniform(-80, 80, 30), rng.uniform(-180, 180, 30))]
    sites += [(10 + float(d), 20 + float(d)) for d in rng.uniform(0, 0.01, 60)] + [(10.0, 20.0)] * 3
    return places, sites


def test_nearest_two_equals_brute_force(spark, world):
    places, sites = world
    p = spark.createDataFrame([(f"p{i}", *x) for i, x in enumerate(places)], "place_id string, lat double, lon double")
    s = spark.createDataFrame([(f"s{i:03d}", *x) for i, x in enumerate(sites)], "site_id string, lat double, lon double")
    got = {(r.place_id, r.role): r.site_id for r in network.nearest_two(p, s).collect()}
    for i, place in enumerate(places):
        order = sorted((round(_km(x, place), 6), f"s{j:03d}") for j, x in enumerate(sites))
        assert (got[(f"p{i}", "primary")], got[(f"p{i}", "secondary")]) == (order[0][1], order[1][1])


def test_corridor_equals_brute_force(spark, world):
    places, _ = world
    ids = [f"c{i:02d}" for i in range(len(places))]
    cities = spark.createDataFrame([(c, *x) for c, x in zip(ids, places)], "city_id string, lat double, lon double")
    pairs = [(a, b) for a in range(0, 20) for b in range(20, 40)]
    rows = [(f"{ids[a]}>{ids[b]}", ids[a], *places[a], ids[b], *places[b]) for a, b in pairs]
    got = {(r.pair_id, r.city_id) for r in network.corridor(
        spark.createDataFrame(rows, "pair_id string, a_id string, a_lat double, a_lon double, b_id string, b_lat double, b_lon double"), cities, 400.0).collect()}
    want = set()
    for a, b in pairs:
        length = _km(places[a], places[b])
        for c, x in enumerate(places):
            da, db = _km(places[a], x), _km(places[b], x)
            s = (da + db + length) / 2
            if c not in (a, b) and da + db <= length + 800 and 2 * math.sqrt(max(s * (s - da) * (s - db) * (s - length), 0)) / length <= 400:
                want.add((f"{ids[a]}>{ids[b]}", ids[c]))
    assert got == want and want


# ---- trips, score, scenario ------------------------------------------------
ROUTES = [("R1", "A → B", "W1", "H1", "A", "B", "primary", 0.75, 150.0, 1.1, ["A", "B"]), ("R2", "C → B", "W2", "H1", "C", "B", "secondary", 0.25, 400.0, 1.0, ["C", "D", "B"])]


@pytest.fixture(scope="module")
def routes(spark):
    df = spark.createDataFrame(ROUTES, "route_id string, code string, warehouse_id string, hub_id string, origin_city_id string, city_id string, role string, "
                                       "share double, distance_km double, sensitivity double, path array<string>")
    return df.withColumn("normal_eta_h", service.normal_eta_h(F.col("distance_km"))).cache()


def hourly(spark, cities, mm, hours=72):
    return spark.createDataFrame([(c, NOW + timedelta(hours=h), mm) for c in cities for h in range(hours)], "city_id string, hour timestamp, mm double")


def cohorts(spark, route="R1", tier="standard", n=100):
    return spark.createDataFrame([(route, "B", tier, NOW, n)], "route_id string, city_id string, tier string, dispatch timestamp, orders long")


def history(spark):
    schema = "route_id string, " + ", ".join(f"{c}_delay_ratio double, {c}_on_time double" for c in S.RAIN_CLASSES)
    return spark.createDataFrame([], schema)


def score_of(spark, routes, tier, cities, mm):
    inputs = scoring.cohort_inputs(cohorts(spark, tier=tier), routes, hourly(spark, cities, mm), history(spark), NOW)
    return scoring.risk_score(inputs, COEFS).first()


def test_wet_express_order_is_explained(spark, routes):
    r = score_of(spark, routes, "express", "AB", 15.0)
    points = [c.points for c in r.contributions]
    assert sum(points) == pytest.approx(r.score, abs=0.6) and points == sorted(points, reverse=True)
    assert {c.key for c in r.contributions} == set(S.RISK_CAPS) and all(0 <= c.points <= c.cap and c.detail for c in r.contributions)
    assert r.category in ("High", "Critical") and r.expected_delay_min > 15 and r.exposed_share == 1 and r.expected_class == "heavy"


def test_dry_economy_order_is_low_risk(spark, routes):
    r = score_of(spark, routes, "economy", "", 0.0)
    assert r.category == "Low" and r.p_breach < 0.1 and r.exposed_share == 0 and r.expected_class == "none"


def test_categories(spark):
    assert one(spark, *[score.risk_category(F.lit(s)) for s in (0.0, 24.9, 25.0, 50.0, 75.0)]) == ("Low", "Low", "Medium", "High", "Critical")


def test_trip_passes_its_cities_in_order(spark, routes):
    rows = trips.trip_hours(cohorts(spark, "R2").select("route_id", "dispatch"), routes).orderBy("step").collect()
    assert len(rows) == 10 and rows[0].city_id == "C" and rows[-1].city_id == "B" and [r.city_id for r in rows].index("D") > 0


def evaluate(spark, routes, rain_hours, levers=None, route="R1"):
    return scenario.scenario_eval(cohorts(spark, route), routes, rain_hours, COEFS, NOW, levers).first()


def test_more_rain_costs_more(spark, routes):
    rain_hours = hourly(spark, "AB", 5.0)
    base, worse = (evaluate(spark, routes, rain_hours, lv) for lv in (None, {"rain_scale": 2.0}))
    assert worse.avg_delay_min > base.avg_delay_min and worse.cost_inr > base.cost_inr


def test_shift_leaves_the_storm(spark, routes):
    storm = hourly(spark, "AB", 15.0, hours=8)
    base, later = (evaluate(spark, routes, storm, lv) for lv in (None, {"dispatch_shift_h": 8}))
    assert later.exposed < base.exposed and later.avg_delay_min < base.avg_delay_min


def test_reroute_takes_the_drier_route(spark, routes):
    wet = hourly(spark, "A", 15.0)
    base, moved = (evaluate(spark, routes, wet, lv) for lv in (None, {"reroute": True}))
    assert moved.exposed < base.exposed and moved.rerouted == 100 and moved.cost_ops == round(100 * 250 * 0.15)


def test_local_hub_cuts_long_haul_delay(spark, routes):
    wet = hourly(spark, "ABCD", 15.0)
    base, hub = (evaluate(spark, routes, wet, lv, "R2") for lv in (None, {"add_hub": "B"}))
    assert hub.avg_delay_min < base.avg_delay_min and hub.local == 100 and hub.cost_ops == 300_000


def test_levers_are_clamped():
    assert scenario.clamp_levers({"dispatch_shift_h": 99, "rain_scale": 9, "add_hub": "X"}, {"A"}) == {
        "dispatch_shift_h": 8.0, "reroute": False, "add_hub": None, "rain_scale": 2.0}


# ---- model -----------------------------------------------------------------
def test_logistic_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8000, 2)).round(2)
    y = rng.random(8000) < 1 / (1 + np.exp(-(-1 + 2 * x[:, 0] - 0.5 * x[:, 1])))
    rows = spark.createDataFrame([(1.0, float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, c double, y int")
    assert np.allclose(model.fit_logistic(rows, ("a", "b", "c")), (-1, 2, -0.5), atol=0.15)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 20, 500), rng.integers(0, 2, 500)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    assert model.auc(rows).first().auc == pytest.approx(want, abs=1e-6)
