"""Risk, outlook, impact and order-book queries at the reference moment."""
from pyspark.sql import functions as F

from raincourier.functions.numeric import rounded
from raincourier.operators import history, impact, ingest, scenario, scoring, trips
from raincourier.plans import ingest_queries
from raincourier.plans.catalog import query
from raincourier.settings import TYPES_WITH_ORDER
from raincourier.sources import eventlog
from raincourier.sources.scratch import written
from raincourier.sources.tables import COEFS

FUTURE_FILTERS = {"tier": "standard", "q": "nation_1"}
LEVERS = {"dispatch_shift_h": 2, "reroute": True, "add_hub": "C2", "rain_scale": 1.5}


def hourly(lake):
    return lake.hourly_rain(lake.now)


def cohorts_of(lake):
    return trips.cohorts(lake.upcoming, lake.now)


def risk_of(lake):
    """The predictions table: written once per recompute, read by every view."""
    return written(_risk(lake), "predictions")


def _risk(lake):
    return scoring.cohort_risk(lake.upcoming, lake.routes, hourly(lake), lake.route_history, COEFS, lake.now)


def route_impact_of(lake, risk=None):
    """The route impact table, read by the level roll-ups."""
    return written(_route_impact(lake, risk or risk_of(lake)), "route-impact")


def _route_impact(lake, risk):
    return impact.route_impact_live(risk, eventlog.open_trips(lake), lake.routes, eventlog.city_weather(lake), lake.now)


def rollup_of(lake, route_impact=None):
    return impact.impact_rollup(route_impact or route_impact_of(lake), lake.cities, lake.warehouses, lake.hubs)


def kpis_of(lake, risk=None):
    return impact.live_kpis(lake.order_book, eventlog.open_trips(lake), lake.warehouses, eventlog.city_weather(lake),
                            risk or risk_of(lake), lake.now)


def structural_of(lake):
    return history.structural_impact(history.join_history_star(lake.route_days, lake.routes, lake.cities))


# ---- trips and risk --------------------------------------------------------
@query()
def filter_upcoming(lake):
    return trips.filter_upcoming(lake.upcoming, lake.now, 24).select("order_id", "route_id", "tier", "status", "planned_dispatch")


@query()
def cohorts(lake):
    return cohorts_of(lake)


@query()
def trip_hours(lake):
    return trips.trip_hours(cohorts_of(lake).select("route_id", "dispatch").distinct(), lake.routes)


@query()
def join_trip_weather(lake):
    return trips.join_trip_weather(cohorts_of(lake), lake.routes, hourly(lake)).withColumn("mm", rounded(F.col("mm"), 4))


@query()
def trip_exposure(lake):
    out = trips.trip_exposure(cohorts_of(lake), lake.routes, hourly(lake), lake.now)
    return out.withColumn("delivery_p_rain", rounded(F.col("delivery_p_rain"), 4))


@query()
def actual_trip_class(lake):
    return trips.actual_trip_class(cohorts_of(lake), lake.routes, hourly(lake))


@query()
def weather_eta(lake):
    """Every lineitem's order on its route: rows per route and class with the ETA."""
    seen = lake.history("route").groupBy("route_id", F.col("severity").alias("class")).agg(F.count("*").alias("rows"))
    return trips.weather_eta(lake.routes).join(seen, ["route_id", "class"])


@query()
def expected_delay(lake):
    from raincourier.functions import rain, service
    exposure = trips.trip_exposure(cohorts_of(lake), lake.routes, hourly(lake), lake.now).join(
        lake.routes.select("route_id", "normal_eta_h", "sensitivity"), "route_id")
    probs = {c: F.col(c) for c in rain.PROBABILITIES}
    delay = service.expected_delay_h(F.col("normal_eta_h"), F.col("sensitivity"), probs)
    return exposure.select("route_id", "dispatch", rounded(service.expected_weight(probs), 6).alias("expected_weight"),
                           rounded(delay * 60, 4).alias("expected_delay_min"))


@query()
def warehouse_load(lake):
    inputs = _exposed(lake)
    return trips.warehouse_load(inputs).withColumn("exposed_share", rounded(F.col("exposed_share"), 6))


def _exposed(lake):
    grouped = cohorts_of(lake)
    exposure = trips.trip_exposure(grouped, lake.routes, hourly(lake), lake.now)
    return grouped.join(lake.routes.select("route_id", "warehouse_id"), "route_id").join(exposure, ["route_id", "dispatch"])


@query()
def join_route_history(lake):
    return scoring.join_route_history(lake.routes, history.load_route_history(
        history.route_weather_impact(lake.history("route"), lake.routes)))


@query()
def src_model(lake):
    wide = history.load_route_history(history.route_weather_impact(lake.history("route"), lake.routes))
    coefs = lake.model().select("coefs").scalar()
    return wide.withColumns({f"coef_{i}": F.element_at(coefs, i + 1) for i in range(len(COEFS))})


@query()
def breach_probability(lake):
    from raincourier.functions import score, service
    rows = _exposed(lake).join(lake.routes.select("route_id", "normal_eta_h", "distance_km", "sensitivity"), "route_id")
    normal = F.col("normal_eta_h")
    x = score.breach_features(normal, service.promised_h(normal, F.col("tier")), F.col("sensitivity"), F.col("weight"), F.col("distance_km"))
    return rows.select("route_id", "tier", "dispatch", rounded(score.breach_probability(COEFS, x), 4).alias("p_breach"))


@query()
def risk_score(lake):
    return scoring.sort_contributions(_risk(lake))


@query()
def sort_contributions(lake):
    return scoring.sort_contributions(risk_of(lake)).select("route_id", "tier", "dispatch", "place", "key", "points")


@query()
def cohort_risk(lake):
    return _risk(lake).drop("contributions")


@query()
def replace_predictions(lake):
    """The predictions table as it replaces the previous one."""
    return risk_of(lake).select("route_id", "tier", F.col("dispatch").alias("dispatch_hour"), "orders", "score", "category", "expected_class",
                                "p_rain", "expected_delay_min", "p_breach", F.size("contributions").alias("contributions"))


@query()
def order_risk(lake):
    return scoring.order_risk(lake.order_book, risk_of(lake)).select("order_id", "score", "category", "p_breach")


# ---- outlook ---------------------------------------------------------------
@query()
def future_summary(lake):
    return impact.future_summary(risk_of(lake), lake.now)


@query()
def risk_timeline(lake):
    return impact.risk_timeline(risk_of(lake), lake.cities, hourly(lake), lake.now)


@query()
def timeline_2h(lake):
    return impact.timeline_2h(impact.risk_timeline(risk_of(lake), lake.cities, hourly(lake), lake.now))


@query()
def latest_city_weather(lake):
    return eventlog.city_weather(lake)


@query()
def merge_current_weather(lake):
    """The current-weather table after a tick: one row per city with its impact."""
    return eventlog.city_weather(lake).join(
        rollup_of(lake).filter("level = 'city'").select(F.col("id").alias("city_id"), F.col("score").alias("impact_score")), "city_id")


@query()
def wet_cities(lake):
    return impact.wet_cities(eventlog.city_weather(lake))


@query()
def join_live_exposure(lake):
    out = impact.join_live_exposure(lake.order_book, eventlog.open_trips(lake), lake.warehouses, eventlog.city_weather(lake))
    return out.select("order_id", "trip_id", "near", "trip_delay_min", "exposed")


@query()
def live_kpis(lake):
    return kpis_of(lake)


@query()
def route_impact_live(lake):
    return _route_impact(lake, risk_of(lake))


@query()
def impact_rollup(lake):
    return rollup_of(lake)


@query()
def union_levels(lake):
    routes = route_impact_of(lake)
    return impact.union_levels(routes, rollup_of(lake, routes))


@query()
def join_live_structural(lake):
    return impact.join_live_structural(rollup_of(lake), structural_of(lake), lake.cities)


@query()
def blended_impact_index(lake):
    return impact.blended_impact_index(impact.join_live_structural(rollup_of(lake), structural_of(lake), lake.cities))


@query()
def join_drilldown(lake):
    routes = route_impact_of(lake)
    rollup = rollup_of(lake, routes)
    parts = [impact.join_drilldown(lake.routes, lake.cities, routes, rollup, kind, id_).withColumn("parent", F.lit(id_))
             for kind, id_ in (("state", "ASIA"), ("city", "C2"), ("warehouse", "W0"), ("hub", "H3"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query()
def semi_known_ids(lake):
    """Events whose city is on the map."""
    known = impact.semi_known_ids(ingest_queries.checked(lake), lake.cities, "city_id")
    return ingest.clean_dedup(known).groupBy("city_id").agg(F.count("*").alias("events"))


@query()
def top_by_level(lake):
    routes = route_impact_of(lake)
    return impact.top_by_level(impact.union_levels(routes, rollup_of(lake, routes)).filter("level <> 'hub'"))


@query()
def critical_orders(lake):
    return impact.critical_orders(lake.upcoming, risk_of(lake), 12)


@query()
def alerts(lake):
    risk = risk_of(lake)
    routes = route_impact_of(lake, risk)
    return impact.alerts(impact.future_summary(risk, lake.now), kpis_of(lake, risk), routes, rollup_of(lake, routes), lake.warehouses)


# ---- order book ------------------------------------------------------------
def _future(lake):
    return impact.join_future_orders(lake.order_book, risk_of(lake), lake.routes, lake.cities)


@query()
def join_future_orders(lake):
    return _future(lake).select(*impact.FUTURE_COLUMNS)


@query()
def filter_future(lake):
    return impact.filter_future(_future(lake), lake.now, 24, FUTURE_FILTERS).select("order_id", "route", "tier", "planned_dispatch", "score")


@query()
def page_future(lake):
    return impact.page_future(impact.filter_future(_future(lake), lake.now, 48, {"state": "ASIA"}), "breach", 2, 25)


@query()
def next_page(lake):
    """The second page found from the last row of the first one, without an offset."""
    kept = impact.filter_future(_future(lake), lake.now, 48, {"state": "ASIA"})
    first = impact.page_future(kept, "breach", 1, 25).collect()  # one page
    return impact.next_page(kept, (first[-1].p_breach, first[-1].order_id), "breach", 25) if len(first) == 25 else kept.select(*impact.FUTURE_COLUMNS).limit(0)


@query()
def join_route_orders_left(lake):
    return impact.join_route_orders_left(lake.order_book, risk_of(lake), limit=100)


@query()
def join_items_products(lake):
    return impact.join_items_products(lake.order_items(), lake.products()).groupBy("name").agg(
        F.count("*").alias("lines"), F.sum("qty").cast("bigint").alias("qty"), rounded(F.sum("price_inr"), 2).alias("value"))


@query()
def join_order_detail(lake):
    """The detail row of every order, nested parts reduced to their sizes."""
    detail = impact.join_order_detail(
        lake.order_book, lake.routes, lake.cities, lake.warehouses, lake.hubs, lake.categories, lake.order_items(), lake.products(),
        risk_of(lake), lake.log(*TYPES_WITH_ORDER), history.route_weather_impact(lake.history("route"), lake.routes))
    return detail.select("order_id", "route", "city", "state", "warehouse", "hub", "category", "status",
                         F.coalesce(F.size("items"), F.lit(0)).alias("items"), F.coalesce(F.size("events"), F.lit(0)).alias("events"),
                         F.element_at("events", -1)["type"].alias("last_event"), F.col("prediction.score").alias("score"),
                         F.size("route_history").alias("history_rows"))


@query()
def sort_order_events(lake):
    ordered = impact.sort_order_events(lake.log(*TYPES_WITH_ORDER))
    return ordered.select("order_id", F.array_join(F.transform("events", lambda e: e["type"]), ">").alias("types"))


@query()
def search_entities(lake):
    return impact.search_entities(lake.order_book, lake.routes, lake.cities, lake.warehouses, lake.hubs, "12")


@query()
def limit_search(lake):
    book = lake.order_book.select(F.lit("order").alias("kind"), F.col("order_id").alias("id"), F.col("status").alias("label"))
    places = lake.warehouses.select(F.lit("warehouse").alias("kind"), F.col("warehouse_id").alias("id"), F.col("name").alias("label"))
    return impact.limit_search(book.unionByName(places))


# ---- scenarios -------------------------------------------------------------
@query()
def scenario_levers(lake):
    out = scenario.scenario_cohorts(cohorts_of(lake), lake.routes, hourly(lake), COEFS, lake.now, LEVERS)
    return out.select("route_id", "city_id", "tier", "dispatch", "orders", "local", "rerouted", rounded(F.col("extra_km"), 3).alias("extra_km"),
                      rounded(F.col("delay_h"), 6).alias("delay_h"), rounded(F.col("p_breach"), 6).alias("p_breach"))


@query()
def scenario_totals(lake):
    return scenario.scenario_eval(cohorts_of(lake), lake.routes, hourly(lake), COEFS, lake.now, {"reroute": True})


def _both(lake):
    grouped = cohorts_of(lake)
    return [scenario.scenario_eval(grouped, lake.routes, hourly(lake), COEFS, lake.now, levers) for levers in (None, LEVERS)]


@query()
def scenario_eval(lake):
    current, simulated = _both(lake)
    return current.withColumn("variant", F.lit("current")).unionByName(simulated.withColumn("variant", F.lit("simulated")))


@query()
def scenario_delta(lake):
    return scenario.scenario_delta(*_both(lake))
