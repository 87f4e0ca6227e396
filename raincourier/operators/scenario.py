"""What-if evaluation of upcoming cohorts under a set of levers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import clock, rain, score, service
from raincourier.functions.numeric import rounded, whole
from raincourier.operators import trips
from raincourier.operators.climate import forecast


def clamp_levers(levers: dict | None, cities=None) -> dict:
    """Levers within their allowed ranges; unknown hub cities are dropped."""
    levers = levers or {}

    def within(value, low, high):
        return min(high, max(low, value))

    hub = levers.get("add_hub")
    return {"dispatch_shift_h": float(within(levers.get("dispatch_shift_h") or 0, *S.SHIFT_RANGE_H)),
            "reroute": bool(levers.get("reroute")),
            "add_hub": hub if cities is None or hub in cities else None,
            "rain_scale": float(within(levers.get("rain_scale") or 1, *S.RAIN_SCALE_RANGE))}


def clamp_window(window_h) -> int:
    return int(min(S.WINDOW_RANGE_H[1], max(S.WINDOW_RANGE_H[0], window_h)))


def join_alternative_route(routes: DataFrame) -> DataFrame:
    """The other route into the same city: the primary one for a secondary
    route and the other way round."""
    other = routes.select("city_id", F.col("route_id").alias("alternative_id"), F.col("role").alias("alternative_role"),
                          F.col("distance_km").alias("alternative_km"))
    return (routes.select("route_id", "city_id", "role", "distance_km").join(other, "city_id")
            .filter("route_id <> alternative_id"))


def _local_routes(routes: DataFrame) -> DataFrame:
    """Every city's temporary micro-fulfilment route, derived from its primary."""
    cut = F.greatest(F.lit(S.SENSITIVITY_RANGE[0]), F.col("sensitivity") - S.LOCAL_HUB_SENSITIVITY_CUT)
    return routes.filter("role = 'primary'").select(
        F.concat(F.lit("LOCAL-"), "city_id").alias("route_id"), "city_id", F.lit("local").alias("role"),
        F.lit(S.LOCAL_KM).alias("distance_km"), rounded(cut, 2).alias("sensitivity"), F.array("city_id").alias("path"))


def _route_columns(routes: DataFrame) -> DataFrame:
    return routes.select("route_id", "city_id", "role", "distance_km", "sensitivity", "path")


def scenario_cohorts(cohorts: DataFrame, routes: DataFrame, hourly: DataFrame, coefs, now, levers: dict | None = None) -> DataFrame:
    """Each cohort under the levers: chosen route, exposure, delay, breach
    probability. Both routes of a city are evaluated in one pass over the
    distinct (route, dispatch) pairs; the drier one wins where rerouting is on."""
    levers = clamp_levers(levers)
    now_ts = clock.moment(now)
    hub = levers["add_hub"]
    every = _route_columns(routes)
    if hub:
        every = every.unionByName(_local_routes(routes.filter(F.col("city_id") == hub)))
    every = every.withColumn("normal_eta_h", service.normal_eta_h(F.col("distance_km")))
    shifted = clock.plus_hours(F.col("dispatch"), levers["dispatch_shift_h"])
    local = F.col("city_id") == hub if hub else F.lit(False)
    plan = (cohorts.withColumn("dispatch", F.greatest(now_ts, shifted)).withColumn("local", local)
            .withColumn("route_id", F.when(local, F.concat(F.lit("LOCAL-"), "city_id")).otherwise(F.col("route_id"))))
    candidates = plan.select("route_id", "dispatch")
    if levers["reroute"]:
        other = join_alternative_route(routes).select("route_id", "alternative_id")
        plan = plan.join(other, "route_id", "left")
        candidates = candidates.unionByName(
            plan.filter(F.col("alternative_id").isNotNull()).select(F.col("alternative_id").alias("route_id"), "dispatch"))
    hours = forecast(trips.trip_hours(candidates.distinct(), every), hourly, now, lead_from="moment")
    scale = levers["rain_scale"]
    if scale != 1:
        scaled = rain.scale_rain({c: F.col(c) for c in rain.PROBABILITIES}, scale)
        hours = hours.withColumns(scaled).withColumn("wet", 1 - F.col("prob_none"))
    exposure = trips.exposure_of(hours).join(every.drop("path", "city_id"), "route_id")
    first = F.struct(*[c for c in exposure.columns if c != "dispatch"])
    found = exposure.select("route_id", "dispatch", first.alias("base"))
    plan = plan.join(found, ["route_id", "dispatch"])
    if levers["reroute"]:
        spare = found.select(F.col("route_id").alias("alternative_id"), "dispatch", F.col("base").alias("spare"))
        plan = plan.join(spare, ["alternative_id", "dispatch"], "left")
        move = (F.col("base.exposed_share") > 0) & F.coalesce(F.col("spare.weight") < F.col("base.weight"), F.lit(False))
        plan = plan.withColumn("rerouted", move).withColumn(
            "extra_km", F.when(move, F.greatest(F.lit(0.0), F.col("spare.distance_km") - F.col("base.distance_km"))).otherwise(0.0))
        plan = plan.withColumn("trip", F.when(move, F.col("spare")).otherwise(F.col("base")))
    else:
        plan = plan.withColumn("rerouted", F.lit(False)).withColumn("extra_km", F.lit(0.0)).withColumn("trip", F.col("base"))
    flat = plan.select("city_id", "tier", "dispatch", "orders", "local", "rerouted", "extra_km", "trip.*")
    probs = {c: F.col(c) for c in rain.PROBABILITIES}
    normal, sensitivity = F.col("normal_eta_h"), F.col("sensitivity")
    features = score.breach_features(normal, service.promised_h(normal, F.col("tier")), sensitivity, F.col("weight"), F.col("distance_km"))
    return flat.withColumns({"delay_h": service.expected_delay_h(normal, sensitivity, probs),
                             "p_breach": score.breach_probability(coefs, features),
                             "p_failed": rain.expected(probs, S.FAILED_RATE)})


def scenario_totals(evaluated: DataFrame, levers: dict | None = None, window_h: int = 48) -> DataFrame:
    """Totals and costs of an evaluated scenario (one row)."""
    n, delay_h = F.col("orders"), F.col("delay_h")

    def added(value):
        return F.coalesce(F.sum(value), F.lit(0))

    hub_cost = S.HUB_COST_PER_DAY * window_h / 24 if clamp_levers(levers)["add_hub"] else 0.0
    sums = evaluated.agg(
        added(n).cast("bigint").alias("orders"), added(F.when(F.col("exposed_share") > 0, n)).cast("bigint").alias("exposed"),
        added(F.when(delay_h * 60 >= S.SCENARIO_LATE_MIN, n)).cast("bigint").alias("late"), added(n * F.col("p_breach")).alias("breaches"),
        added(n * delay_h * 60).alias("delay_min"), added(n * delay_h * S.COST_PER_DELAY_HOUR).alias("delay_cost"),
        added(n * F.col("p_breach") * service.sla_cost(F.col("tier"))).alias("sla_cost"),
        added(n * F.col("p_failed") * S.COST_RESHIP).alias("reship_cost"),
        (added(F.when(F.col("rerouted"), n * F.col("extra_km") * S.COST_PER_ORDER_KM)) + hub_cost).alias("ops_cost"),
        added(F.when(F.col("rerouted"), n)).cast("bigint").alias("rerouted"), added(F.when(F.col("local"), n)).cast("bigint").alias("local"))
    cost = F.col("delay_cost") + F.col("sla_cost") + F.col("reship_cost") + F.col("ops_cost")
    return sums.select(
        "orders", "exposed", "late", whole(F.col("breaches")).alias("sla_breaches"),
        rounded(F.col("delay_min") / F.greatest(F.lit(1), "orders"), 1).alias("avg_delay_min"), whole(cost).alias("cost_inr"),
        whole(F.col("delay_cost")).alias("cost_delay"), whole(F.col("sla_cost")).alias("cost_sla"),
        whole(F.col("reship_cost")).alias("cost_reship"), whole(F.col("ops_cost")).alias("cost_ops"), "rerouted", "local")


def scenario_eval(cohorts: DataFrame, routes: DataFrame, hourly: DataFrame, coefs, now, levers: dict | None = None,
                  window_h: int = 48) -> DataFrame:
    return scenario_totals(scenario_cohorts(cohorts, routes, hourly, coefs, now, levers), levers, window_h)


def scenario_delta(current: DataFrame, simulated: DataFrame) -> DataFrame:
    """Simulated minus current for the five headline metrics."""
    metrics = ("late", "sla_breaches", "exposed", "cost_inr", "avg_delay_min")
    both = current.select(*[F.col(m).alias(f"c_{m}") for m in metrics], F.lit(1).alias("k")).join(
        simulated.select(*[F.col(m).alias(f"s_{m}") for m in metrics], F.lit(1).alias("k")), "k")
    delta = {m: F.col(f"s_{m}") - F.col(f"c_{m}") for m in metrics}
    delta["avg_delay_min"] = rounded(delta["avg_delay_min"], 1)
    return both.select(*[delta[m].alias(m) for m in metrics])
