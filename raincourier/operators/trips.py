"""Trips through the weather: hours on the road, exposure, order cohorts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import clock, rain, service
from raincourier.functions.numeric import rounded
from raincourier.operators.climate import forecast

TRIP = ("route_id", "dispatch")


def within_horizon(cohorts: DataFrame, now, hours: float = 48) -> DataFrame:
    """Cohorts that leave within the horizon (ends included)."""
    now = clock.moment(now)
    return cohorts.filter(F.col("dispatch").between(now, clock.plus_hours(now, hours)))


def filter_upcoming(orders: DataFrame, now, hours: float) -> DataFrame:
    """Not yet dispatched orders leaving within the horizon (ends included)."""
    now = clock.moment(now)
    return orders.filter(F.col("status").isin(*S.UPCOMING) & F.col("planned_dispatch").between(now, clock.plus_hours(now, hours)))


def cohorts(orders: DataFrame, now, hours: float = 48) -> DataFrame:
    """Upcoming orders per (route, tier, dispatch): everything downstream works
    on cohorts, whose number is bounded by the network and the horizon."""
    return (filter_upcoming(orders, now, hours)
            .groupBy("route_id", "city_id", "tier", F.col("planned_dispatch").alias("dispatch"))
            .agg(F.count("*").alias("orders")))


def trip_hours(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per started hour of a trip (route_id, dispatch) with the city
    being passed then. Route columns path and normal_eta_h come from `routes`."""
    n = F.greatest(F.lit(1), F.floor(F.col("normal_eta_h") + 0.999).cast("int"))
    timed = (trips.join(routes.select("route_id", "path", "normal_eta_h"), "route_id").withColumn("hours", n)
             .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("hours") - 1))))
    last = F.size("path") - 1
    along = F.col("step") / F.greatest(F.lit(1), F.col("hours") - 1) * last
    # Python rounds halves to even when it picks the city.
    stop = F.least(last, F.bround(along, 0).cast("int"))
    return (timed.withColumn("city_id", F.element_at("path", stop + 1))
            .withColumn("at", clock.plus_hours(F.col("dispatch"), F.col("step").cast("double")))
            .drop("path", "normal_eta_h"))


def exposure_of(hours: DataFrame, keys=TRIP) -> DataFrame:
    """Reduce forecast trip hours to the exposure of each trip: the worst hour
    (earliest on ties), share of wet hours, rain probability at delivery."""
    probs = {c: F.col(c) for c in rain.PROBABILITIES}
    weight = service.expected_weight(probs)
    ranked = F.struct(weight.alias("weight"), (-F.col("step")).alias("earlier"), *rain.PROBABILITIES)
    grouped = hours.groupBy(*keys).agg(
        F.max(ranked).alias("worst"), F.max("wet").alias("p_rain"),
        F.avg(F.when(F.col("wet") >= S.EXPOSED_P_RAIN, 1.0).otherwise(0.0)).alias("share"),
        F.max(F.struct("step", "wet")).alias("last"), F.max("hours").alias("hours"))
    worst = {c: F.col(f"worst.{c}") for c in rain.PROBABILITIES}
    return grouped.select(
        *keys, *[worst[c].alias(c) for c in rain.PROBABILITIES], rounded(F.col("worst.weight"), 4).alias("weight"),
        rain.likeliest(worst).alias("expected_class"), rounded(F.col("p_rain"), 4).alias("p_rain_max"),
        rounded(F.col("share"), 4).alias("exposed_share"), F.col("last.wet").alias("delivery_p_rain"), "hours")


def trip_exposure(trips: DataFrame, routes: DataFrame, hourly: DataFrame, now, lead_from: str = "hour") -> DataFrame:
    """Forecast exposure per distinct (route_id, dispatch)."""
    distinct_trips = trips.select(*TRIP).distinct()
    return exposure_of(forecast(trip_hours(distinct_trips, routes), hourly, now, lead_from))


def join_trip_weather(trips: DataFrame, routes: DataFrame, hourly: DataFrame) -> DataFrame:
    """Observed rain at each hour of each trip; missing readings are dry."""
    hours = trip_hours(trips.select(*TRIP).distinct(), routes).withColumn("hour", clock.hour_of(F.col("at")))
    seen = hours.join(hourly.select("city_id", "hour", "mm"), ["city_id", "hour"], "left")
    mm = F.coalesce("mm", F.lit(0.0))
    return seen.select(*TRIP, "step", "hours", "city_id", "at", mm.alias("mm"), rain.hourly_class(mm).alias("class"))


def actual_trip_class(trips: DataFrame, routes: DataFrame, hourly: DataFrame) -> DataFrame:
    return join_trip_weather(trips, routes, hourly).groupBy(*TRIP).agg(rain.worst_class(F.col("class")).alias("class"))


def warehouse_load(cohort_exposure: DataFrame) -> DataFrame:
    """Share of each warehouse's upcoming orders that meet likely rain.
    Input: cohorts with warehouse_id and exposed_share."""
    wet = F.when(F.col("exposed_share") > 0, F.col("orders")).otherwise(0)
    return cohort_exposure.groupBy("warehouse_id").agg(
        F.sum("orders").alias("orders"), F.sum(wet).alias("exposed"),
        (F.sum(wet) / F.greatest(F.sum("orders"), F.lit(1))).alias("exposed_share"))


def weather_eta(routes: DataFrame) -> DataFrame:
    """Travel time of each route under each rain class."""
    classes = F.explode(F.array(*map(F.lit, S.RAIN_CLASSES)))
    normal, sensitivity, c = F.col("normal_eta_h"), F.col("sensitivity"), F.col("class")
    return routes.select("route_id", "normal_eta_h", "sensitivity", classes.alias("class")).select(
        "route_id", "class", rounded(service.weather_eta_h(normal, sensitivity, c), 2).alias("eta_h"),
        rounded(service.weather_delay_h(normal, sensitivity, c) * 60, 2).alias("delay_min"))
