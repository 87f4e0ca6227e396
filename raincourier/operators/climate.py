"""Rain operators: daily history, climatology, forecast."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import clock, rain
from raincourier.functions.numeric import rounded


def weather_history(daily: DataFrame) -> DataFrame:
    return daily.select("city_id", "date", "rain_mm", rain.daily_class(F.col("rain_mm")).alias("severity"))


def climatology(daily: DataFrame) -> DataFrame:
    """City × month statistics of daily rain; days without a reading are skipped.

    Exact percentiles without holding a group in one buffer: readings are
    counted per distinct value first, and `percentile` with frequencies then
    works on the counts.
    """
    mm = F.col("rain_mm")
    counts = (daily.filter(mm.isNotNull()).groupBy("city_id", F.month("date").alias("month"), "rain_mm")
              .agg(F.count("*").alias("n")))
    n = F.col("n")
    stats = counts.groupBy("city_id", "month").agg(
        F.sum("n").alias("days"), (F.sum(mm * n) / F.sum("n")).alias("mean"),
        F.expr("percentile(rain_mm, array(0.5, 0.75, 0.9), n)").alias("q"),
        (F.sum(F.when(mm >= S.DAILY_EDGES_MM[0], n).otherwise(0)) / F.sum("n")).alias("rainy"),
        (F.sum(F.when(mm >= S.DAILY_EDGES_MM[1], n).otherwise(0)) / F.sum("n")).alias("heavy"))
    return stats.select(
        "city_id", "month", rain.season_of(F.col("month")).alias("season"), "days", rounded(F.col("mean"), 2).alias("mean_mm"),
        rounded(F.col("q")[0], 2).alias("median_mm"), rounded(F.col("q")[1], 2).alias("p75_mm"),
        rounded(F.col("q")[2], 2).alias("p90_mm"), rounded(F.col("rainy"), 4).alias("p_rainy"),
        rounded(F.col("heavy"), 4).alias("p_heavy"), rounded(F.col("mean") * S.DAYS_PER_MONTH, 1).alias("monthly_total_mm"))


def join_climatology_month(cities: DataFrame, climate: DataFrame, month: int) -> DataFrame:
    columns = ["mean_mm", "median_mm", "p75_mm", "p90_mm", "p_rainy", "p_heavy", "monthly_total_mm", "season"]
    return (cities.join(climate.filter(F.col("month") == month), "city_id")
            .select("city_id", "name", "state", "lat", "lon", *columns))


def rainfall_by_state(cities: DataFrame, climate: DataFrame, month: int) -> DataFrame:
    return (join_climatology_month(cities, climate, month).groupBy("state").agg(
        rounded(F.avg("monthly_total_mm"), 1).alias("monthly_total_mm"), rounded(F.avg("p_rainy"), 4).alias("p_rainy"),
        rounded(F.avg("p_heavy"), 4).alias("p_heavy"), F.count("*").alias("cities")))


def climatology_by_city(climate: DataFrame, city_id: str) -> DataFrame:
    return (climate.filter(F.col("city_id") == city_id)
            .select("month", "mean_mm", "p_rainy", "p_heavy", "monthly_total_mm", "season").orderBy("month"))


def join_route_day_rain(routes: DataFrame, daily: DataFrame) -> DataFrame:
    """Wettest reading along a route's path, per route and day. Readings are
    reduced per city and day before they are fanned out to routes."""
    reading = (daily.groupBy("city_id", "date").agg(F.max(F.coalesce("rain_mm", F.lit(0.0))).alias("rain_mm")))
    stops = routes.select("route_id", F.explode(F.array_distinct("path")).alias("city_id"))
    wettest = stops.join(reading, "city_id").groupBy("route_id", "date").agg(F.max("rain_mm").alias("rain_mm"))
    return wettest.withColumn("severity", rain.daily_class(F.col("rain_mm")))


def forecast(hours: DataFrame, hourly: DataFrame, now, lead_from: str = "hour") -> DataFrame:
    """Forecast for rows carrying (city_id, at): class probabilities, p_rain and
    mm/h of that city-hour. A missing reading is dry. The lead runs from `now`
    to the full hour, or to the moment itself with lead_from="moment"."""
    now = clock.moment(now)
    wanted = hours.withColumn("hour", clock.hour_of(F.col("at")))
    seen = wanted.join(hourly.select("city_id", "hour", "mm"), ["city_id", "hour"], "left")
    mm = F.coalesce("mm", F.lit(0.0))
    target = F.col("hour") if lead_from == "hour" else F.col("at")
    lead = F.greatest(F.lit(0.0), clock.hours_between(now, target))
    seen = seen.withColumn("mm", mm).withColumn("lead_h", lead)
    seen = seen.withColumn("class_now", rain.hourly_class(F.col("mm")))
    seen = seen.withColumns(rain.forecast_probs(F.col("class_now"), F.col("lead_h")))
    return (seen.withColumn("wet", rain.wet_probability(F.col("prob_none"))).withColumn("mmph", rounded(F.col("mm"), 1))
            .drop("mm", "hour", "class_now"))


def forecast_grid(cities: DataFrame, hourly: DataFrame, now, hours: int = S.FORECAST_HOURS) -> DataFrame:
    """City × next hours: rain probability, mm/h and most likely class."""
    start = clock.hour_of(clock.moment(now))
    grid = (cities.select("city_id", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("step"))
            .withColumn("at", clock.plus_hours(start, F.col("step").cast("double"))))
    out = forecast(grid, hourly, now)
    probs = {c: F.col(c) for c in rain.PROBABILITIES}
    return out.select("city_id", "step", F.col("at").alias("hour"), F.col("wet").alias("p_rain"), "mmph",
                      rain.likeliest(probs).alias("class"))
