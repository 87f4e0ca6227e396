"""Rain queries: history, climatology, forecast."""
from pyspark.sql import functions as F

from raincourier.functions import clock, rain, service
from raincourier.functions.numeric import rounded
from raincourier.operators import climate
from raincourier.plans.catalog import query


@query()
def weather_history(lake):
    return climate.weather_history(lake.daily_rain()).groupBy("city_id", "date", "severity").agg(
        F.count("*").alias("readings"), F.max("rain_mm").alias("rain_mm"))


@query()
def climatology(lake):
    return climate.climatology(lake.daily_rain())


@query()
def join_climatology_month(lake):
    return climate.join_climatology_month(lake.cities, climate.climatology(lake.daily_rain()), 7)


@query()
def rainfall_by_state(lake):
    return climate.rainfall_by_state(lake.cities, climate.climatology(lake.daily_rain()), 7)


@query()
def climatology_by_city(lake):
    return climate.climatology_by_city(climate.climatology(lake.daily_rain()), "C3")


@query()
def join_route_day_rain(lake):
    return climate.join_route_day_rain(lake.routes, lake.daily_rain())


@query()
def forecast_probs(lake):
    """Forecast of every city-hour on record, seen from the start of the series."""
    hourly = lake.hourly_rain()
    hours = hourly.select("city_id", F.col("hour").alias("at"))
    out = climate.forecast(hours, hourly, "2024-01-01T00:00:00Z")
    return out.select("city_id", "at", "lead_h", *rain.PROBABILITIES, F.col("wet").alias("p_rain"), "mmph")


@query()
def scale_rain(lake):
    """The same forecast under half, unchanged and doubled rain."""
    hourly = lake.hourly_rain()
    out = climate.forecast(hourly.select("city_id", F.col("hour").alias("at")), hourly, "2024-01-01T00:00:00Z")
    scaled = out.withColumn("scale", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.4), F.lit(2.0))))
    probs = rain.scale_rain({c: F.col(c) for c in rain.PROBABILITIES}, F.col("scale"))
    return scaled.select("city_id", "at", "scale", *[rounded(p, 6).alias(c) for c, p in probs.items()])


@query()
def forecast_grid(lake):
    return climate.forecast_grid(lake.cities, lake.hourly_rain(lake.now), lake.now)


@query()
def src_hourly_rain(lake):
    """Hourly lookup with the dry default, for every hour of every recorded day."""
    hourly = lake.hourly_rain()
    days = hourly.select("city_id", F.date_trunc("day", "hour").alias("day")).distinct()
    hours = days.select("city_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), "day").select(
        "city_id", clock.plus_hours(F.col("day"), F.col("h").cast("double")).alias("hour"))
    return hours.join(hourly, ["city_id", "hour"], "left").select("city_id", "hour", rounded(F.coalesce("mm", F.lit(0.0)), 4).alias("mm"))


@query()
def src_daily_rain(lake):
    """Daily readings with their class; the parquet twin of the CSV reader."""
    return climate.weather_history(lake.daily_rain()).groupBy("city_id", F.year("date").alias("year"), "severity").agg(
        F.count("*").alias("days"), rounded(F.avg("rain_mm"), 2).alias("mean_mm"))


@query()
def expected_weight(lake):
    """Probability-weighted severity of every city-hour on record."""
    hourly = lake.hourly_rain()
    out = climate.forecast(hourly.select("city_id", F.col("hour").alias("at")), hourly, "2024-01-01T00:00:00Z")
    return out.select("city_id", "at", rounded(service.expected_weight({c: F.col(c) for c in rain.PROBABILITIES}), 6).alias("weight"))
