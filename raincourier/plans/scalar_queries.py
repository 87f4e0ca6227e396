"""Scalar expressions applied to whole tables."""
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import geo, rain, score, service
from raincourier.functions.numeric import pick, rounded
from raincourier.plans.catalog import query
from raincourier.sources.tables import _tier


@query()
def daily_class(lake):
    return lake.daily_rain().groupBy(rain.daily_class(F.col("rain_mm")).alias("class")).agg(
        F.count("*").alias("rows"), F.min("rain_mm").alias("lowest"), F.max("rain_mm").alias("highest"))


@query()
def hourly_class(lake):
    mm = F.col("value") / 10
    return lake.table("events").groupBy(rain.hourly_class(mm).alias("class")).agg(
        F.count("*").alias("rows"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query()
def season_of(lake):
    return lake.table("orders").groupBy(rain.season_of(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("orders"))


@query()
def severity_rank(lake):
    c = rain.daily_class(F.col("rain_mm"))
    return lake.daily_rain().groupBy("city_id").agg(F.sum(rain.severity_rank(c)).alias("rank_sum"), F.max(rain.severity_rank(c)).alias("worst_rank"))


@query()
def worst_class(lake):
    return lake.daily_rain().groupBy("city_id", F.trunc("date", "month").alias("month")).agg(
        rain.worst_class(rain.daily_class(F.col("rain_mm"))).alias("worst"))


@query()
def risk_category(lake):
    """Order value on a 0-100 scale as a stand-in score."""
    value = F.least(F.lit(100.0), F.col("o_totalprice") / 5000)
    return lake.table("orders").groupBy(score.risk_category(value).alias("category")).agg(F.count("*").alias("orders"))


def _customer_and_supplier(lake):
    place = lake.cities.select("city_id", "lat", "lon")
    lines = lake.table("lineitem").select("l_orderkey", F.concat(F.lit("W"), "l_suppkey").alias("warehouse_id"))
    lanes = (lines.join(lake.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
             .join(lake.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("C"), "c_nationkey").alias("city_id")), "o_custkey")
             .groupBy("warehouse_id", "city_id").agg(F.count("*").alias("lines")))
    sites = lake.warehouses.select("warehouse_id", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon"))
    return lanes.join(sites, "warehouse_id").join(place, "city_id")


@query()
def haversine_km(lake):
    km = geo.haversine_km(F.col("w_lat"), F.col("w_lon"), F.col("lat"), F.col("lon"))
    return _customer_and_supplier(lake).select("warehouse_id", "city_id", "lines", rounded(km, 3).alias("km"))


@query()
def intermediate_point(lake):
    lat, lon = geo.intermediate_point(F.col("w_lat"), F.col("w_lon"), F.col("lat"), F.col("lon"), F.lit(0.25))
    return _customer_and_supplier(lake).select("warehouse_id", "city_id", rounded(lat, 4).alias("lat"), rounded(lon, 4).alias("lon"))


@query()
def destination_point(lake):
    k = F.col("number")
    lat, lon = geo.destination_point(F.col("lat"), F.col("lon"), (k * 37 % 360).cast("double"), (4 + k % 60).cast("double"))
    return lake.warehouses.select("warehouse_id", rounded(lat, 4).alias("lat"), rounded(lon, 4).alias("lon"))


@query()
def normal_eta_h(lake):
    """Normal travel time if each line drove its order value in metres per rupee."""
    km = F.col("l_extendedprice") / 100
    return lake.table("lineitem").groupBy("l_suppkey").agg(rounded(F.sum(service.normal_eta_h(km)), 3).alias("hours"), rounded(F.max(service.normal_eta_h(km)), 4).alias("longest"))


@query()
def promised_h(lake):
    normal = service.normal_eta_h(F.col("o_totalprice") / 1000)
    tier = _tier(F.col("o_orderpriority"))
    return lake.table("orders").groupBy(tier.alias("tier")).agg(rounded(F.sum(service.promised_h(normal, tier)), 2).alias("promised"), rounded(F.sum(normal), 2).alias("normal"))


@query()
def expected_orders(lake):
    days = lake.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("placed"))
    first = service.expected_orders(F.col("day"))
    return days.select("day", "placed", rounded(first, 3).alias("expected"))


@query()
def hourly_share(lake):
    """Events per hour of day (IST) against the expected share."""
    ist = F.hour(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + int(S.IST_OFFSET_H * 3.6e9)))
    hours = lake.table("events").groupBy(ist.alias("ist_hour")).agg(F.count("*").alias("events"))
    return hours.withColumn("share", rounded(service.hourly_share(F.col("ist_hour")), 6))


@query()
def sla_cost(lake):
    tier = _tier(F.col("o_orderpriority"))
    return lake.table("orders").groupBy(tier.alias("tier")).agg(F.sum(pick(tier, S.COST_SLA)).cast("bigint").alias("cost"))
