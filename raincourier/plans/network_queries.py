"""Network queries: nearest sites, corridors, routes, polylines."""
from pyspark.sql import functions as F

from raincourier.functions.geo import polyline_length_km
from raincourier.functions.numeric import rounded
from raincourier.operators import network, scenario
from raincourier.plans.catalog import query


@query()
def join_two_nearest(lake):
    """The two warehouses nearest to every city, out of all suppliers."""
    out = network.nearest_two(lake.cities.withColumnRenamed("city_id", "place_id"), lake.warehouses.withColumnRenamed("warehouse_id", "site_id"))
    return out.withColumn("km", rounded(F.col("km"), 3))


@query()
def join_corridor(lake):
    """Cities along the way from every warehouse city to every other one in the
    same region."""
    place = lake.cities.select("city_id", "lat", "lon", "state")
    start = lake.warehouses.select("city_id").distinct().join(place, "city_id").select(
        F.col("city_id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "state")
    end = place.select(F.col("city_id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "state")
    pairs = start.join(end, "state").filter("a_id <> b_id").withColumn("pair_id", F.concat("a_id", F.lit(">"), "b_id"))
    return network.corridor(pairs.drop("state"), lake.cities).withColumn("da", rounded(F.col("da"), 3))


@query()
def route_build(lake):
    routes = network.route_build(lake.cities, lake.fulfilment_centres, lake.hubs)
    return routes.withColumn("path", F.array_join("path", ">"))


@query()
def src_dimensions(lake):
    parts = [lake.cities.select(F.lit("city").alias("dimension"), F.col("city_id").alias("id"), "name"),
             lake.warehouses.select(F.lit("warehouse").alias("dimension"), F.col("warehouse_id").alias("id"), "name"),
             lake.hubs.select(F.lit("hub").alias("dimension"), F.col("hub_id").alias("id"), "name"),
             lake.products().select(F.lit("product").alias("dimension"), F.col("product_id").alias("id"), "name"),
             lake.table("customer").select(F.lit("customer").alias("dimension"), F.concat(F.lit("U"), "c_custkey").alias("id"), F.col("c_name").alias("name"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query()
def join_alternative_route(lake):
    return scenario.join_alternative_route(lake.routes)


def _lines(lake):
    """Each route as a polyline through the cities it passes."""
    stops = (lake.routes.select("route_id", F.posexplode("path").alias("at", "city_id"))
             .join(lake.cities.select("city_id", "lat", "lon"), "city_id"))
    points = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("at", "lat", "lon"))).alias("stops"))
    return points.select(F.col("route_id").alias("line_id"), F.transform("stops", lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("points"))


@query("polyline_length_km")
def line_length(lake):
    return _lines(lake).select("line_id", rounded(polyline_length_km(F.col("points")), 3).alias("km"))


@query()
def sample_polyline(lake):
    return network.sample_polyline(_lines(lake), 50.0).withColumns({c: rounded(F.col(c), 4) for c in ("lat", "lon")})


@query()
def route_geojson(lake):
    return network.route_geojson(lake.cities, lake.warehouses, lake.hubs, lake.routes)
