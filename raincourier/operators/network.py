"""Network operators: nearest sites, corridors, routes, polylines.

Spatial joins run as equi-joins on cells of a 3-D grid over the unit sphere.
Points closer than one cell edge always lie in the 27 cells around each other,
so a probe of those cells is exact, has no seam at the poles or the date line,
and never compares all pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import geo
from raincourier.functions.numeric import clamp, pick, rounded

# Cell edge is 2**-level: level 20 is about 6 m, so that a dense site area stays
# split into small cells; level -2 holds the whole sphere.
LEVELS = tuple(range(20, -3, -2))
_AROUND = "flatten(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> (i, j, k))))))"


def _cell(coordinate: Column, level: Column) -> Column:
    return F.floor(coordinate * F.pow(F.lit(2.0), level))


def _placed(df: DataFrame) -> DataFrame:
    """Adds x, y, z on the unit sphere from lat, lon."""
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    return df.withColumns({"x": x, "y": y, "z": z})


def _own_cell(df: DataFrame, level: Column) -> DataFrame:
    """Adds (level, cx, cy, cz) of a placed row's own cell; `level` may be exploded."""
    return df.withColumn("level", level).withColumns(
        {f"c{axis}": _cell(F.col(axis), F.col("level")) for axis in "xyz"}).drop("x", "y", "z")


def _surrounding_cells(df: DataFrame) -> DataFrame:
    """One row for each of the 27 cells around the row's own cell."""
    moved = df.withColumn("step", F.explode(F.expr(_AROUND)))
    return moved.withColumns({"cx": F.expr("cx + step.i"), "cy": F.expr("cy + step.j"), "cz": F.expr("cz + step.k")}).drop("step")


_CELL = ["level", "cx", "cy", "cz"]


def nearest_two(places: DataFrame, sites: DataFrame) -> DataFrame:
    """Each place's two nearest sites: (place_id, site_id, km, role).

    `places` and `sites` carry an id, lat, lon (place_id / site_id). Cell counts
    pick, per place, the finest level whose surroundings hold two sites; those
    two are at most 3.47 edges away, so the surroundings two levels up (four
    times the edge) are certain to hold the true nearest two.
    """
    twins = W.partitionBy("lat", "lon").orderBy("site_id")
    sites = (sites.select("site_id", "lat", "lon").withColumn("twin", F.row_number().over(twins))
             .filter("twin <= 2").drop("twin"))
    levels = F.explode(F.array(*map(F.lit, LEVELS)))
    gridded = _own_cell(_placed(sites), levels)
    counts = gridded.groupBy(*_CELL).agg(F.count("*").alias("n"))
    probes = _surrounding_cells(_own_cell(_placed(places.select("place_id", "lat", "lon")), levels))
    level = (probes.join(counts, _CELL).groupBy("place_id", "level").agg(F.sum("n").alias("n"))
             .filter("n >= 2").groupBy("place_id")
             .agg(F.greatest(F.max("level") - 2, F.lit(min(LEVELS))).alias("search_level")))
    search = (places.select("place_id", "lat", "lon").join(level, "place_id", "left")
              .withColumn("search_level", F.coalesce("search_level", F.lit(min(LEVELS)))))
    search = _surrounding_cells(_own_cell(_placed(search), F.col("search_level")))
    site = gridded.select(*_CELL, "site_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    found = search.join(site, _CELL).select(
        "place_id", "site_id", geo.haversine_km(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon")).alias("km"))
    nearest = W.partitionBy("place_id").orderBy(rounded(F.col("km"), 6), "site_id")
    return (found.withColumn("n", F.row_number().over(nearest)).filter("n <= 2")
            .select("place_id", "site_id", "km", F.when(F.col("n") == 1, "primary").otherwise("secondary").alias("role")))


def corridor(pairs: DataFrame, cities: DataFrame, km: float = S.CORRIDOR_KM) -> DataFrame:
    """Cities within `km` of the segment a→b, one row per (pair_id, city) with
    the distance from a (travel order).

    `pairs`: pair_id, a_id, a_lat, a_lon, b_id, b_lat, b_lon. A city that
    passes satisfies da + db <= length + 2 km, hence lies within half of that
    sum of the midpoint: the grid level with such an edge gives every
    candidate by equi-join.
    """
    ends = (F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    start, end = geo.unit_vector(*ends[:2]), geo.unit_vector(*ends[2:])
    # The midpoint of the arc points along the sum of both ends.
    probes = (pairs.withColumn("length", geo.haversine_km(*ends)).filter("length > 0")
              .withColumns({f"s{axis}": p + q for axis, p, q in zip("xyz", start, end)})
              .withColumn("norm", F.sqrt(F.expr("sx * sx + sy * sy + sz * sz")))
              .withColumns({axis: F.col(f"s{axis}") / F.col("norm") for axis in "xyz"})
              .withColumn("chord", geo.chord_of_km((F.col("length") + 2 * km) / 2 + 1e-6)).drop("sx", "sy", "sz", "norm"))
    level = clamp(F.floor(-F.log2("chord")), -2, 12).cast("int")
    probes = _surrounding_cells(_own_cell(probes, level)).drop("chord")
    points = _own_cell(_placed(cities.select("city_id", "lat", "lon")), F.explode(F.sequence(F.lit(-2), F.lit(12))))
    near = (probes.join(points, _CELL).filter("city_id <> a_id AND city_id <> b_id")
            .withColumn("da", geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")))
            .withColumn("db", geo.haversine_km(F.col("b_lat"), F.col("b_lon"), F.col("lat"), F.col("lon"))))
    near = near.withColumn("s", F.expr("(da + db + length) / 2"))
    height = F.expr("2 * sqrt(greatest(s * (s - da) * (s - db) * (s - length), 0)) / length")
    return (near.filter((F.col("da") + F.col("db") <= F.col("length") + 2 * km) & (height <= km))
            .select("pair_id", "city_id", "da"))


def route_build(cities: DataFrame, warehouses: DataFrame, hubs: DataFrame) -> DataFrame:
    """Two routes per city: from the nearest (primary) and second nearest
    (secondary) warehouse, with road distance, rain sensitivity and the cities
    passed on the way (origin first, destination last)."""
    nearest = nearest_two(cities.withColumnRenamed("city_id", "place_id"),
                          warehouses.withColumnRenamed("warehouse_id", "site_id"))
    origin = cities.select(F.col("city_id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
                           F.col("name").alias("a_name"), F.col("sensitivity").alias("a_sensitivity"))
    target = cities.select(F.col("city_id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
                           F.col("name").alias("b_name"), F.col("sensitivity").alias("b_sensitivity"))
    pairs = (nearest.select(F.col("place_id").alias("b_id"), F.col("site_id").alias("warehouse_id"), "km", "role")
             .join(warehouses.select("warehouse_id", F.col("city_id").alias("a_id")), "warehouse_id")
             .join(origin, "a_id").join(target, "b_id")
             .withColumn("pair_id", F.concat(F.lit("R-"), "a_id", F.lit("-"), "b_id")))
    via = (corridor(pairs.select("pair_id", "a_id", "a_lat", "a_lon", "b_id", "b_lat", "b_lon"), cities)
           .groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("da", "city_id"))).alias("via")))
    local = F.col("a_id") == F.col("b_id")
    distance = F.when(local, S.LOCAL_KM).otherwise(F.col("km") * S.ROAD_FACTOR)
    long_extra = F.when(distance > S.LONG_ROUTE_KM, S.LONG_ROUTE_SENSITIVITY).otherwise(0.0)
    sensitivity = clamp((F.col("a_sensitivity") + 2 * F.col("b_sensitivity")) / 3 + long_extra, *S.SENSITIVITY_RANGE)
    passed = F.coalesce(F.transform("via", lambda v: v["city_id"]), F.array().cast("array<string>"))
    path = F.when(local, F.array("b_id")).otherwise(F.concat(F.array("a_id"), passed, F.array("b_id")))
    return (pairs.join(via, "pair_id", "left")
            .join(hubs.select("hub_id", F.col("city_id").alias("b_id")), "b_id")
            .select(F.col("pair_id").alias("route_id"), F.concat("a_name", F.lit(" → "), "b_name").alias("code"),
                    "warehouse_id", "hub_id", F.col("a_id").alias("origin_city_id"), F.col("b_id").alias("city_id"),
                    "role", pick(F.col("role"), S.ROUTE_SHARE).alias("share"),
                    rounded(distance, 1).alias("distance_km"), rounded(sensitivity, 2).alias("sensitivity"),
                    path.alias("path")))


def sample_polyline(lines: DataFrame, step_km: float) -> DataFrame:
    """Densify (line_id, points array<struct<lat, lon>>) so that neighbours are
    at most `step_km` apart; original vertices stay. Rows are (line_id, seg,
    step, lat, lon) in order of (seg, step)."""
    legs = (lines.filter(F.size("points") > 1)
            .select("line_id", F.size("points").alias("n"), "points",
                    F.explode(F.sequence(F.lit(1), F.size("points") - 1)).alias("seg"))
            .select("line_id", "seg", "n", F.element_at("points", F.col("seg")).alias("a"),
                    F.element_at("points", F.col("seg") + 1).alias("b")))
    ends = (F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    legs = legs.withColumn("parts", F.greatest(F.lit(1), F.ceil(geo.haversine_km(*ends) / step_km).cast("int")))
    steps = legs.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lat, lon = geo.intermediate_point(*ends, F.col("step") / F.col("parts"))
    vertex = F.col("step") == 0
    inner = steps.select("line_id", "seg", "step", F.when(vertex, F.col("a.lat")).otherwise(lat).alias("lat"),
                         F.when(vertex, F.col("a.lon")).otherwise(lon).alias("lon"))
    last = lines.filter(F.size("points") > 0).select(
        "line_id", F.size("points").alias("seg"), F.lit(0).alias("step"),
        F.element_at("points", -1)["lat"].alias("lat"), F.element_at("points", -1)["lon"].alias("lon"))
    return inner.unionByName(last)


def route_geojson(cities: DataFrame, warehouses: DataFrame, hubs: DataFrame, routes: DataFrame) -> DataFrame:
    """GeoJSON feature text per warehouse, hub, city and route."""

    def lonlat(lat, lon):
        return F.array(rounded(F.col(lon) if isinstance(lon, str) else lon, 4),
                       rounded(F.col(lat) if isinstance(lat, str) else lat, 4))

    def feature(df, layer, id_column, geometry_type, coordinates, properties):
        body = F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            F.struct(F.lit(layer).alias("layer"), *properties).alias("properties"))
        return df.select(F.lit(layer).alias("layer"), F.col(id_column).alias("id"), F.to_json(body).alias("feature"))

    sites = [feature(df, layer, key, "Point", lonlat("lat", "lon"), [F.col(key).alias("id"), "name", "city_id"])
             for df, layer, key in ((warehouses, "warehouse", "warehouse_id"), (hubs, "hub", "hub_id"))]
    city = feature(cities, "city", "city_id", "Point", lonlat("lat", "lon"),
                   [F.col("city_id").alias("id"), "name", "state", "demand"])
    place = cities.select("city_id", lonlat("lat", "lon").alias("xy"))
    stops = (routes.select("route_id", F.posexplode("path").alias("at", "stop"), F.size("path").alias("n"))
             .filter("at > 0 AND at < n - 1")
             .join(place.withColumnRenamed("city_id", "stop"), "stop")
             .groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("at", "xy"))).alias("mid")))
    ends = (routes.join(warehouses.select("warehouse_id", lonlat("lat", "lon").alias("from_xy")), "warehouse_id")
            .join(hubs.select("hub_id", lonlat("lat", "lon").alias("to_xy")), "hub_id").join(stops, "route_id", "left"))
    mid = F.coalesce(F.transform("mid", lambda m: m["xy"]), F.array().cast("array<array<double>>"))
    line = F.concat(F.array("from_xy"), mid, F.array("to_xy"))
    route = feature(ends, "route", "route_id", "LineString", line,
                    [F.col("route_id").alias("id"), "code", "role", "city_id", "warehouse_id", "distance_km"])
    return sites[0].unionByName(sites[1]).unionByName(city).unionByName(route)
