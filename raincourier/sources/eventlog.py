"""The live order book written out as the event log that produces it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import clock
from raincourier.functions.numeric import rounded
from raincourier.operators.impact import latest_city_weather
from raincourier.functions.rain import hourly_class
from raincourier.sources.tables import Lake

MOVE_MIN = 30
PRODUCTS = 200


def _iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _event(kind, at, order=None, city="city_id", route="route_id", id_=None, **payload):
    fields = [value.alias(name) for name, value in payload.items()]
    return F.struct(
        F.concat(id_, F.lit(":" + kind)).alias("event_id"), F.lit(kind).alias("type"), at.alias("sim_time"), at.alias("emitted_at"),
        (F.lit(None).cast("string") if order is None else F.col(order)).alias("order_id"),
        (F.lit(None).cast("string") if city is None else F.col(city)).alias("city_id"),
        (F.lit(None).cast("string") if route is None else F.col(route)).alias("route_id"), F.to_json(F.struct(*fields)).alias("payload"))


def _stop_at(progress):
    last = F.size("path") - 1
    return F.element_at("path", F.least(last, F.bround(progress * last, 0).cast("int")) + 1)


def planned_trips(book: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per planned trip. All its orders share route, wave and truck, so what
    they share is grouped by as well, which leaves plain counts to a hash aggregate;
    what the route says is joined to the trips."""
    shared = ["route_id", "planned_dispatch", "arrive_at", "slip_at", "weather_min", "trip_class", "planned_truck"]
    trips = book.groupBy(F.col("planned_trip_id").alias("trip_id"), *shared).agg(
        F.count("*").cast("int").alias("orders"), F.count(F.when(F.col("status") != "delivered", 1)).alias("open_orders"))
    return trips.join(routes.select("route_id", "city_id", "warehouse_id", "hub_id", "path", "normal_eta_h"), "route_id")


KINDS = ("ORDER_CREATED", "ORDER_ASSIGNED", "DELIVERY_COMPLETED", "VEHICLE_DISPATCHED", "DELIVERY_DELAY", "HUB_ARRIVAL", "VEHICLE_MOVEMENT", "WEATHER_EVENT")


def _order_events(kind: str, book: DataFrame) -> DataFrame:
    c = F.col
    if kind == "ORDER_CREATED":
        lines = F.transform(F.sequence(F.lit(0), F.col("items") - 1), lambda i: F.struct(
            F.concat(F.lit("P"), (c("number") * 3 + i * 31) % PRODUCTS).alias("product_id"), (i + 1).alias("qty"), (i + 1).cast("double").alias("price_inr")))
        event = _event(kind, c("created_at"), "order_id", id_=c("order_id"), customer_id=c("customer_id"), warehouse_id=c("warehouse_id"),
                       hub_id=c("hub_id"), route_code=c("route_code"), category_id=c("category_id"), tier=c("tier"), value_inr=c("value_inr"), items=lines,
                       planned_dispatch=_iso("planned_dispatch"), promised_at=F.date_format("promised_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif kind == "ORDER_ASSIGNED":
        event = _event(kind, c("assign_at"), "order_id", id_=c("order_id"), trip_id=c("planned_trip_id"), vehicle_id=c("planned_truck"))
    else:
        event = _event(kind, c("done_at"), "order_id", id_=c("order_id"), trip_id=c("planned_trip_id"), route_code=c("route_code"),
                       tier=c("tier"), category_id=c("category_id"), weather_class=c("trip_class"), weather_delay_min=c("weather_min"),
                       delay_min=c("weather_min") + c("number") % 30, sla_breached=c("done_at") > c("promised_at"), dispatched_at=_iso("planned_dispatch"))
    return book.select(event.alias("e")).select("e.*")


def _trip_events(kind: str, trips: DataFrame) -> DataFrame:
    c = F.col
    if kind == "VEHICLE_DISPATCHED":
        event = _event(kind, c("planned_dispatch"), id_=c("trip_id"), trip_id=c("trip_id"), vehicle_id=c("planned_truck"),
                       warehouse_id=c("warehouse_id"), hub_id=c("hub_id"), orders=c("orders"),
                       planned_arrival=_iso(clock.plus_hours(c("planned_dispatch"), c("normal_eta_h") - S.LAST_MILE_H)))
    elif kind == "DELIVERY_DELAY":
        trips = trips.filter(c("weather_min") >= S.LATE_TRIP_MIN)
        event = _event(kind, c("slip_at"), id_=c("trip_id"), trip_id=c("trip_id"), vehicle_id=c("planned_truck"), delay_min=c("weather_min"),
                       cause=c("trip_class"), orders=c("orders"))
    elif kind == "HUB_ARRIVAL":
        event = _event(kind, c("arrive_at"), id_=c("trip_id"), trip_id=c("trip_id"), vehicle_id=c("planned_truck"), hub_id=c("hub_id"),
                       orders=c("orders"), weather_class=c("trip_class"))
    else:
        span = F.unix_micros("arrive_at") - F.unix_micros("planned_dispatch")
        beat = F.lit(MOVE_MIN * 60_000_000).cast("bigint")
        # Position reports every half hour while under way.
        trips = (trips.withColumn("beats", F.floor((span - 1) / beat).cast("int")).filter("beats > 0")
                 .withColumn("beat", F.explode(F.sequence(F.lit(1), F.col("beats"))))
                 .withColumn("at", clock.plus_minutes(c("planned_dispatch"), (c("beat") * MOVE_MIN).cast("double")))
                 .withColumn("progress", c("beat") * beat / span).withColumn("near", _stop_at(c("progress")))
                 .withColumn("key", F.concat("trip_id", F.lit(":"), "beat")))
        event = _event(kind, c("at"), id_=c("key"), trip_id=c("trip_id"), vehicle_id=c("planned_truck"), progress=rounded(c("progress"), 3), near_city=c("near"))
    return trips.select(event.alias("e")).select("e.*")


def lifecycle_events(lake: Lake, now=None, kinds: tuple = KINDS) -> DataFrame:
    """Everything that happened up to `now`, as envelope rows, or the given kinds
    of events only: what no kind asked for needs is not derived."""
    book = lake.order_book if now is None else lake.live_orders(now)
    parts = []
    for kind in kinds:
        if kind in KINDS[:3]:
            parts.append(_order_events(kind, book))
        elif kind != "WEATHER_EVENT":
            parts.append(_trip_events(kind, lake.trip_plan if now is None else planned_trips(book, lake.city_routes())))
        else:
            weather = lake.hourly_rain().withColumn("key", F.concat("city_id", F.lit(":"), _iso("hour")))
            parts.append(weather.select(_event(kind, F.col("hour"), route=None, id_=F.col("key"), rain_mmph=F.col("mm"), severity=hourly_class(F.col("mm"))).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("sim_time") <= (lake.now if now is None else clock.moment(now)))


def open_trips(lake: Lake, now=None) -> DataFrame:
    """Trip table at `now`, straight from the plan (no event log)."""
    plan = lake.trip_plan if now is None else planned_trips(lake.live_orders(now), lake.city_routes())
    now = lake.now if now is None else clock.moment(now)
    trips = plan.filter(clock.plus_minutes(F.col("planned_dispatch"), -30) <= now)
    gone, arrived = F.col("planned_dispatch") <= now, F.col("arrive_at") <= now
    slipped = (F.col("weather_min") >= S.LATE_TRIP_MIN) & (F.col("slip_at") <= now)
    span = F.unix_micros("arrive_at") - F.unix_micros("planned_dispatch")
    beat = F.lit(MOVE_MIN * 60_000_000).cast("bigint")
    beats = F.floor(F.least(F.unix_micros(now) - F.unix_micros("planned_dispatch"), span - 1) / beat)
    return trips.filter("open_orders > 0").select(
        "trip_id", "route_id", F.when(gone, F.col("planned_truck")).alias("vehicle_id"), F.when(gone, F.col("planned_dispatch")).alias("dispatched_at"),
        F.when(arrived, "at_hub").when(gone, "in_transit").alias("status"), F.when(slipped, F.col("weather_min")).otherwise(0.0).alias("delay_min"),
        F.when(slipped, F.col("trip_class")).otherwise("none").alias("cause"), F.when(beats >= 1, _stop_at(beats * beat / span)).alias("near_city"), "open_orders")


def city_weather(lake: Lake, now=None) -> DataFrame:
    """Latest reading per city at `now`."""
    now = lake.now if now is None else clock.moment(now)
    # Constant id: one reading per city and hour, so sim_time alone decides.
    readings = lake.hourly_rain().filter(F.col("hour") <= now).select(
        "city_id", F.col("hour").alias("sim_time"), F.lit("").alias("event_id"), F.col("mm").alias("rain_mmph"), hourly_class(F.col("mm")).alias("severity"))
    return latest_city_weather(readings, lake.cities)
