"""Order lifecycle queries over the event log."""
from pyspark.sql import functions as F

from raincourier.functions.numeric import rounded
from raincourier.operators import lifecycle, model
from raincourier.plans.catalog import query

TRIPS, ORDERS, REPORTS = lifecycle.TRIP_TYPES, lifecycle.ORDER_TYPES, lifecycle.REPORT_TYPES
DELIVERIES = ("ORDER_CREATED", "DELIVERY_COMPLETED")


@query()
def fold_orders(lake):
    return lifecycle.fold_orders(lake.log(*ORDERS, *REPORTS), lake.routes)


@query()
def fold_trips(lake):
    out = lifecycle.fold_trips(lake.log(*ORDERS, *TRIPS))
    return out.select("trip_id", "route_id", "vehicle_id", "dispatched_at", "status", "delay_min", "cause", "near_city", "open_orders")


@query()
def fold_items(lake):
    return lifecycle.fold_items(lake.log("ORDER_CREATED"))


@query()
def join_trip_members(lake):
    parsed = lifecycle.with_payload(lake.log(*ORDERS, *REPORTS))
    members = lifecycle.join_trip_members(lifecycle.order_facts(parsed), lifecycle.trip_facts(parsed))
    return members.filter(F.col("assigned").isNotNull()).select(
        "order_id", F.col("assigned.trip_id").alias("trip_id"), F.col("dispatched.at").alias("dispatched_at"),
        F.col("delayed.delay_min").alias("delay_min"), F.col("arrived.at").alias("arrived_at"))


@query()
def delivered_rollup(lake):
    return lifecycle.delivered_rollup(lake.log(*DELIVERIES))


@query()
def expire_orders(lake):
    """Orders to keep a day and a half after the reference moment."""
    return lifecycle.expire_orders(lake.order_book, "2024-01-16T18:00:00Z").select("order_id", "status", "planned_dispatch", "delivered_at")


@query()
def changed_orders(lake):
    return lifecycle.changed_orders(lake.log(*ORDERS, *REPORTS), "2024-01-15T04:00:00Z")


def replayed(lake):
    """The events table as three laps of a ten-day replay: business time starts
    over every ten days while arrival time runs on."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    back = F.floor(day / 10).cast("bigint") * 10 * 86_400_000_000
    at = F.col("ts").cast("timestamp")
    return lake.table("events").select(F.concat(F.lit("E"), "event_id").alias("event_id"), at.alias("emitted_at"),
                                       F.timestamp_micros(F.unix_micros(at) - back).alias("sim_time"))


@query()
def replay_wrap(lake):
    return lifecycle.replay_wrap(replayed(lake)).groupBy("lap").agg(
        F.count("*").alias("events"), F.min("emitted_at").alias("first_at"), F.max("emitted_at").alias("last_at"))


@query()
def high_water_mark(lake):
    return lifecycle.high_water_mark(replayed(lake))


@query()
def src_replay_log(lake):
    """State rebuilt from the retained log: orders by status and route."""
    folded = lifecycle.fold_orders(lake.log(*ORDERS, *REPORTS), lake.routes)
    return folded.groupBy("route_id", "status").agg(F.count("*").alias("orders"), rounded(F.sum("value_inr"), 2).alias("value"))


def completed_orders(lake):
    return lake.order_book.filter("status = 'delivered'").select(
        "route_id", "tier", F.col("trip_class").alias("true_class"), (1 + F.col("number") % 48).cast("double").alias("lead_h"), "sla_breached")


@query()
def training_features(lake):
    rows = model.training_features(completed_orders(lake), lake.routes)
    return rows.groupBy(*[rounded(F.col(f), 6).alias(f) for f in model.FEATURES]).agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


@query()
def fit_breach_model(lake):
    return model.breach_model(model.training_features(completed_orders(lake), lake.routes))


@query()
def auc(lake):
    """How well order value separates urgent orders."""
    rows = lake.table("orders").select(F.round(F.col("o_totalprice"), -2).alias("score"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("y"))
    return model.auc(rows)
