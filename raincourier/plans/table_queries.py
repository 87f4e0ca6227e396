"""Sinks and table maintenance, each read back as a query result."""
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.functions import clock
from raincourier.functions.numeric import rounded
from raincourier.functions import rain
from raincourier.operators import climate, history, impact, ingest, lifecycle, merge, scenario
from raincourier.plans import ingest_queries, live_queries
from raincourier.plans.catalog import query
from raincourier.sources import eventlog, readers, sinks
from raincourier.sources.schemas import ORDER_IDENTITY, ORDER_PROGRESS
from raincourier.sources.scratch import scratch
from raincourier.sources.tables import COEFS, NOW

YESTERDAY = NOW - timedelta(hours=24)


@query()
def src_tables(lake):
    """SQL with bound parameters over registered tables."""
    readers.register_tables({"rc_lineitem": lake.table("lineitem"), "rc_part": lake.table("part")})
    return readers.rows(lake.spark, """
        SELECT p_type AS category, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM rc_lineitem JOIN rc_part ON p_partkey = l_partkey
        WHERE l_shipdate >= CAST(:since AS TIMESTAMP_NTZ) AND l_returnflag = :flag GROUP BY p_type""",
        {"since": "1998-01-01", "flag": "R"})


def _read(lake, path):
    return lake.spark.read.parquet(path)


@query()
def sink_raw_partitioned(lake):
    """Raw events written by arrival date; read back per partition."""
    path = scratch(lake.spark, "raw")
    dated = ingest_queries.checked(lake).drop("raw").withColumn("date", F.to_date("kafka_ts"))
    dated.write.partitionBy("date").parquet(path)
    return _read(lake, path).groupBy("date").agg(F.count("*").alias("rows"), F.count("event_id").alias("with_id"))


@query()
def sink_quarantine(lake):
    path = scratch(lake.spark, "quarantine")
    sinks.json_folder(path)(ingest.quarantine(ingest_queries.checked(lake)), 0)
    text = lake.spark.read.text(path)
    return text.select(F.get_json_object("value", "$.reason").alias("reason"), F.get_json_object("value", "$.event_id").alias("event_id"))


@query()
def sink_multi(lake):
    """One batch to two sinks, delivered twice: the second run changes nothing."""
    first, second = scratch(lake.spark, "multi-json"), scratch(lake.spark, "multi-table")
    writer = sinks.sink_multi(sinks.json_folder(first), sinks.batch_folder(second))
    clean = ingest_queries.clean(lake)
    for _ in range(2):
        writer(clean, 7)
    as_json = lake.spark.read.text(first).groupBy(F.get_json_object("value", "$.type").alias("type")).agg(F.count("*").alias("json_rows"))
    as_table = _read(lake, second).groupBy("type").agg(F.count("*").alias("table_rows"))
    return as_json.join(as_table, "type")


@query()
def sink_jdbc_append(lake):
    """The relational append through an injected writer (no driver jar here)."""
    path = scratch(lake.spark, "jdbc")
    writer = sinks.jdbc_table("jdbc:example", "delivery_events", save=lambda df, url, table, properties: df.write.mode("append").parquet(f"{path}/{table}"))
    writer(ingest_queries.clean(lake), 1)
    return _read(lake, f"{path}/delivery_events").groupBy("type", "batch_id").agg(F.count("*").alias("rows"))


@query()
def sink_bulk_load(lake):
    path = scratch(lake.spark, "bulk")
    for _ in range(2):
        sinks.bulk_load(lake.daily_rain().withColumn("severity", rain.daily_class(F.col("rain_mm"))), path)
    return _read(lake, path).groupBy("severity").agg(F.count("*").alias("rows"), rounded(F.sum("rain_mm"), 1).alias("rain_mm"))


@query()
def materialize_monthly(lake):
    """Full build, then a refresh of two months only; the table stays whole."""
    path, fact = scratch(lake.spark, "monthly"), lake.history("route", "category")
    sinks.materialize_monthly(fact, path)
    months = [F.lit(m).cast("date") for m in ("1998-07-01", "1998-08-01")]
    sinks.materialize_monthly(fact, path, months)
    return _read(lake, path).groupBy("month").agg(F.count("*").alias("rows"), *[F.sum(c).cast("bigint").alias(c) for c in history.SUMS],
                                                  rounded(F.sum("delay_min_sum"), 2).alias("delay_min_sum"))


# ---- merges ----------------------------------------------------------------
def _order_versions(lake):
    now = clock.moment(YESTERDAY)
    old = lake.live_orders(YESTERDAY).filter(F.col("created_at") <= now).select(*ORDER_IDENTITY, *ORDER_PROGRESS)
    new = lake.order_book.select(*ORDER_IDENTITY, *ORDER_PROGRESS).withColumn("value_inr", F.col("value_inr") + 1).withColumn("version", F.lit(1))
    return old, new


@query()
def merge_upsert_orders(lake):
    """Yesterday's order table brought up to date: values of known orders stay,
    their status moves on, new orders are inserted."""
    old, new = _order_versions(lake)
    return merge.upsert(old, new, ["order_id"], ORDER_PROGRESS, "version").select(
        "order_id", rounded(F.col("value_inr"), 2).alias("value_inr"), "status", "dispatched_at", "delivered_at", "delay_min")


def _rollup(fact):
    return fact.groupBy("date", "route_id", "category_id").agg(
        *[F.sum(c).alias(c) for c in history.ADDITIVE], rain.worst_class(F.col("severity")).alias("severity"))


@query()
def merge_additive_rollup(lake):
    """The mild days' roll-up with the heavy days' roll-up added."""
    fact = lake.history("route", "category")
    strong = F.col("severity").isin("heavy", "extreme")
    merged = merge.merge_additive(_rollup(fact.filter(~strong)), _rollup(fact.filter(strong)), ["date", "route_id", "category_id"],
                                  list(history.ADDITIVE), "severity")
    return merged.select("date", "route_id", "category_id", "severity", *history.SUMS,
                         *[rounded(F.col(c), 2).alias(c) for c in ("delay_min_sum", *history.COSTS)])


@query()
def merge_insert_ignore(lake):
    old = lifecycle.fold_items(lake.log("ORDER_CREATED"))
    return merge.insert_ignore(old, lake.order_items(), ["order_id", "product_id"])


@query()
def merge_delete_keys(lake):
    """Order items left after the expired orders are gone."""
    expired = lifecycle.expire_orders(lake.order_book, "2024-01-16T18:00:00Z", expired=True)
    left = merge.delete_keys(lake.order_items(), expired, ["order_id"])
    return left.groupBy("product_id").agg(F.count("*").alias("lines"))


@query()
def retention_prune(lake):
    kept = merge.retain(ingest_queries.checked(lake), "kafka_ts", 240, "2024-02-01T00:00:00Z")
    return ingest.clean_dedup(kept).select("event_id", "type", "kafka_ts")


@query()
def reset_from_date(lake):
    return merge.reset_from_date(lake.history(), "1999-01-01").groupBy("date").agg(F.sum("orders").alias("orders"))


@query()
def distinct_rows(lake):
    """The daily feed with every reading delivered twice."""
    feed = lake.daily_rain()
    return merge.distinct_rows(feed.unionByName(feed))


# ---- documents -------------------------------------------------------------
@query()
def save_scenario(lake):
    """A scenario run and its two results, saved and read back."""
    folder, grouped = scratch(lake.spark, "scenario"), live_queries.cohorts_of(lake)
    variants = [scenario.scenario_eval(grouped, lake.routes, live_queries.hourly(lake), COEFS, lake.now, levers)
                for levers in (None, live_queries.LEVERS)]
    sinks.save_scenario("run-1", NOW, 48, live_queries.LEVERS, *variants, folder)
    runs, results = _read(lake, f"{folder}/simulation_runs"), _read(lake, f"{folder}/scenario_results")
    number = {m: F.get_json_object("metrics", f"$.{m}").cast("bigint").alias(m) for m in ("orders", "exposed", "late", "cost_inr")}
    return results.join(runs, "run_id").select("run_id", "variant", "window_h", *number.values())


@query()
def publish_views(lake):
    """All live views of two ticks published; rows per view of the newest."""
    folder = scratch(lake.spark, "views")
    for tick in (0, 1):
        sinks.publish_views({"risk": live_queries.risk_of(lake).drop("contributions")}, folder, tick)
        risk = sinks.newest_view(lake.spark, folder, "risk")
        routes = live_queries.route_impact_of(lake, risk)
        rollup, future, kpis = live_queries.rollup_of(lake, routes), impact.future_summary(risk, lake.now), live_queries.kpis_of(lake, risk)
        levels, hourly = impact.union_levels(routes, rollup), live_queries.hourly(lake)
        views = {
            "future": future, "timeline": impact.risk_timeline(risk, lake.cities, hourly, lake.now), "impact": levels, "weather": eventlog.city_weather(lake),
            "kpis": kpis, "alerts": impact.alerts(future, kpis, routes, rollup, lake.warehouses), "top": impact.top_by_level(levels.filter("level <> 'hub'")),
            "critical": impact.critical_orders(lake.order_book, risk, 12), "forecast": climate.forecast_grid(lake.cities, hourly, lake.now)}
        sinks.publish_views(views, folder, tick)
    counts = [sinks.newest_view(lake.spark, folder, view).groupBy(F.lit(view).alias("view")).agg(F.count("*").alias("rows")) for view in ("risk", *views)]
    return reduce(DataFrame.unionByName, counts)
