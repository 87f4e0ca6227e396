"""Steps that several queries share: the history by key, the roll-up by day, orders not dispatched yet."""
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.operators import history
from raincourier.plans import history_queries, live_queries
from raincourier.sources import eventlog
from raincourier.sources.tables import Lake

SF = "/root/testdata/sf0.001"


def _tables(df) -> set:
    return {f.rpartition("/")[2] for f in df.inputFiles()}


def test_categories_join_parts_only(spark):
    read = _tables(history_queries.hist_categories(Lake(spark, SF)))
    assert {"lineitem.parquet", "part.parquet"} <= read and not read & {"orders.parquet", "customer.parquet"}


def test_a_half_is_rounded_up_however_it_was_summed(spark):
    row = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in history.SUMS], F.lit(0.0).alias("delay_min_sum"), F.lit(139939.49999999997).alias("cost_transport"),
                                F.lit(0.0).alias("cost_reship"), F.lit(0.0).alias("cost_sla"))
    assert row.agg(*history.agg_measures()).first().weather_cost == 139940


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_critical_orders_need_no_order_book(spark):
    data = Lake(spark, SF)
    live_queries.critical_orders(data)
    assert "order_book" not in data.__dict__
    ahead = data.upcoming
    assert ahead.count() > 0 and _same(ahead, data.order_book.filter(F.col("status").isin(*S.UPCOMING)))


def test_one_roll_up_by_route_and_day_serves_index_and_history(spark):
    data = Lake(spark, SF)
    live_queries.blended_impact_index(data)
    assert "order_book" not in data.__dict__ and {"route_days", "trip_plan"} <= set(data.__dict__)
    sums = lambda df: df.groupBy("route_id", "date", "severity").agg(*[F.round(F.sum(c), 6).cast("double").alias(c) for c in history.ADDITIVE])
    assert _same(sums(data.route_days), sums(data.history("route")))
    assert _same(data.trip_plan, eventlog.planned_trips(data.order_book, data.city_routes()))
