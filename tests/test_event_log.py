"""The event log by kinds, streams without a time limit, trips kept by bucket."""
import os
from datetime import datetime

from pyspark.sql import functions as F

from raincourier.functions import clock
from raincourier.operators import lifecycle
from raincourier.plans import state_queries
from raincourier.sources import eventlog
from raincourier.sources.tables import Lake
from raincourier.streaming import jobs
from raincourier.streaming.order_state import LatestTrips

SF = "/root/testdata/sf0.001"


def test_a_fold_derives_the_kinds_it_needs(spark):
    data = Lake(spark, SF)
    rollup = state_queries.delivered_rollup(data)
    assert sorted(os.listdir(data.log_root)) == ["DELIVERY_COMPLETED", "ORDER_CREATED"]  # no positions, no trips
    want = lifecycle.delivered_rollup(eventlog.lifecycle_events(data)).select(*rollup.columns)
    assert sorted(map(str, rollup.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    kinds = {r.type for r in data.event_log.select("type").distinct().collect()}
    assert kinds == {r.type for r in eventlog.lifecycle_events(data).select("type").distinct().collect()}


def test_a_long_stream_is_waited_for():
    class Slow:
        name, waits = "slow", []

        def awaitTermination(self, timeout=None):
            self.waits.append(timeout)
            return None if timeout is None else False

        def exception(self):
            return None

    jobs.drain([Slow()])
    assert Slow.waits == [None]


def test_a_trip_of_a_bucket():
    moved, arrived = ("R", "in_transit", 5, "b"), ("R", "at_hub", 9, "c")
    seen = LatestTrips._merged(None, moved, None)
    assert seen == ("R", "in_transit", 5, "b", None)
    assert LatestTrips._merged(seen, ("R", "in_transit", 4, "z"), None) == seen  # an older report
    seen = LatestTrips._merged(seen, arrived, 9)
    assert seen == ("R", "at_hub", 9, "c", 9)
    assert LatestTrips._merged(seen, ("R", "in_transit", 12, "d"), None) == ("R", "at_hub", 12, "d", 9)
    assert LatestTrips._expiry(seen) == 48 * 3_600_000


def test_moments_are_rounded_half_up(spark):
    hours = [0.0, 1.5, -0.25, 1 / 3, -1 / 3, 0.5 / 3.6e9, -0.5 / 3.6e9, 1234.56789]
    rows = spark.createDataFrame([(h,) for h in hours], "h double").select(
        F.unix_micros(clock.plus_hours(clock.moment(datetime(1970, 1, 1)), F.col("h"))).alias("got"), F.round(F.col("h") * 3.6e9).cast("bigint").alias("want")).collect()
    assert all(r.got == r.want for r in rows)
