"""Order and trip state kept up to date from the clean event stream.

Each micro-batch is reduced, with built-in aggregates only, to the latest event
of each kind per order and per trip, and stored as that batch's delta. The
reductions are maxima, so deltas merge by maximum: the order table at any time
is the merge of the compacted base and the deltas since. A repeated batch
replaces its own delta. Nothing is keyed by route or city, so a busy one is no
hot key. Compaction folds deltas into a new base and drops expired keys.

`LatestTrips` is the state-store form for trips, with event-time timers that
forget a trip on their own.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from raincourier import settings as S
from raincourier.functions import clock
from raincourier.operators import lifecycle, merge
from raincourier.streaming.keyed import BucketState, bucket_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def delta_writer(folder: str):
    """foreachBatch body: latest order and trip events of the batch. An event goes
    into one of the two only, so each parses its own kinds and no parsed batch is
    kept: its rows would fill the executors before anything is aggregated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = lifecycle.with_payload(batch.filter(F.col("type").isin(*lifecycle.ORDER_TYPES)))
        reports = lifecycle.with_payload(batch.filter(F.col("type").isin(*lifecycle.TRIP_TYPES)), *lifecycle.TRIP_FIELDS)
        lifecycle.latest_order_events(own).write.mode("overwrite").parquet(f"{folder}/orders/batch_id={batch_id}")
        lifecycle.latest_trip_events(reports).write.mode("overwrite").parquet(f"{folder}/trips/batch_id={batch_id}")
    return write


def read_facts(spark: SparkSession, folder: str):
    """(orders, trips): merged latest events over base and deltas."""
    orders = lifecycle.merge_latest(spark.read.parquet(f"{folder}/orders"), "order_id", lifecycle.ORDER_FACTS)
    trips = lifecycle.merge_latest(spark.read.parquet(f"{folder}/trips"), "trip_id", lifecycle.TRIP_FACTS)
    return orders, trips


def order_view(spark: SparkSession, folder: str, routes: DataFrame) -> DataFrame:
    """The order table; equals the batch fold of the same events."""
    orders, trips = read_facts(spark, folder)
    members = lifecycle.join_trip_members(lifecycle.settle_orders(orders), lifecycle.settle_trips(trips))
    return lifecycle.order_rows(members, routes)


def compact(spark: SparkSession, folder: str, target: str, routes: DataFrame, now) -> None:
    """Write the merged state, without expired orders, as the base (batch -1) of
    a new folder that the stream continues in."""
    orders, trips = read_facts(spark, folder)
    expired = lifecycle.expire_orders(order_view(spark, folder, routes), now, expired=True)
    kept = merge.delete_keys(orders, expired, ["order_id"])
    old = F.col("arrived.at") < clock.plus_hours(clock.moment(now), -float(S.KEEP_DELIVERED_H))
    kept.write.mode("overwrite").parquet(f"{target}/orders/batch_id=-1")
    # An old trip stays as long as one of its orders does.
    needed = kept.select(F.col("assigned.trip_id").alias("trip_id"), F.lit(True).alias("needed")).filter("trip_id IS NOT NULL").distinct()
    trips = trips.join(needed, "trip_id", "left").filter(F.coalesce("needed", ~old, F.lit(True))).drop("needed")
    trips.write.mode("overwrite").parquet(f"{target}/trips/batch_id=-1")


# ---- state store form ------------------------------------------------------
FIELDS = ("trip_id", "route_id", "status", "at", "event_id", "arrived_at", "gone")
STATUS = {"VEHICLE_DISPATCHED": "in_transit", "VEHICLE_MOVEMENT": "in_transit", "DELIVERY_DELAY": "in_transit", "HUB_ARRIVAL": "at_hub"}
TRIP_BUCKETS = 2048


class LatestTrips(StatefulProcessor):
    """Last report of each trip; a trip is forgotten two days after it arrived,
    or after two days without any report. The state is kept by bucket of trips, so a
    batch reads and writes it once a bucket and not once a trip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = BucketState(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trips, touched = self.state.load(), set()
        for batch in rows:
            arrivals = batch[batch["type"] == "HUB_ARRIVAL"].groupby("trip_id")["at"].max().to_dict()
            last = batch.sort_values(["at", "event_id"]).drop_duplicates("trip_id", keep="last")
            for trip, route, kind, at, event_id in zip(*(last[c].tolist() for c in ("trip_id", "route_id", "type", "at", "event_id"))):
                trips[trip] = self._merged(trips.get(trip), (route, STATUS[kind], at, event_id), arrivals.get(trip))
                touched.add(trip)
        self.state.save(trips, self._expiry)
        yield self._frame([(trip, *trips[trip], False) for trip in sorted(touched)])

    @staticmethod
    def _merged(seen, newest, arrived):
        """(route, status, at, event id, arrival) of a trip after one more report."""
        if seen is not None:
            newest, arrived = max(newest, seen[:4], key=lambda s: s[2:4]), max((t for t in (seen[4], arrived) if t is not None), default=None)
        return (*newest, None) if arrived is None else (newest[0], "at_hub", *newest[2:], arrived)

    @staticmethod
    def _expiry(seen) -> int:
        last = seen[2] if seen[4] is None else seen[4]
        return last // 1000 + S.KEEP_DELIVERED_H * HOUR_MS

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(FIELDS)).astype({"at": "int64", "arrived_at": "Int64", "gone": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        trips = self.state.load(rung=expiredTimerInfo.getExpiryTimeInMs())
        gone = sorted(trip for trip, seen in trips.items() if self._expiry(seen) <= now)
        self.state.save({trip: seen for trip, seen in trips.items() if self._expiry(seen) > now}, self._expiry)
        yield self._frame([(trip, None, None, now * 1000, "", None, True) for trip in gone])

    def close(self) -> None:
        pass


def trip_stream(events: DataFrame, watermark: str = "1 hour", buckets: int = TRIP_BUCKETS) -> DataFrame:
    """Changes of trips (update mode); needs the RocksDB state store provider."""
    rows = events.filter(F.col("type").isin(*STATUS)).withWatermark("sim_time", watermark)
    rows = rows.select(F.get_json_object("payload", "$.trip_id").alias("trip_id"), "type", "sim_time", F.unix_micros("sim_time").alias("at"),
                       "event_id", "route_id").withColumn("bucket", bucket_of("trip_id", buckets))
    schema = "trip_id string, route_id string, status string, at bigint, event_id string, arrived_at bigint, gone boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(LatestTrips(), schema, "Update", "EventTime")


def current_trips(changes: DataFrame) -> DataFrame:
    """Trips in state, from the change table (which carries batch_id)."""
    latest = merge.replace_current(changes, "trip_id", "batch_id").filter(~F.col("gone"))
    return latest.select("trip_id", "route_id", "status", F.timestamp_micros("at").alias("last_report"), F.timestamp_micros("arrived_at").alias("arrived_at"))
