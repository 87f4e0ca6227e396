"""Live state of orders as streams: trip reports joined to their members, and the
signed changes of upcoming cohorts.

A report belongs to the orders assigned to its trip before it, so assignments and
reports meet in a stream-stream join with a time range; what the range and the
watermark rule out leaves the state. Orders' own events and these reports then
meet per bucket of orders in the state store, where each order's place among the
upcoming cohorts is kept: what moves orders is summed to the changes of cohorts."""
from __future__ import annotations

from collections import Counter, defaultdict, namedtuple
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from raincourier import settings as S
from raincourier.operators import lifecycle
from raincourier.sources import sinks
from raincourier.streaming.keyed import BucketState, bucket_of

WATERMARK = "1 hour"
# A trip reports on an order at most so long after its assignment.
REPORTS_WITHIN_H = 96
REPORTS = ("VEHICLE_DISPATCHED", "DELIVERY_DELAY", "HUB_ARRIVAL")
REPORT_ROWS = "order_id string, trip_id string, type string, sim_time timestamp, event_id string, delay_min double, cause string"
HOUR_US = 3_600_000_000
ORDER_BUCKETS = 512
COHORT = ("route_id", "city_id", "tier", "dispatch")


def member_reports(source: Callable[[], DataFrame], within_h: int = REPORTS_WITHIN_H, watermark: str = WATERMARK) -> DataFrame:
    """(order_id, trip_id, type, sim_time, event_id, delay_min, cause): every report
    of a trip, for each order assigned to it before. `source` gives the clean event
    stream; each side of the join reads it for itself. Inner join, append mode."""
    assigned = lifecycle.with_payload(source().filter("type = 'ORDER_ASSIGNED'").withWatermark("sim_time", watermark), "trip_id")
    assigned = assigned.select("order_id", F.col("p.trip_id").alias("of_trip"), F.col("sim_time").alias("assigned_at"))
    reports = lifecycle.with_payload(source().filter(F.col("type").isin(*REPORTS)).withWatermark("sim_time", watermark), "trip_id", "delay_min", "cause")
    reports = reports.select(F.col("p.trip_id").alias("trip_id"), "type", "sim_time", "event_id", "p.delay_min", "p.cause")
    in_range = F.expr(f"of_trip = trip_id AND sim_time >= assigned_at AND sim_time <= assigned_at + INTERVAL {within_h} HOURS")
    return assigned.join(reports, in_range).select("order_id", "trip_id", "type", "sim_time", "event_id", "delay_min", "cause")


def order_view(orders: DataFrame, reports: DataFrame, routes: DataFrame) -> DataFrame:
    """The order table from the orders' own latest events and the joined reports;
    equals `lifecycle.fold_orders`. Keyed by order throughout: no trip is a hot key."""
    def latest(kind: str, *fields: str):
        return F.max(F.when(F.col("type") == kind, F.struct(F.col("sim_time").alias("at"), "event_id", *fields)))

    facts = reports.groupBy("order_id", "trip_id").agg(latest("VEHICLE_DISPATCHED").alias("dispatched"), latest("DELIVERY_DELAY", "delay_min", "cause").alias("delayed"),
                                                       latest("HUB_ARRIVAL").alias("arrived")).withColumnsRenamed({"order_id": "of_order", "trip_id": "of_trip"})
    members = lifecycle.settle_orders(orders).join(facts, (F.col("order_id") == F.col("of_order")) & (F.col("assigned.trip_id") == F.col("of_trip")), "left")
    for fact in ("dispatched", "delayed", "arrived"):  # reports before the order's latest assignment do not count
        members = members.withColumn(fact, F.when(F.col("assigned.at") <= F.col(f"{fact}.at"), F.col(fact)))
    since = F.coalesce("dispatched.at", F.timestamp_micros(F.lit(0)))
    members = members.withColumns({fact: F.when(F.col(f"{fact}.at") >= since, F.col(fact)) for fact in ("delayed", "arrived")})
    return lifecycle.order_rows(members.drop("of_order", "of_trip"), routes)


def order_changes(source: Callable[[], DataFrame], watermark: str = WATERMARK) -> DataFrame:
    """All that moves an order's status, as one stream keyed by order."""
    own = lifecycle.with_payload(source().filter(F.col("type").isin(*lifecycle.ORDER_TYPES)).withWatermark("sim_time", watermark), "trip_id", "tier", "planned_dispatch")
    own = own.select("order_id", "type", "sim_time", "event_id", "p.trip_id", "route_id", "city_id", "p.tier", F.unix_micros("p.planned_dispatch").alias("dispatch"))
    none = [F.lit(None).cast("string").alias(c) for c in ("route_id", "city_id", "tier")]
    joined = member_reports(source, watermark=watermark).filter("type <> 'DELIVERY_DELAY'").select("order_id", "type", "sim_time", "event_id", "trip_id", *none, F.lit(None).cast("long").alias("dispatch"))
    return own.unionByName(joined)


_FIELDS = ("created_at", "created_id", "route_id", "city_id", "tier", "dispatch", "assigned_at", "assigned_id", "trip_id", "completed_at", "reports")
Event = namedtuple("Event", "type at event_id trip_id route_id city_id tier dispatch")
_NO_TIME = -2 ** 63  # a null would turn a column of integers into one of floats


class Upcoming(StatefulProcessor):
    """Where orders stand among the upcoming cohorts. Emits what their moves add to the
    cohorts they join and take from those they leave. An order is forgotten, and
    leaves its cohort, two days after its delivery or six hours after a dispatch that
    never came; a dispatched one two days after the report. The state is kept by
    bucket of orders, so a batch reads and writes it once a bucket and not once an order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = BucketState(handle)

    @staticmethod
    def cohort(s: dict):
        """The cohort of an order that is scheduled or assigned, else None."""
        if s["created_at"] is None or (s["completed_at"] or -1) >= s["created_at"]:
            return None
        if s["assigned_at"] is not None and s["assigned_at"] >= s["created_at"]:
            if any(trip == s["trip_id"] and at >= s["assigned_at"] for trip, at in s["reports"]):
                return None
        return s["route_id"], s["city_id"], s["tier"], s["dispatch"]

    @staticmethod
    def expiry(s: dict):
        """Time in milliseconds from which nothing more is expected, by what is known."""
        moments = [t + S.KEEP_DELIVERED_H * HOUR_US for t in (s["completed_at"], *[at for _, at in s["reports"]]) if t is not None]
        moments += [t + S.EXPIRE_AFTER_H * HOUR_US for t in (s["dispatch"],) if t is not None]
        moments += [t + S.KEEP_DELIVERED_H * HOUR_US for t in (s["assigned_at"],) if t is not None and s["created_at"] is None]
        return max(moments, default=0) // 1000

    @staticmethod
    def take(s: dict, e) -> None:
        """Fold one event in; a later one of its kind replaces an earlier one."""
        mark = (e.at, e.event_id)
        if e.type == "ORDER_CREATED" and mark > (-1 if s["created_at"] is None else s["created_at"], s["created_id"] or ""):
            s.update(created_at=mark[0], created_id=e.event_id, route_id=e.route_id, city_id=e.city_id, tier=e.tier, dispatch=e.dispatch)
        elif e.type == "ORDER_ASSIGNED" and mark > (-1 if s["assigned_at"] is None else s["assigned_at"], s["assigned_id"] or ""):
            s.update(assigned_at=mark[0], assigned_id=e.event_id, trip_id=e.trip_id)
        elif e.type == "DELIVERY_COMPLETED":
            s["completed_at"] = max(mark[0], s["completed_at"] or -1)
        elif e.type in REPORTS:
            last = dict(s["reports"])
            last[e.trip_id] = max(mark[0], last.get(e.trip_id, -1))
            s["reports"] = sorted(last.items())

    @classmethod
    def fold(cls, kept: tuple | None, events: list) -> tuple:
        """What is kept of an order, its expiry last, after more events."""
        s = dict.fromkeys(_FIELDS) | {"reports": []} if kept is None else dict(zip(_FIELDS, kept))
        for e in events:
            cls.take(s, e)
        return (*(s[f] for f in _FIELDS), cls.expiry(s))

    @classmethod
    def _place(cls, kept: tuple | None):
        return None if kept is None else cls.cohort(dict(zip(_FIELDS, kept)))

    @staticmethod
    def _moves(moved: list) -> pd.DataFrame:
        """Sums of the (old, new) cohorts of orders, a row per cohort that changes."""
        sums = Counter()
        for old, new in moved:
            if old != new:
                sums[old] -= 1
                sums[new] += 1
        rows = [(*cohort, n) for cohort, n in sums.items() if cohort is not None and n]
        return pd.DataFrame(rows, columns=[*COHORT, "orders"]).astype({"dispatch": "Int64", "orders": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        orders, events = self.state.load(), defaultdict(list)
        for batch in rows:
            columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in Event._fields[:-1]]
            dispatch = [None if at == _NO_TIME else at for at in batch["dispatch"].tolist()]
            for order, e in zip(batch["order_id"].tolist(), map(Event, *columns, dispatch)):
                events[order].append(e)
        moved = []
        for order, new in events.items():
            before, orders[order] = orders.get(order), self.fold(orders.get(order), new)
            moved.append((self._place(before), self._place(orders[order])))
        self.state.save(orders, itemgetter(-1))
        yield self._moves(moved)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, orders = timerValues.getCurrentWatermarkInMs(), self.state.load(rung=expiredTimerInfo.getExpiryTimeInMs())
        gone = [order for order, kept in orders.items() if kept[-1] <= now]
        moved = [(self._place(orders.pop(order)), None) for order in gone]
        self.state.save(orders, itemgetter(-1))
        yield self._moves(moved)

    def close(self) -> None:
        pass


def cohort_deltas(source: Callable[[], DataFrame], watermark: str = WATERMARK, buckets: int = ORDER_BUCKETS) -> DataFrame:
    """Signed changes (route_id, city_id, tier, dispatch, orders) of upcoming
    cohorts, append mode; needs the RocksDB state store provider."""
    changes = order_changes(source, watermark).withColumns({
        "at": F.unix_micros("sim_time"), "dispatch": F.coalesce("dispatch", F.lit(_NO_TIME)), "bucket": bucket_of("order_id", buckets)})
    out = changes.groupBy("bucket").transformWithStateInPandas(Upcoming(), "route_id string, city_id string, tier string, dispatch bigint, orders bigint", "Append", "EventTime")
    return out.withColumn("dispatch", F.timestamp_micros("dispatch"))


class IncrementalTick:
    """foreachBatch body of the live engine over `cohort_deltas`: adds the batch's
    deltas to the stored cohort counts and rebuilds the views from those. A tick
    reads its batch and the cohort table, however old the log is. The risk is
    computed every `risk_every` ticks; a repeated tick starts from the one before it."""

    def __init__(self, folder: str, compute_risk: Callable[[DataFrame], DataFrame], compute_views: Callable[[DataFrame, DataFrame], dict], risk_every: int = 4):
        self.folder, self.compute_risk, self.compute_views, self.risk_every = folder, compute_risk, compute_views, risk_every

    def __call__(self, deltas: DataFrame, batch_id: int) -> None:
        spark, known = deltas.sparkSession, sinks.exists(deltas.sparkSession, f"{self.folder}/cohorts")
        counts = deltas.select(*COHORT, "orders")
        if known:
            counts = counts.unionByName(sinks.newest_view(spark, self.folder, "cohorts", before=batch_id))
        counts = counts.groupBy(*COHORT).agg(F.sum("orders").alias("orders")).filter("orders <> 0")
        sinks.publish_views({"cohorts": counts}, self.folder, batch_id)
        cohorts = current_cohorts(spark, self.folder)
        if batch_id % self.risk_every == 0 or not sinks.exists(spark, f"{self.folder}/risk"):
            sinks.publish_views({"risk": self.compute_risk(cohorts)}, self.folder, batch_id)
        sinks.publish_views(self.compute_views(cohorts, sinks.newest_view(spark, self.folder, "risk")), self.folder, batch_id)


def current_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.newest_view(spark, folder, "cohorts").filter("orders > 0")
