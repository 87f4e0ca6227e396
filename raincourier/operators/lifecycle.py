"""Orders and trips folded from the event log.

Order events and trip events are reduced separately to the latest fact of each
kind, then joined on the trip, so no task ever holds more than one order or
one trip and a busy route is no hot key. Canonical order is (sim_time,
event_id); a status never moves back. Events of unknown orders or trips are
ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourier import settings as S
from raincourier.functions import clock, rain, service
from raincourier.functions.numeric import finite, rounded
from raincourier.operators.ordered import in_ranges, running_before
from raincourier.sources.schemas import PAYLOAD

TRIP_TYPES = ("VEHICLE_DISPATCHED", "VEHICLE_MOVEMENT", "HUB_ARRIVAL", "DELIVERY_DELAY")
REPORT_TYPES = ("VEHICLE_DISPATCHED", "DELIVERY_DELAY", "HUB_ARRIVAL")
ORDER_TYPES = S.TYPES_WITH_ORDER
TRIP_FIELDS = ("trip_id", "vehicle_id", "planned_arrival", "near_city", "progress", "lat", "lon", "delay_min", "cause", "hub_id")


def with_payload(events: DataFrame, *fields: str) -> DataFrame:
    """Adds the parsed payload `p`, parsed once per row (see parse_envelope): all
    of its fields, or the given ones."""
    schema = T.StructType([f for f in PAYLOAD if not fields or f.name in fields])
    return events.select("*", F.explode(F.array(F.from_json("payload", schema))).alias("p"))


def _latest(kind: str, *fields: str) -> Column:
    """Aggregate: the fields of the last event of one type."""
    columns = [F.col("sim_time").alias("at"), F.col("event_id"), *[F.col(f"p.{f}").alias(f) if f not in ("city_id", "route_id") else F.col(f)
                                                                  for f in fields]]
    return F.max(F.when(F.col("type") == kind, F.struct(*columns)))


CREATED = ("city_id", "route_id", "customer_id", "warehouse_id", "hub_id", "category_id", "tier", "value_inr", "planned_dispatch", "promised_at")
ASSIGNED = ("trip_id", "vehicle_id")
COMPLETED = ("trip_id", "weather_class", "delay_min", "weather_delay_min", "sla_breached")


def latest_order_events(parsed: DataFrame, created=CREATED, assigned=ASSIGNED, completed=COMPLETED, lines: bool = True) -> DataFrame:
    """Latest created, assigned and completed event per order, with the fields
    named. All columns are maxima, so partial results of several batches merge by
    maximum again."""
    count = F.max(F.when(F.col("type") == "ORDER_CREATED", F.struct(F.col("sim_time").alias("at"), "event_id", F.size("p.items").alias("n"))))
    return parsed.filter(F.col("type").isin(*ORDER_TYPES)).groupBy("order_id").agg(
        _latest("ORDER_CREATED", *created).alias("created"), *([count.alias("lines")] if lines else []),
        _latest("ORDER_ASSIGNED", *assigned).alias("assigned"), _latest("DELIVERY_COMPLETED", *completed).alias("completed"))


def settle_orders(latest: DataFrame) -> DataFrame:
    """Orders that were created; what an order did before its latest creation
    is discarded."""
    known = latest.filter(F.col("created").isNotNull())
    return known.withColumns({fact: F.when(F.col(f"{fact}.at") >= F.col("created.at"), F.col(fact)) for fact in ("assigned", "completed")})


def order_facts(parsed: DataFrame) -> DataFrame:
    return settle_orders(latest_order_events(parsed))


def latest_trip_events(parsed: DataFrame) -> DataFrame:
    """Latest dispatch, position, delay and arrival per trip (all maxima)."""
    return parsed.filter(F.col("type").isin(*TRIP_TYPES)).groupBy(F.col("p.trip_id").alias("trip_id")).agg(
        F.max("route_id").alias("route_id"), _latest("VEHICLE_DISPATCHED", "vehicle_id", "planned_arrival").alias("dispatched"),
        _latest("VEHICLE_MOVEMENT", "near_city", "progress", "lat", "lon").alias("moved"),
        _latest("DELIVERY_DELAY", "delay_min", "cause").alias("delayed"), _latest("HUB_ARRIVAL", "hub_id").alias("arrived"))


def settle_trips(latest: DataFrame) -> DataFrame:
    """A dispatch discards the reports before it."""
    since = F.coalesce("dispatched.at", F.timestamp_micros(F.lit(0)))
    return latest.withColumns({fact: F.when(F.col(f"{fact}.at") >= since, F.col(fact)) for fact in ("moved", "delayed", "arrived")})


def trip_facts(parsed: DataFrame) -> DataFrame:
    return settle_trips(latest_trip_events(parsed))


def merge_latest(partials: DataFrame, key: str, facts) -> DataFrame:
    """Merge partial results of several batches into one row per key."""
    return partials.groupBy(key).agg(*[F.max(fact).alias(fact) for fact in facts])


ORDER_FACTS = ("created", "lines", "assigned", "completed")
TRIP_FACTS = ("route_id", "dispatched", "moved", "delayed", "arrived")


def join_trip_members(orders: DataFrame, trips: DataFrame) -> DataFrame:
    """Fan trip facts out to the orders that were assigned before them. Orders without
    a trip match none and are spread by their own ids: a null would be one hot key."""
    trip = F.col("assigned.trip_id")
    of_trip = F.when(trip.isNotNull(), F.concat(F.lit("+"), trip)).otherwise(F.concat(F.lit("-"), "order_id"))
    joined = orders.join(trips.drop("route_id"), of_trip == F.concat(F.lit("+"), trips["trip_id"]), "left")
    for fact in ("dispatched", "delayed", "arrived"):
        joined = joined.withColumn(fact, F.when(F.col("assigned.at") <= F.col(f"{fact}.at"), F.col(fact)))
    return joined.drop("moved", "trip_id")


def order_rows(members: DataFrame, routes: DataFrame) -> DataFrame:
    """The order table: status, times, delay and outcome of each order."""
    c = F.col
    joined = members.withColumn("route_id", c("created.route_id")).join(routes.select("route_id", "normal_eta_h"), "route_id")
    eta = clock.plus_minutes(clock.plus_hours(c("dispatched.at"), c("normal_eta_h")), F.coalesce("delayed.delay_min", F.lit(0.0)))
    status = (F.when(c("completed").isNotNull(), "delivered").when(c("arrived").isNotNull(), "at_hub")
              .when(c("dispatched").isNotNull(), "in_transit").when(c("assigned").isNotNull(), "assigned").otherwise("scheduled"))
    slipped = c("dispatched").isNotNull() & c("delayed").isNotNull()
    return joined.select(
        "order_id", "created.customer_id", "created.city_id", "route_id", "created.warehouse_id", "created.hub_id", "created.category_id",
        "created.tier", "created.value_inr", c("lines.n").alias("items"), status.alias("status"), c("created.at").alias("created_at"),
        "created.planned_dispatch", "created.promised_at", c("dispatched.at").alias("dispatched_at"), eta.alias("eta_at"),
        c("completed.at").alias("delivered_at"), "assigned.vehicle_id", "assigned.trip_id",
        F.coalesce("completed.weather_class", F.when(slipped, c("delayed.cause"))).alias("weather_class"), c("completed.delay_min").alias("delay_min"),
        c("completed.weather_delay_min").alias("weather_delay_min"), c("completed.sla_breached").alias("sla_breached"))


def fold_orders(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Batch twin of the streaming order state: one row per order."""
    own = with_payload(events.filter(F.col("type").isin(*ORDER_TYPES)))
    reports = with_payload(events.filter(F.col("type").isin(*REPORT_TYPES)), *TRIP_FIELDS)  # positions do not enter the order table
    return order_rows(join_trip_members(order_facts(own), trip_facts(reports)), routes)


def fold_trips(events: DataFrame) -> DataFrame:
    """One row per open trip with its movement state and open orders; a trip
    whose orders are all delivered is closed."""
    orders = settle_orders(latest_order_events(with_payload(events, "trip_id"), ("route_id",), ("trip_id",), (), lines=False))
    members = orders.filter(F.col("assigned").isNotNull()).groupBy(F.col("assigned.trip_id").alias("trip_id")).agg(
        F.count("*").alias("members"), F.count("completed").alias("done"), F.max("created.route_id").alias("member_route"))
    joined = trip_facts(with_payload(events, *TRIP_FIELDS)).join(members, "trip_id", "full")
    known = F.col("dispatched").isNotNull() | F.col("members").isNotNull()
    open_orders = F.coalesce(F.col("members") - F.col("done"), F.lit(0))
    joined = joined.filter(known & ~F.coalesce((F.col("members") > 0) & (F.col("members") == F.col("done")), F.lit(False)))
    return joined.select(
        "trip_id", F.coalesce("route_id", "member_route").alias("route_id"), "dispatched.vehicle_id", F.col("dispatched.at").alias("dispatched_at"),
        "dispatched.planned_arrival", F.when(F.col("arrived").isNotNull(), "at_hub").when(F.col("dispatched").isNotNull(), "in_transit").alias("status"),
        F.coalesce("delayed.delay_min", F.lit(0.0)).alias("delay_min"), F.coalesce("delayed.cause", F.lit("none")).alias("cause"),
        F.coalesce("moved.progress", F.lit(0.0)).alias("progress"), "moved.near_city", "moved.lat", "moved.lon", open_orders.alias("open_orders"))


def fold_items(events: DataFrame) -> DataFrame:
    """Order lines announced by creations; the first line of a product stays."""
    lines = (with_payload(events.filter("type = 'ORDER_CREATED'"), "items")
             .select("order_id", "sim_time", "event_id", F.posexplode("p.items").alias("line", "item")))
    first = lines.groupBy("order_id", "item.product_id").agg(F.min(F.struct("sim_time", "event_id", "line", "item.qty", "item.price_inr")).alias("first"))
    return first.select("order_id", "product_id", "first.qty", "first.price_inr")


def weather_events(events: DataFrame) -> DataFrame:
    return with_payload(events.filter("type = 'WEATHER_EVENT'")).select("city_id", "sim_time", "event_id", "p.rain_mmph", "p.severity")


def creations(parsed: DataFrame) -> DataFrame:
    """Latest creation per order, with what a delivery is accounted by."""
    return parsed.filter("type = 'ORDER_CREATED'").groupBy("order_id").agg(
        F.max(F.struct("sim_time", "event_id", "route_id", "p.category_id", "p.tier")).alias("o"))


def completion_fields() -> list[Column]:
    """What a completion is accounted by, from its parsed payload."""
    return [F.col("p.weather_class").alias("class"), finite(F.col("p.weather_delay_min")).alias("weather_delay_min"),
            finite(F.col("p.delay_min")).alias("delay_min"), F.coalesce("p.sla_breached", F.lit(False)).alias("breached")]


def completions(parsed: DataFrame) -> DataFrame:
    return parsed.filter("type = 'DELIVERY_COMPLETED'").select("order_id", "sim_time", *completion_fields())


def delivered_rollup(events: DataFrame) -> DataFrame:
    """Completed deliveries per (day, route, category), ready to be added to
    the history fact. Completions of unknown orders do not count."""
    done = with_payload(events, "weather_class", "weather_delay_min", "delay_min", "sla_breached")
    return account(completions(done), creations(with_payload(events, "category_id", "tier")))


def account(done: DataFrame, known: DataFrame) -> DataFrame:
    """Completions joined with their orders' creations, added up per day, route and category."""
    joined = done.join(known, "order_id").filter(F.col("sim_time") >= F.col("o.sim_time"))
    wet, cost = F.col("class") != "none", F.col("weather_delay_min") / 60 * S.COST_PER_DELAY_HOUR

    def flag(condition):
        return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")

    return joined.groupBy(F.to_date("sim_time").alias("date"), "o.route_id", "o.category_id").agg(
        rain.worst_class(F.col("class")).alias("severity"), F.count("*").alias("orders"), flag(wet).alias("exposed"),
        flag(F.col("weather_delay_min") >= S.AFFECTED_MIN).alias("affected"), flag(F.col("delay_min") >= S.DELAYED_MIN).alias("delayed"),
        flag(F.col("breached")).alias("sla_breaches"), rounded(F.sum("weather_delay_min"), 2).alias("delay_min_sum"),
        rounded(F.sum(cost), 2).alias("cost_transport"), rounded(F.sum(rain.per_class(F.col("class"), S.FAILED_RATE) * S.COST_RESHIP), 2).alias("cost_reship"),
        rounded(F.sum(F.when(F.col("breached") & wet, service.sla_cost(F.col("o.tier"))).otherwise(0.0)), 2).alias("cost_sla"))


# ---- housekeeping ----------------------------------------------------------
def expire_orders(orders: DataFrame, now, expired: bool = False) -> DataFrame:
    """Orders still worth keeping (or, with expired, the ones to forget):
    delivered ones for two days, undispatched ones until six hours past."""
    now = clock.moment(now)
    done = (F.col("status") == "delivered") & (F.col("delivered_at") < clock.plus_hours(now, -S.KEEP_DELIVERED_H))
    lost = F.col("status").isin(*S.UPCOMING) & (F.col("planned_dispatch") < clock.plus_hours(now, -S.EXPIRE_AFTER_H))
    gone = F.coalesce(done | lost, F.lit(False))
    return orders.filter(gone if expired else ~gone)


def changed_orders(events: DataFrame, since) -> DataFrame:
    """Orders touched by events later than `since`: named ones, and the members
    of trips that reported."""
    parsed = with_payload(events, "trip_id")
    recent = parsed.filter(F.col("sim_time") > clock.moment(since))
    named = recent.filter(F.col("type").isin(*ORDER_TYPES)).select("order_id").distinct()
    trips = recent.filter(F.col("type").isin(*REPORT_TYPES)).select(F.col("p.trip_id").alias("trip_id")).distinct()
    orders = settle_orders(latest_order_events(parsed, (), ("trip_id",), (), lines=False))
    members = orders.select("order_id", F.col("assigned.trip_id").alias("trip_id")).join(trips, "trip_id", "left_semi").select("order_id")
    return named.unionByName(members).distinct()


def high_water_mark(events: DataFrame) -> DataFrame:
    """Business time reached after each arrival instant (running maximum)."""
    instants = events.groupBy("emitted_at").agg(F.max("sim_time").alias("reached")).withColumn("at", F.unix_micros("emitted_at").cast("double"))
    before = running_before(instants, "at", {"earlier": (F.max, F.col("reached"))})
    return before.select("emitted_at", F.greatest("reached", "earlier").alias("high_water"))


_BEFORE = -(1 << 62)  # nothing reached yet
_JUMP_US = int(S.REPLAY_JUMP_H * 3_600_000_000)


def _next_start(low: np.ndarray, high: np.ndarray, first: int, reached: int) -> int:
    """Row from `first` on where business time falls behind what was reached, or the number of rows."""
    before = np.maximum.accumulate(np.concatenate([[reached], high[first:-1]]))[:len(low) - first]
    hits = low[first:] < before - _JUMP_US
    return first + int(hits.argmax()) if hits.any() else len(low)


def _starts(low: np.ndarray, high: np.ndarray, reached: int) -> list[int]:
    """All rows where a lap starts, entering with what was reached before."""
    out, at = [], _next_start(low, high, 0, reached)
    while at < len(low):
        out.append(at)
        at = _next_start(low, high, at + 1, int(high[at])) if at + 1 < len(low) else len(low)
    return out


def _range_summary(group: pd.DataFrame) -> pd.DataFrame:
    """What a key range does to the highest time reached on entry: the laps begun
    in it and the highest time on exit. Entering above a limit begins a lap at the
    row that sets it, and what follows no longer depends on the entry; limits fall
    from row to row, so they are the running minima of the rows. The last entry,
    without a limit, is for all others."""
    group = group.sort_values("at")
    low, high = group["low_us"].to_numpy(), group["high_us"].to_numpy()
    inner = _next_start(low, high, 0, _BEFORE)
    least = np.minimum.accumulate(low[:inner]) if inner else low[:0]
    records = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]])) if len(least) else np.zeros(0, np.int64)
    known: dict[int, tuple[int, int]] = {}

    def after(start: int) -> tuple[int, int]:
        """(laps begun from this start on, highest time on exit)."""
        path = []
        while start not in known and start < len(low):
            path.append(start)
            start = _next_start(low, high, start + 1, int(high[start])) if start + 1 < len(low) else len(low)
        laps, reached = known.get(start, (0, int(high[path[-1]:].max()) if path else _BEFORE))
        for row in reversed(path):
            laps += 1
            known[row] = laps, reached
        return laps, reached

    rows = [(int(low[r]) + _JUMP_US, *after(int(r))) for r in records]
    rows.append((_BEFORE, *after(inner)) if inner < len(low) else (_BEFORE, 0, int(high.max())))
    return pd.DataFrame([(group["_range"].iloc[0], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], inner < len(low))], columns=["_range", "above", "laps", "reached", "inner"])


def _through(summary, reached: int) -> tuple[int, int]:
    """(laps begun, highest time on exit) of a range entered with `reached`."""
    for above, laps, out in zip(summary.above[:-1], summary.laps, summary.reached):
        if reached > above:
            return laps, out
    return (summary.laps[-1], summary.reached[-1]) if summary.inner else (0, max(reached, summary.reached[-1]))


def replay_wrap(events: DataFrame) -> DataFrame:
    """Number the laps of a replay: a new lap starts when business time falls
    more than twelve hours behind the lap's high-water mark. Arrival order is
    emitted_at; simultaneous events run in business-time order.

    The log is read once into key ranges. Each range is summed up by itself, the
    few summaries are folded in order, and each range then numbers its instants,
    so the number of jobs does not depend on the number of laps."""
    instants = events.groupBy("emitted_at").agg(F.unix_micros(F.min("sim_time")).alias("low_us"), F.unix_micros(F.max("sim_time")).alias("high_us"))
    split = in_ranges(instants.withColumn("at", F.unix_micros("emitted_at")), "at")
    summaries = split.groupBy("_range").applyInPandas(_range_summary, "_range int, above array<bigint>, laps array<bigint>, reached array<bigint>, inner boolean")
    entries, reached, laps = [], _BEFORE, 0
    for summary in sorted(summaries.collect(), key=lambda s: s["_range"]):  # a row per range
        entries.append((summary["_range"], reached, laps))
        begun, reached = _through(summary, reached)
        laps += begun
    entry = events.sparkSession.createDataFrame(entries, "_range int, entry bigint, laps bigint")

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        begins = np.zeros(len(group), np.int64)
        begins[_starts(group["low_us"].to_numpy(), group["high_us"].to_numpy(), int(group["entry"].iloc[0]))] = 1
        return pd.DataFrame({"at": group["at"], "lap": group["laps"] + begins.cumsum()})

    numbered = split.join(F.broadcast(entry), "_range").groupBy("_range").applyInPandas(number, "at bigint, lap bigint")
    numbered = numbered.withColumnsRenamed({"at": "_at", "lap": "_lap"})
    return events.join(numbered, F.unix_micros("emitted_at") == F.col("_at")).select(*events.columns, F.col("_lap").alias("lap"))


def latest_lap(events: DataFrame) -> DataFrame:
    """Only the running lap: what came before a wrap is discarded."""
    laps = replay_wrap(events)
    return laps.filter(F.col("lap") == laps.agg(F.max("lap")).scalar())


