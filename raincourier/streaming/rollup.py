"""The delivered roll-up kept up to date by micro-batches.

Orders that may still change the roll-up are kept by hash bucket of their id: the
latest creation and the completions. A batch opens the buckets of its orders,
takes what they contributed out of the roll-up and puts in what they contribute
now, so only the days concerned are added up again. Everything kept is additive,
the worst class included, which is read off counts per class."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import rain, service
from raincourier.functions.numeric import rounded
from raincourier.operators import lifecycle
from raincourier.streaming.keyed import KeyedTable, bucket_of

BUCKETS = 16
# An undelivered order is forgotten so long after its planned dispatch, an unannounced completion as a delivered order.
KEEP_UNDELIVERED_H = 24 * 7
_CREATED = "struct<sim_time: timestamp, event_id: string, route_id: string, category_id: string, tier: string, planned_dispatch: timestamp>"
_DONE = "array<struct<sim_time: timestamp, class: string, weather_delay_min: double, delay_min: double, breached: boolean>>"
_KEYS = ("date", "route_id", "category_id")
_COUNTS = ("orders", "exposed", "affected", "delayed", "sla_breaches", *[f"n_{c}" for c in S.RAIN_CLASSES])
_SUMS = ("delay_min_sum", "cost_transport", "cost_reship", "cost_sla")


def orders_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/orders", f"order_id string, o {_CREATED}, done {_DONE}")


def rollup_table(spark: SparkSession, path: str) -> KeyedTable:
    sums = ", ".join([f"{c} bigint" for c in _COUNTS] + [f"{c} double" for c in _SUMS])
    return KeyedTable(spark, f"{path}/rollup", f"date date, route_id string, category_id string, {sums}")


def _of_batch(batch: DataFrame) -> DataFrame:
    """One row per order of the batch: its latest creation, its completions, its latest time."""
    parsed = lifecycle.with_payload(batch.filter(F.col("type").isin("ORDER_CREATED", "DELIVERY_COMPLETED")))
    created = F.struct("sim_time", "event_id", "route_id", "p.category_id", "p.tier", "p.planned_dispatch")
    return parsed.groupBy("order_id").agg(
        F.max(F.when(F.col("type") == "ORDER_CREATED", created)).cast(_CREATED).alias("o"),
        F.collect_list(F.when(F.col("type") == "DELIVERY_COMPLETED", F.struct("sim_time", *lifecycle.completion_fields()))).cast(_DONE).alias("done"),
        F.max("sim_time").alias("top"))


def contributions(orders: DataFrame, o: str, done: str, sign: int) -> DataFrame:
    """What orders add to each (date, route, category): counts and sums, all additive."""
    done = orders.select(F.col(o).alias("o"), F.explode(done).alias("d")).filter(F.col("d.sim_time") >= F.col("o.sim_time")).select("o", "d.*")
    wet, one = F.col("class") != "none", F.lit(sign).cast("bigint")
    late, breached = F.coalesce("weather_delay_min", F.lit(0.0)), F.col("breached")
    flag = lambda condition: F.when(condition, one).otherwise(0)
    counts = {"orders": one, "exposed": flag(wet), "affected": flag(F.col("weather_delay_min") >= S.AFFECTED_MIN), "delayed": flag(F.col("delay_min") >= S.DELAYED_MIN),
              "sla_breaches": flag(breached), **{f"n_{c}": flag(F.col("class") == c) for c in S.RAIN_CLASSES}}
    sums = {"delay_min_sum": late, "cost_transport": late / 60 * S.COST_PER_DELAY_HOUR, "cost_reship": rain.per_class(F.col("class"), S.FAILED_RATE) * S.COST_RESHIP,
            "cost_sla": F.when(breached & wet, service.sla_cost(F.col("o.tier"))).otherwise(0.0)}
    return done.select(F.to_date("sim_time").alias("date"), "o.route_id", "o.category_id", *[v.alias(n) for n, v in counts.items()], *[(v * sign).alias(n) for n, v in sums.items()])


def _added(rows: DataFrame) -> DataFrame:
    # Sums of minutes and money are kept to nine decimals, so taking out what was put in leaves nothing.
    return rows.groupBy(*_KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in _COUNTS], *[F.round(F.sum(c), 9).alias(c) for c in _SUMS])


def _day(date: str):
    return F.datediff(date, F.lit("1970-01-01"))


def rollup_writer(path: str, buckets: int = BUCKETS, keep_h: float = S.KEEP_DELIVERED_H, keep_undelivered_h: float = KEEP_UNDELIVERED_H):
    """foreachBatch body. An order and its delivery may come in any batches and in
    either order, and an order may be announced anew; a repeated batch changes
    nothing. A delivered order is forgotten `keep_h` after its delivery, counted by
    the latest order event seen; what comes for it later does not count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        orders, rollup = orders_table(spark, path), rollup_table(spark, path)
        orders_at, rollup_at = orders.manifest(before=batch_id), rollup.manifest(before=batch_id)
        fresh = _of_batch(batch).withColumn("bucket", bucket_of("order_id", buckets)).persist()
        state = changed = None
        try:
            seen = fresh.groupBy("bucket").agg(F.max(F.unix_micros("top")).alias("top")).collect()
            touched = [r.bucket for r in seen]
            high = max([float(r.top) for r in seen] + [orders_at.mark or 0.0])
            # Old and new rows of an order side by side: one pass over the touched buckets serves both tables.
            old = orders.rows(touched, orders_at).select("order_id", "bucket", F.col("o").alias("o0"), F.col("done").alias("done0"))
            both = old.unionByName(fresh.select("order_id", "bucket", F.col("o").alias("o1"), F.col("done").alias("done1")), allowMissingColumns=True)
            state = both.groupBy("order_id", "bucket").agg(F.max("o0").alias("o0"), F.first("done0", True).alias("done0"), F.max(F.coalesce("o1", "o0")).alias("o"),
                                                           F.first("done1", True).alias("done1")).persist()
            merged = state.withColumn("done", F.concat(*[F.coalesce(c, F.array().cast(_DONE)) for c in ("done0", "done1")]))
            mine = merged.filter("done1 IS NOT NULL")
            changes = contributions(mine, "o0", "done0", -1).unionByName(contributions(mine, "o", "done", 1))
            changed = _added(changes).filter(" OR ".join(f"{c} <> 0" for c in (*_COUNTS, *_SUMS))).withColumn("bucket", _day("date")).persist()
            days = [r.bucket for r in changed.select("bucket").distinct().collect()]
            whole = _added(rollup.rows(days, rollup_at).unionByName(changed)).filter("orders > 0").withColumn("bucket", _day("date"))
            last = F.unix_micros(F.array_max(F.transform("done", lambda d: d["sim_time"])))
            alive = F.coalesce(last >= high - keep_h * 3.6e9, F.unix_micros("o.planned_dispatch") >= high - keep_undelivered_h * 3.6e9, F.lit(True))
            rollup.replace(batch_id, whole, days, rollup_at)
            orders.replace(batch_id, merged.filter(alive), touched, orders_at, mark=high)
        finally:
            for table in (fresh, state, changed):
                if table is not None:
                    table.unpersist()
    return write


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up as `lifecycle.delivered_rollup` gives it."""
    worst = F.coalesce(*[F.when(F.col(f"n_{c}") > 0, c) for c in reversed(S.RAIN_CLASSES)])
    return rollup_table(spark, path).rows().select(*_KEYS, worst.alias("severity"), "orders", "exposed", "affected", "delayed", "sla_breaches",
                                                   *[rounded(F.col(c), 2).alias(c) for c in _SUMS])
