import json
import os
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from raincourier.operators import history, impact, lifecycle, merge
from raincourier.sources import eventlog, readers, sinks
from raincourier.sources.tables import lake
from raincourier.streaming import jobs, keyed, order_state, progress, rollup

SF = "/root/testdata/sf0.001"
T0 = datetime(2025, 7, 1)
ENVELOPE = "event_id string, type string, sim_time timestamp, emitted_at timestamp, order_id string, city_id string, route_id string, payload string"


def event(spark, rows):
    return spark.createDataFrame([(f"e{i}", kind, T0 + timedelta(hours=h), T0 + timedelta(minutes=i), order, "C", route, json.dumps(payload))
                                  for i, (kind, h, order, route, payload) in enumerate(rows)], ENVELOPE)


CREATED = {"customer_id": "u", "warehouse_id": "w", "hub_id": "h", "category_id": "k", "tier": "express", "value_inr": 10.0,
           "items": [{"product_id": "p", "qty": 1, "price_inr": 5.0}], "planned_dispatch": "2025-07-01T03:00:00Z", "promised_at": "2025-07-01T09:00:00Z"}
TRIP = {"trip_id": "t", "vehicle_id": "v"}


@pytest.fixture(scope="module")
def routes(spark):
    return spark.createDataFrame([("R", 4.0)], "route_id string, normal_eta_h double")


def fold(spark, routes, rows):
    return {r.order_id: r for r in lifecycle.fold_orders(event(spark, rows), routes).collect()}


def test_life_of_an_order(spark, routes):
    life = [("ORDER_CREATED", 0, "o", "R", CREATED), ("ORDER_ASSIGNED", 2, "o", "R", TRIP), ("VEHICLE_DISPATCHED", 3, None, "R", TRIP),
            ("DELIVERY_DELAY", 4, None, "R", {**TRIP, "delay_min": 30, "cause": "heavy"}), ("DELIVERY_DELAY", 5, None, "R", {**TRIP, "delay_min": 45, "cause": "heavy"}),
            ("HUB_ARRIVAL", 6, None, "R", TRIP),
            ("DELIVERY_COMPLETED", 7, "o", "R", {**TRIP, "weather_class": "heavy", "delay_min": 50.0, "weather_delay_min": 45.0, "sla_breached": False})]
    want = ["scheduled", "assigned", "in_transit", "in_transit", "in_transit", "at_hub", "delivered"]
    states = [fold(spark, routes, life[:n + 1])["o"] for n in range(len(life))]
    assert [s.status for s in states] == want
    # a delay replaces the earlier one, it does not add to it
    assert states[4].eta_at == T0 + timedelta(hours=7, minutes=45) and states[4].weather_class == "heavy"
    assert states[6].delay_min == 50 and states[6].items == 1


def test_unknown_ids_and_early_trip_events_are_ignored(spark, routes):
    got = fold(spark, routes, [
        ("DELIVERY_COMPLETED", 1, "ghost", "R", {**TRIP, "weather_class": "none", "delay_min": 1.0, "weather_delay_min": 0.0, "sla_breached": False}),
        ("HUB_ARRIVAL", 1, None, "R", {"trip_id": "nowhere"}), ("ORDER_CREATED", 2, "o", "R", CREATED),
        ("VEHICLE_DISPATCHED", 3, None, "R", TRIP), ("ORDER_ASSIGNED", 4, "o", "R", TRIP)])
    assert set(got) == {"o"} and got["o"].status == "assigned" and got["o"].eta_at is None


def test_replay_wrap_numbers_laps(spark):
    hours = [0, 5, 30, 29, 2, 10, 40, 28.5, 1]
    rows = [(f"e{i}", "WEATHER_EVENT", T0 + timedelta(hours=h), T0 + timedelta(minutes=i), None, "C", None, "{}") for i, h in enumerate(hours)]
    laps = lifecycle.replay_wrap(spark.createDataFrame(rows, ENVELOPE))
    assert [r.lap for r in laps.orderBy("emitted_at").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert lifecycle.latest_lap(spark.createDataFrame(rows, ENVELOPE)).count() == 1


def test_fold_of_the_log_equals_the_plan(spark):
    data = lake(spark, SF)
    log = eventlog.lifecycle_events(data)
    folded = lifecycle.fold_orders(log, data.routes)
    plan = data.live_orders().select(*folded.columns)
    assert folded.exceptAll(plan).count() == 0 and plan.exceptAll(folded).count() == 0
    delivered = plan.filter("status = 'delivered'").count()
    assert lifecycle.delivered_rollup(log).agg(F.sum("orders")).first()[0] == delivered


def test_streamed_state_in_many_batches_equals_the_batch_fold(spark, tmp_path):
    data = lake(spark, SF)
    log = eventlog.lifecycle_events(data)
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    source = readers.file_stream(spark, str(tmp_path / "log"), log.schema, max_files=1)
    state = str(tmp_path / "state")
    query = jobs.start(source, "orders", order_state.delta_writer(state), str(tmp_path), every=None)
    jobs.drain([query])
    assert len(os.listdir(f"{state}/orders")) >= 5
    streamed = order_state.order_view(spark, state, data.routes)
    folded = lifecycle.fold_orders(log, data.routes)
    assert streamed.exceptAll(folded).count() == 0 and folded.exceptAll(streamed).count() == 0
    # compaction drops expired orders and nothing else
    base = str(tmp_path / "base")
    order_state.compact(spark, state, base, data.routes, "2024-01-16T18:00:00Z")
    kept = lifecycle.expire_orders(folded, "2024-01-16T18:00:00Z")
    compacted = order_state.order_view(spark, base, data.routes)
    assert compacted.exceptAll(kept).count() == 0 and kept.exceptAll(compacted).count() == 0


def test_a_batch_is_not_kept_while_its_deltas_are_written(spark, tmp_path, monkeypatch):
    """Rows of a batch held in the executors, parsed, took all their memory on large logs."""
    log = event(spark, [("ORDER_CREATED", 0, "o", "R", CREATED), ("ORDER_ASSIGNED", 2, "o", "R", TRIP), ("VEHICLE_DISPATCHED", 3, None, "R", TRIP),
                        ("WEATHER_EVENT", 3, None, None, {}), ("DELIVERY_DELAY", 4, None, "R", {**TRIP, "delay_min": 30, "cause": "heavy"})])
    kept = []
    monkeypatch.setattr(type(log), "persist", lambda df, *_: kept.append(df) or df)
    monkeypatch.setattr(type(log), "cache", lambda df: kept.append(df) or df)
    order_state.delta_writer(str(tmp_path))(log, 0)
    monkeypatch.undo()
    assert not kept
    for name, want in (("orders", lifecycle.latest_order_events(lifecycle.with_payload(log))), ("trips", lifecycle.latest_trip_events(lifecycle.with_payload(log)))):
        got = spark.read.parquet(f"{tmp_path}/{name}/batch_id=0").select(*want.columns)
        assert [str(r) for r in got.collect()] == [str(r) for r in want.collect()] and got.count() == 1


def test_orders_without_a_trip_are_no_hot_key(spark):
    """Of 500 orders 400 have no trip: they are spread, and match neither a trip nor each other."""
    at = F.lit(T0)
    trip = F.when(F.col("id") < 100, F.concat(F.lit("t"), F.col("id") % 50)).when(F.col("id") == 100, "-o1")
    orders = spark.range(500).select(F.concat(F.lit("o"), "id").alias("order_id"), F.when(F.col("id") <= 110, F.struct(at.alias("at"), trip.alias("trip_id"))).alias("assigned"))
    trips = spark.range(60).select(F.when(F.col("id") < 59, F.concat(F.lit("t"), "id")).alias("trip_id"), F.lit("R").alias("route_id"), F.lit(None).alias("moved"),
                                   *[F.struct(at.alias("at")).alias(fact) for fact in ("dispatched", "delayed", "arrived")])
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = lifecycle.join_trip_members(orders, trips)
        parts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 500 and max(parts) < 300
        assert {r.order_id for r in joined.filter("dispatched IS NOT NULL").collect()} == {f"o{k}" for k in range(100)}
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_history_breakdowns_add_up(spark):
    data = lake(spark, SF)
    fact = data.history("route", "category").cache()
    totals = history.hist_totals(fact).first()
    monthly = history.mv_monthly(fact).cache()
    for part in (history.hist_monthly(fact), history.hist_yearly(fact), history.hist_seasons(fact), history.hist_severity(fact), history.hist_monthly(monthly)):
        sums = part.agg(F.sum("orders"), F.sum("affected")).first()
        assert tuple(sums) == (totals.orders, totals.affected)
    same = ("orders", "exposed", "affected", "avg_delay_min", "first_day", "last_day")
    rolled = history.hist_totals(monthly).first()
    assert [rolled[c] for c in same] == [totals[c] for c in same]
    wet = fact.filter("severity = 'none'").agg(F.sum("exposed"), F.sum("cost_transport")).first()
    assert tuple(wet) == (0, 0.0)


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([("a", "x", "new"), ("b", "y", "new")], "id string, owner string, status string")
    new = spark.createDataFrame([("a", "other", "done", 2), ("a", "other", "half", 1), ("c", "z", "new", 1)], "id string, owner string, status string, v int")
    once = merge.upsert(old, new, ["id"], ["status"], "v")
    twice = merge.upsert(once, new, ["id"], ["status"], "v")
    want = [("a", "x", "done"), ("b", "y", "new"), ("c", "z", "new")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    delta = spark.createDataFrame([("k", 1, "rain"), ("k", 2, "none"), ("m", 5, "heavy")], "key string, n int, severity string")
    added = merge.merge_additive(delta.filter("key = 'k'"), delta, ["key"], ["n"], "severity")
    assert sorted(map(tuple, added.collect())) == [("k", 6, "rain"), ("m", 5, "heavy")]


def test_rollup_over_batches(spark, tmp_path):
    """Order and delivery in different batches, in either order; a batch given
    twice; and NaN in a payload, which counts as absent."""
    done = {"trip_id": "t", "route_code": "r", "tier": "express", "category_id": "k", "value_inr": 1.0, "weather_class": "rain", "delay_min": 30.0, "weather_delay_min": 12.5, "sla_breached": True}
    rows = [("ORDER_CREATED", 0, "a", "R1", CREATED), ("ORDER_CREATED", 1, "b", "R1", CREATED), ("DELIVERY_COMPLETED", 30, "a", "R1", done),
            ("DELIVERY_COMPLETED", 31, "b", "R1", {**done, "weather_delay_min": float("nan")}), ("DELIVERY_COMPLETED", 50, "c", "R1", done), ("ORDER_CREATED", 2, "c", "R1", CREATED)]
    log = event(spark, rows)
    writer = rollup.rollup_writer(str(tmp_path / "rollup"))
    parts = [log.filter(F.col("event_id").isin(*ids)) for ids in (("e0", "e1"), ("e2", "e4"), ("e3",), ("e5",))]
    for k in (0, 1, 1, 2, 3, 3):
        writer(parts[k], k)
    columns = ["date", "route_id", "category_id", "orders", "sla_breaches", "delay_min_sum", "cost_transport"]
    want = sorted(map(str, lifecycle.delivered_rollup(log).select(columns).collect()))
    got = sorted(map(str, rollup.read_rollup(spark, str(tmp_path / "rollup")).select(columns).collect()))
    assert got == want and len(want) == 2 and "None" not in "".join(want) and "nan" not in "".join(want)


def test_stream_reads_a_file_and_a_folder(spark, tmp_path):
    table = spark.range(100).withColumn("v", F.col("id") % 7)
    table.repartition(5).write.parquet(str(tmp_path / "many.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next(p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    (tmp_path / "single.parquet").write_bytes(part.read_bytes())
    for name in ("many.parquet", "single.parquet"):
        out = str(tmp_path / f"out-{name}")
        stream = readers.table_stream(spark, str(tmp_path / name), table.schema, 2)
        jobs.drain([jobs.start(stream, None, sinks.batch_folder(out), str(tmp_path / f"cp-{name}"), every=None)])
        assert spark.read.parquet(out).count() == 100
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        readers.table_stream(spark, str(tmp_path / "absent.parquet"), table.schema)


def test_impact_levels_conserve_orders(spark):
    from raincourier.plans import live_queries as live
    data = lake(spark, SF)
    routes = live.route_impact_of(data)
    levels = impact.impact_rollup(routes, data.cities, data.warehouses, data.hubs)
    total = routes.agg(F.sum("orders")).first()[0]
    assert {r["sum(orders)"] for r in levels.groupBy("level").agg(F.sum("orders")).collect()} == {total} and total > 0


PROGRESS = {"name": "clean", "batchId": 42, "timestamp": "t", "numInputRows": 160, "inputRowsPerSecond": 16.0, "processedRowsPerSecond": 80.5,
            "durationMs": {"triggerExecution": 1987}, "eventTime": {"watermark": "2026-10-01T09:59:50.000Z"},
            "stateOperators": [{"numRowsDroppedByWatermark": 3, "customMetrics": {"numDroppedDuplicateRows": 5}}, {"numRowsDroppedByWatermark": 1, "customMetrics": {}}],
            "sources": [{"metrics": {"avgOffsetsBehindLatest": "12.0"}}]}


def test_progress_digest(spark):
    texts = [json.dumps(PROGRESS), json.dumps({"name": "raw", "batchId": 1, "numInputRows": 0})]
    full, bare = progress.progress_digest(spark.createDataFrame([(t,) for t in texts], "progress string")).orderBy("name").collect()
    assert (full.batch, full.rows, full.input_rps, full.processed_rps, full.batch_ms) == (42, 160, 16.0, 80.5, 1987)
    assert (full.dropped_late, full.dropped_duplicates, full.offsets_behind, full.watermark) == (4, 5, 12.0, "2026-10-01T09:59:50.000Z")
    assert (bare.dropped_late, bare.dropped_duplicates, bare.offsets_behind, bare.input_rps, bare.batch_ms) == (0, 0, 0, 0, 0)


def test_listener_never_raises():
    seen = []
    listener = progress.ProgressListener(lambda name, text: seen.append(name))
    report = SimpleNamespace(progress=SimpleNamespace(name="clean", json=json.dumps(PROGRESS)))
    listener.onQueryProgress(report)
    listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(name="bad", json="{")))
    listener.onQueryTerminated(SimpleNamespace(id=1, exception="boom"))
    assert seen == ["clean", "terminated"] and listener.dropped_late == 4 and listener.dropped_duplicates == 5


def test_rain_files(spark, tmp_path):
    import gzip
    for name, text in (("daily", "city_id,date,rain_mm\nMUM,2024-07-01,90.5\nMUM,2024-07-02,\n"), ("hourly", "city_id,hour,mm\nMUM,2024-07-01T05,7.6\n")):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    daily = readers.classified_daily(spark, str(tmp_path / "daily.csv.gz")).orderBy("date").collect()
    assert [(r.rain_mm, r.severity) for r in daily] == [(90.5, "heavy"), (None, "none")]
    hourly = readers.read_hourly(spark, str(tmp_path / "hourly.csv.gz"))
    ask = spark.createDataFrame([("MUM", datetime(2024, 7, 1, 5)), ("MUM", datetime(2024, 7, 1, 6))], "city_id string, hour timestamp")
    assert [r.mm for r in readers.mmph(ask, hourly).orderBy("hour").collect()] == [7.6, 0.0]


def test_geojson_features(spark):
    from raincourier.operators.network import route_geojson
    data = lake(spark, SF)
    features = {r.id: json.loads(r.feature) for r in route_geojson(data.cities, data.warehouses, data.hubs, data.routes).collect()}
    route = data.routes.orderBy(F.desc(F.size("path"))).first()
    line = features[route.route_id]
    assert line["geometry"]["type"] == "LineString" and len(line["geometry"]["coordinates"]) == len(route.path)
    assert line["properties"]["distance_km"] == route.distance_km and features["C3"]["geometry"]["type"] == "Point"


def test_views_keep_a_bounded_number_of_ticks(spark, tmp_path):
    folder = str(tmp_path / "views")
    for tick in range(7):
        sinks.publish_views({"v": spark.range(tick + 1)}, folder, tick)
        assert sinks.newest_view(spark, folder, "v").count() == tick + 1
    sinks.publish_views({"v": spark.range(2)}, folder, 6)
    assert sinks.newest_view(spark, folder, "v").count() == 2
    assert spark.read.parquet(f"{folder}/v").select("tick").distinct().count() == 3
