"""State kept between micro-batches: bucketed tables, the roll-up, the interval join, ticks."""
import glob
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raincourier.operators import lifecycle, trips
from raincourier.plans import stream_queries
from raincourier.sources import readers, sinks
from raincourier.sources.tables import lake
from raincourier.streaming import jobs, keyed, live_state, rollup

SF = "/root/testdata/sf0.001"
T0 = datetime(2025, 7, 1)


def test_keyed_table_touches_its_buckets_only(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v bigint")
    rows = lambda *pairs: spark.createDataFrame([(k, v, k % 4) for k, v in pairs], "k bigint, v bigint, bucket int")
    content = lambda **at: sorted((r.k, r.v) for r in table.rows(**at).collect())
    assert content() == [] and table.manifest().slots == {}
    table.replace(0, rows((1, 1), (2, 1), (3, 1)), [1, 2, 3], table.manifest(before=0), mark=5.0)
    stale = set(glob.glob(f"{tmp_path}/t/rows/*/bucket=3/*.parquet"))
    table.replace(1, rows((1, 2), (5, 2)), [1], table.manifest(before=1))
    for _ in range(2):  # a batch given twice starts from the manifest before it
        at = table.manifest(before=2)
        assert sorted((r.k, r.v) for r in table.rows([1, 2], at).collect()) == [(1, 2), (2, 1), (5, 2)]
        table.replace(2, table.rows([1, 2], at).withColumn("v", F.col("v") + 1).filter("k <> 2"), [1, 2], at, mark=7.0)
    assert content() == [(1, 3), (3, 1), (5, 3)] and table.manifest().slots.keys() == {1, 3} and table.manifest().mark == 7.0
    assert set(glob.glob(f"{tmp_path}/t/rows/*/bucket=3/*.parquet")) == stale  # never touched again
    table.replace(3, rows(), [1, 3], table.manifest(before=3))
    assert content() == [] and table.manifest().mark == 7.0
    assert len(glob.glob(f"{tmp_path}/t/rows/*/*/*.parquet")) <= 2 * 4


def test_rollup_forgets_and_stays_bounded(spark, tmp_path):
    """A day of orders a batch: the orders kept and the files do not grow with the days, and the roll-up is that of all."""
    path, days, n = str(tmp_path / "r"), 6, 40
    rows = []
    for day in range(days):
        for k in range(n):
            at, order = T0 + timedelta(days=day, minutes=k), f"o{day}-{k}"
            created = '{"category_id":"k%d","tier":"express","planned_dispatch":"%sZ"}' % (k % 3, at.isoformat())
            done = '{"weather_class":"%s","weather_delay_min":%s,"delay_min":40.0,"sla_breached":%s}' % (("none", "rain", "heavy")[k % 3], k % 7 + 0.1, str(k % 2 == 0).lower())
            rows += [(f"c{order}", "ORDER_CREATED", at, order, "R%d" % (k % 2), created), (f"d{order}", "DELIVERY_COMPLETED", at + timedelta(hours=20), order, "R", done)]
    log = spark.createDataFrame([(i, t, at, at, o, "C", r, p) for i, t, at, o, r, p in rows],
                                "event_id string, type string, sim_time timestamp, emitted_at timestamp, order_id string, city_id string, route_id string, payload string")
    write, kept = rollup.rollup_writer(path, buckets=4), []
    for day in range(days + 1):
        low, high = T0 + timedelta(days=day), T0 + timedelta(days=day + 1)
        write(log.filter((F.col("sim_time") >= low) & (F.col("sim_time") < high)), day)
        kept.append(sum(rollup.orders_table(spark, path).manifest().rows.values()))
    assert max(kept[3:]) <= max(kept[:3]) + n and kept[-1] < days * n
    assert len(glob.glob(f"{path}/orders/rows/*/*/*.parquet")) <= 2 * 4
    got, want = rollup.read_rollup(spark, path), lifecycle.delivered_rollup(log)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_join_state_is_dropped_by_its_range(spark, tmp_path):
    """Trips over ten days, a batch a day: rows in the join's state follow the range, not the log."""
    payload = '{"trip_id":"t%d","vehicle_id":"v","delay_min":5.0,"cause":"rain"}'
    for day in range(10):
        rows = []
        for k in range(20):
            at, trip = T0 + timedelta(days=day, minutes=k), payload % (day * 20 + k)
            rows += [(f"a{day}-{k}", "ORDER_ASSIGNED", at, f"o{day}-{k}", trip), (f"v{day}-{k}", "VEHICLE_DISPATCHED", at + timedelta(hours=2), None, trip),
                     (f"h{day}-{k}", "HUB_ARRIVAL", at + timedelta(hours=40), None, trip), (f"e{day}-{k}", "HUB_ARRIVAL", at - timedelta(minutes=5), None, trip)]
        df = spark.createDataFrame([(i, t, at, at, o, "C", "R", p) for i, t, at, o, p in rows],
                                   "event_id string, type string, sim_time timestamp, emitted_at timestamp, order_id string, city_id string, route_id string, payload string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = lambda: readers.file_stream(spark, str(tmp_path / "log"), df.schema, max_files=1)
    query = jobs.start(live_state.member_reports(source, within_h=30), "join", sinks.batch_folder(str(tmp_path / "out")), str(tmp_path), every=None)
    jobs.drain([query])
    states = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(states) < 10 * 20 * 4 / 2 and states[-1] <= max(states[:5])
    out = spark.read.parquet(str(tmp_path / "out"))
    # the dispatch counts, the report before the assignment and the one past the range do not
    assert {(r.type, r["count"]) for r in out.groupBy("type").count().collect()} == {("VEHICLE_DISPATCHED", 200)}


def test_a_join_keeps_few_stores_in_bounded_memory(spark, tmp_path):
    """A small log in a session of 40 partitions: a store for each that the log needs, not 160. A second range starts from them."""
    schema = "event_id string, type string, sim_time timestamp, emitted_at timestamp, order_id string, city_id string, route_id string, payload string"
    out, checkpoint, seen = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []

    def batch(kind, at, orders):
        rows = [(f"{kind}{k}", kind, at, at, f"o{k}" if kind == "ORDER_ASSIGNED" else None, "C", "R", '{"trip_id":"t%d"}' % k) for k in orders]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    def step():
        batch(*((("ORDER_ASSIGNED", T0, range(30)), ("VEHICLE_DISPATCHED", T0 + timedelta(hours=2), range(20)))[len(seen)]))
        source = lambda: readers.file_stream(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema)
        jobs.drain([jobs.start(live_state.member_reports(source), "join", sinks.batch_folder(out), checkpoint, every=None)])
        seen.append(spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "false"))

    data, before = SimpleNamespace(spark=spark, log=lambda *kinds: spark.range(stream_queries.STATE_ROWS * 9 + 1)), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream_queries._rocksdb(data, (), lambda: (step(), step()))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = {f.rpartition("/")[0] for f in glob.glob(f"{checkpoint}/**/state/0/**/*.zip", recursive=True)}
    assert len(stores) == max(10, spark.sparkContext.defaultParallelism) and seen == ["true", "true"]
    assert sorted(r.order_id for r in spark.read.parquet(out).collect()) == sorted(f"o{k}" for k in range(20))


def test_ticks_equal_a_fold_of_the_whole_log(spark, tmp_path):
    data = lake(spark, SF)
    stream_queries.run_ticks(data, 4, str(tmp_path))
    got = trips.within_horizon(live_state.current_cohorts(spark, f"{tmp_path}/views"), data.now)
    want = trips.cohorts(lifecycle.fold_orders(data.event_log, data.routes), data.now).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_ticks_of_a_small_log_open_few_stores(spark, tmp_path):
    """Each of the session's 40 partitions cost every tick five stores and a Python worker's start; the log asks for one a core."""
    data, before = lake(spark, SF), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream_queries.run_ticks(data, 1, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = {f.rpartition("/")[0] for f in glob.glob(f"{tmp_path}/checkpoint/**/state/*/**/*.zip", recursive=True)}
    assert 0 < len(stores) <= 2 * spark.sparkContext.defaultParallelism  # of the join and of the orders
    got, want = trips.within_horizon(live_state.current_cohorts(spark, f"{tmp_path}/views"), data.now), trips.cohorts(data.upcoming, data.now)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and want.count() == got.count() > 0


def _state(*events):
    s = dict.fromkeys(live_state._FIELDS) | {"reports": []}
    cohorts = []
    for kind, at, *more in events:
        fields = dict(zip(("trip_id", "route_id", "tier", "dispatch"), more))
        e = SimpleNamespace(**{"type": kind, "at": at, "event_id": f"e{at}", "trip_id": None, "route_id": "R", "city_id": "C", "tier": "x", "dispatch": 50} | fields)
        live_state.Upcoming.take(s, e)
        cohorts.append(live_state.Upcoming.cohort(s))
    return cohorts


def test_where_an_order_stands():
    here = ("R", "C", "x", 50)
    assert _state(("ORDER_CREATED", 1), ("ORDER_ASSIGNED", 2, "t"), ("VEHICLE_DISPATCHED", 3, "t")) == [here, here, None]
    assert _state(("VEHICLE_DISPATCHED", 3, "t"), ("ORDER_ASSIGNED", 2, "t"), ("ORDER_CREATED", 1)) == [None, None, None]
    assert _state(("ORDER_CREATED", 1), ("ORDER_ASSIGNED", 2, "t"), ("VEHICLE_DISPATCHED", 3, "t"), ("ORDER_ASSIGNED", 4, "u")) == [here, here, None, here]
    assert _state(("DELIVERY_COMPLETED", 9), ("ORDER_CREATED", 1), ("ORDER_CREATED", 10, None, "Q")) == [None, None, ("Q", "C", "x", 50)]
    assert _state(("ORDER_CREATED", 5), ("ORDER_CREATED", 2, None, "old"), ("DELIVERY_COMPLETED", 4), ("DELIVERY_COMPLETED", 6)) == [here, here, here, None]


def _plain_laps(low, high):
    reached, lap, out = None, 0, []
    for a, b in zip(low, high):
        if reached is not None and a < reached - lifecycle._JUMP_US:
            lap, reached = lap + 1, b
        else:
            reached = b if reached is None else max(reached, b)
        out.append(lap)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_range_summaries_compose(seed):
    r, step = random.Random(seed), lifecycle._JUMP_US // 10
    low = np.array([r.randint(0, 60) * step for _ in range(r.randint(1, 60))])
    high = low + np.array([r.randint(0, 5) * step for _ in low])
    cuts = [0, *sorted(r.randint(0, len(low)) for _ in range(r.randint(0, 5))), len(low)]
    reached, laps, want = lifecycle._BEFORE, 0, _plain_laps(low, high)
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            summary = lifecycle._range_summary(pd.DataFrame({"_range": 0, "at": range(a, b), "low_us": low[a:b], "high_us": high[a:b]})).iloc[0]
            begins = np.zeros(b - a, int)
            begins[lifecycle._starts(low[a:b], high[a:b], reached)] = 1
            assert (laps + begins.cumsum()).tolist() == want[a:b]
            begun, reached = lifecycle._through(summary, reached)
            laps += begun
            assert laps == want[b - 1]


def test_five_hundred_laps_in_as_many_jobs_as_one(spark):
    """Laps of ten events, three hours apart each: jobs are counted, laps compared with a plain loop."""
    events = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 60).alias("emitted_at"), F.timestamp_seconds((F.col("id") % 10) * 10_800).alias("sim_time"), "id")
    tracker, counts = spark.sparkContext.statusTracker(), []
    for log in (events.filter("id < 10"), events):
        spark.sparkContext.setJobGroup(f"laps-{len(counts)}", "laps")
        laps = [r.lap for r in lifecycle.replay_wrap(log).orderBy("emitted_at").collect()]
        counts.append(len(tracker.getJobIdsForGroup(f"laps-{len(counts)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert laps == [k // 10 for k in range(5000)] and counts[1] <= counts[0] + 8


def test_a_bucket_of_orders_is_one_value_of_the_state_store():
    """Hundred orders in two batches: the store is called once a bucket, moves are summed by cohort, timers let orders go."""
    calls = []

    class Store:
        kept = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, kept):
            calls.append("update")
            self.kept = kept

        def clear(self):
            self.kept = None

        def registerTimer(self, at):
            calls.append("timer")

        def deleteTimer(self, at):
            pass

    def batch(kind, at, orders, **fields):
        rows = [{"order_id": f"o{k}", "type": kind, "at": at, "event_id": f"e{at}-{k}", "trip_id": None, "route_id": None, "city_id": None, "tier": None, "dispatch": live_state._NO_TIME} | fields for k in orders]
        return pd.DataFrame(rows)

    upcoming, moves = live_state.Upcoming(), lambda out: [tuple(r) for frame in out for r in frame.itertuples(index=False)]
    upcoming.init(Store())
    leave = 50 * live_state.HOUR_US
    here = {"route_id": "R", "city_id": "C", "tier": "x", "dispatch": leave}
    assert moves(upcoming.handleInputRows(1, iter([batch("ORDER_CREATED", 1, range(60), **here), batch("ORDER_CREATED", 1, range(60, 100), **here)]), None)) == [("R", "C", "x", leave, 100)]
    assert calls == ["get", "update", "timer"] or calls == ["get", "timer", "update"]
    assert moves(upcoming.handleInputRows(1, iter([batch("ORDER_ASSIGNED", 2, range(30), trip_id="t"), batch("VEHICLE_DISPATCHED", 3, range(30), trip_id="t")]), None)) == [("R", "C", "x", leave, -30)]
    assert calls.count("get") == calls.count("update") == 2
    rings = (50 + 6) * 3_600_000
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: rings), SimpleNamespace(getExpiryTimeInMs=lambda: rings)
    assert moves(upcoming.handleExpiredTimer(1, *times)) == [("R", "C", "x", leave, -70)] and upcoming.state.value.kept is None
