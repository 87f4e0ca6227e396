"""Structured Streaming queries: the events table (or the event log derived
from the orders) read as a stream, run to the end of the available data and
read back from its sink."""
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourier.operators import ingest, lifecycle
from raincourier.plans.catalog import query
from raincourier.plans.ingest_queries import NOW as CLOCK
from raincourier.plans.state_queries import DELIVERIES, ORDERS, REPORTS, TRIPS
from raincourier.sources import eventlog, readers, sinks, staged, topic
from raincourier.sources.schemas import ENVELOPE
from raincourier.sources.scratch import scratch, written
from raincourier.sources.tables import event_messages
from raincourier.streaming import jobs, live_state, order_state, progress, rollup


MAX_FILES = 8  # part files a trigger takes in


def source(lake) -> DataFrame:
    events = lake.table("events")
    return event_messages(readers.table_stream(lake.spark, f"{lake.folder}/events.parquet", events.schema, MAX_FILES), lake.n_cities)


def _reported(lake, start) -> tuple[DataFrame, str]:
    """Every progress report of the stream that `start()` begins, as the listener
    received them, written to a table once the stream has ended."""
    reports: list = []
    listener = progress.ProgressListener(lambda name, text: reports.append((name, text)))
    lake.spark.streams.addListener(listener)
    try:
        stream = start()
        jobs.drain([stream])
        deadline = time.monotonic() + 60  # reports arrive on the listener thread
        while str(stream.id) not in listener.terminated and time.monotonic() < deadline:
            time.sleep(0.1)
        name = stream.name
    finally:
        lake.spark.streams.removeListener(listener)
    return written(lake.spark.createDataFrame([(text,) for of, text in reports if of == name], "progress string"), f"{name}-progress")


def _run(lake, df, name, mode="append", writer=None) -> DataFrame:
    """Drain a stream into a folder partitioned by batch and read it back."""
    path = scratch(lake.spark, name)
    query = jobs.start(df, None, (writer or sinks.batch_folder)(path), scratch(lake.spark, f"{name}-checkpoint"), every=None, mode=mode)
    jobs.drain([query])
    return lake.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(path)


def clean_stream(lake):
    return ingest.clean_dedup(jobs.checked(source(lake), CLOCK))


@query()
def src_event_stream(lake):
    """The unbounded source, counted by arrival day: an offset log of which no
    micro-batch takes more rows than the cap."""
    spark, root = lake.spark, scratch(lake.spark, "topic")
    topic.publish(event_messages(lake.table("events"), lake.n_cities), f"{root}/topic")
    stream = topic.topic_stream(spark, f"{root}/topic").select(F.to_date("timestamp").alias("day"))
    query_ = jobs.start(stream, None, sinks.batch_folder(f"{root}/days"), root, every="0 seconds")
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return spark.read.schema(stream.schema).parquet(f"{root}/days").groupBy("day").agg(F.count("*").alias("messages"))


@query()
def sink_two_phase(lake):
    """Clean events staged as parquet and as JSON and committed per batch. The
    stream runs again without its checkpoint: repeated batches change nothing."""
    root, events = scratch(lake.spark, "two-phase"), clean_stream(lake).select("event_id", "type")
    for run in ("first", "again"):
        writer = staged.staged_writer(events, f"{root}/table", "parquet,json").option("checkpointLocation", f"{root}/{run}")
        jobs.drain([writer.trigger(availableNow=True).start()])
    kinds = {kind: staged.read_committed(lake.spark, f"{root}/table", events.schema, kind).groupBy("type").agg(F.count("*").alias(f"{name}_rows"))
             for kind, name in (("json", "json"), ("parquet", "table"))}
    return kinds["json"].join(kinds["parquet"], "type")


@query()
def stream_dedup(lake):
    return _run(lake, clean_stream(lake), "dedup").select("event_id", "type", "emitted_at", "order_id", "city_id")


@query()
def stream_tumbling(lake):
    """Closed 30 s windows per city, chained after the deduplication."""
    out = _run(lake, ingest.agg_city_window(clean_stream(lake)), "tumbling")
    return out.drop("batch_id").withColumn("avg_delay_min", F.round("avg_delay_min", 4))


@query()
def stream_watermark(lake):
    """How far the watermark closed windows: the last window emitted."""
    out = _run(lake, ingest.agg_city_window(clean_stream(lake)), "watermark")
    return out.agg(F.max("window_end").alias("last_closed"), F.count("*").alias("windows"), F.sum("events").alias("events"))


@query()
def stream_branches(lake):
    """All four branches from one source; rows each of them delivered."""
    root = scratch(lake.spark, "branches")
    names = ("quarantine", "clean", "metrics")
    writers = {name: sinks.sink_multi(sinks.json_folder(f"{root}/{name}-topic"), sinks.batch_folder(f"{root}/{name}")) for name in names}
    writers["raw"] = f"{root}/raw"
    jobs.drain(jobs.start_branches(lambda: source(lake), writers, root, every=None, raw_every=None, now=CLOCK, prefix="branches-"))
    tables = [lake.spark.read.parquet(f"{root}/{name}").groupBy(F.lit(name).alias("branch")).agg(F.count("*").alias("rows")) for name in (*names, "raw")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


def _log_stream(lake, *kinds):
    """The event log, or the given kinds of its events, as a stream over the files it was written to."""
    lake.log_folders(*kinds)
    return readers.file_stream(lake.spark, f"{lake.log_root}/{{{','.join(kinds or eventlog.KINDS)}}}", ENVELOPE)


def _in_time_ranges(lake, parts: int, kinds, run) -> None:
    """The log as a folder that grows by one time range after the other. `run(source)`
    is called after each and drains its streams, which go on from their checkpoints:
    a range is a batch of its own, in however many files its tasks write."""
    path, log = scratch(lake.spark, "log"), lake.log(*kinds)
    at = F.unix_micros("sim_time")
    cuts = log.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"  # only the last range is followed by a batch without data
    before = lake.spark.conf.get(idle)
    try:
        for low, high in zip([None, *cuts], [*cuts, None]):
            after, until = F.lit(True) if low is None else at > low, F.lit(True) if high is None else at <= high
            log.filter(after & until).write.mode("append").parquet(path)
            lake.spark.conf.set(idle, "false" if high is not None else before)
            run(lambda: readers.file_stream(lake.spark, path, ENVELOPE))
    finally:
        lake.spark.conf.set(idle, before)


@query()
def stream_order_state(lake):
    """The order table from the streamed state; equals the batch fold."""
    state = scratch(lake.spark, "order-state")
    jobs.drain([jobs.start(_log_stream(lake, *ORDERS, *REPORTS), None, order_state.delta_writer(state), scratch(lake.spark, "order-state-checkpoint"), every=None)])
    return order_state.order_view(lake.spark, state, lake.routes)


@query()
def stream_state_ttl(lake):
    """Trips left in the state store after timers forgot the old ones."""
    changes = _rocksdb(lake, TRIPS, lambda: _run(lake, order_state.trip_stream(_log_stream(lake, *TRIPS)), "trips", "update"))
    return order_state.current_trips(changes)


@query()
def stream_late_data(lake):
    """Every event delivered a second time, under a new id, after the stream has
    moved on: what the watermark drops as late is counted."""
    spark, folder, checkpoint = lake.spark, scratch(lake.spark, "late"), scratch(lake.spark, "late-checkpoint")
    events = lake.table("events")
    for again in (False, True):
        messages = event_messages(events, lake.n_cities)
        if again:
            text = F.replace(F.col("value").cast("string"), F.lit('"event_id":"E'), F.lit('"event_id":"L'))
            messages = messages.withColumn("value", text.cast("binary"))
        messages.write.mode("append").parquet(folder)
        source_ = readers.file_stream(spark, folder, messages.schema)
        reports = _reported(lake, lambda: jobs.start(ingest.clean_dedup(jobs.checked(source_, CLOCK)), "late", sinks.batch_folder(scratch(spark, "late-out")), checkpoint, every=None))
    return progress.progress_digest(reports).agg(F.sum("dropped_late").alias("dropped_late"), F.sum("rows").alias("rows"))


STATE_ROWS = 500_000  # events of the log per partition of a stream's state
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": order_state.ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",  # a join has one store a partition, not four
    # All stores of an executor share this memory; by themselves they take some 5 MB each, outside the heap.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def _rocksdb(lake, kinds, run):
    """Run with the RocksDB state store provider, which keyed processors need, and
    with partitions by the size of the log's `kinds`: each is a store that every batch
    opens and commits and that takes memory while the stream lives."""
    parts = max(lake.spark.sparkContext.defaultParallelism, -(-lake.log(*kinds).count() // STATE_ROWS))
    settings = STATE_STORE | {"spark.sql.shuffle.partitions": str(parts)}
    before = {name: lake.spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            lake.spark.conf.set(name, value)
        return run()
    finally:
        for name, value in before.items():
            lake.spark.conf.unset(name) if value is None else lake.spark.conf.set(name, value)


def run_ticks(lake, parts: int, root: str) -> None:
    """The live engine over the log in `parts` time ranges, views below `root`."""
    from raincourier.operators import impact, scoring, trips
    from raincourier.sources.tables import COEFS

    def risk(cohorts):
        return scoring.risk_of_cohorts(trips.within_horizon(cohorts, lake.now), lake.routes, lake.hourly_rain(lake.now), lake.route_history, COEFS, lake.now).drop("contributions")

    tick = live_state.IncrementalTick(f"{root}/views", risk, lambda cohorts, risk_table: {"future": impact.future_summary(risk_table, lake.now)}, risk_every=1)

    def step(source_):
        jobs.drain([jobs.start(live_state.cohort_deltas(source_), "ticks", tick, f"{root}/checkpoint", every=None)])

    _rocksdb(lake, (*ORDERS, *REPORTS), lambda: _in_time_ranges(lake, parts, (*ORDERS, *REPORTS), step))


@query()
def stream_tick(lake):
    """Ticks of the live engine over the log streamed in several batches: the
    outlook that the last one publishes."""
    root = scratch(lake.spark, "tick")
    run_ticks(lake, 3, root)
    return sinks.newest_view(lake.spark, f"{root}/views", "future")


@query()
def stream_interval_join(lake):
    """The order table from orders' own events and the trip reports that a
    stream-stream join brought to their members."""
    root = scratch(lake.spark, "interval-join")

    def step(source_):
        own, reports = source_().filter(F.col("type").isin(*ORDERS)), live_state.member_reports(source_)
        jobs.drain([jobs.start(own, None, order_state.delta_writer(f"{root}/state"), f"{root}/orders-checkpoint", every=None),
                    jobs.start(reports, "member-reports", sinks.batch_folder(f"{root}/reports"), f"{root}/reports-checkpoint", every=None)])

    _rocksdb(lake, (*ORDERS, *REPORTS), lambda: _in_time_ranges(lake, 3, (*ORDERS, *REPORTS), step))
    orders, reports = order_state.read_facts(lake.spark, f"{root}/state")[0], lake.spark.read.schema(live_state.REPORT_ROWS).parquet(f"{root}/reports")
    return live_state.order_view(orders, reports, lake.routes)


@query()
def stream_rollup(lake):
    """Delivered roll-up over several batches: an order and its delivery mostly
    arrive in different ones."""
    path, checkpoint = scratch(lake.spark, "rollup"), scratch(lake.spark, "rollup-checkpoint")
    _in_time_ranges(lake, 5, DELIVERIES, lambda source_: jobs.drain([jobs.start(source_(), None, rollup.rollup_writer(path), checkpoint, every=None)]))
    return rollup.read_rollup(lake.spark, path)


@query()
def stream_recovery(lake):
    """History rebuilt after a restart: days of the replay are dropped and
    recomputed from the retained log."""
    log = lake.log(*DELIVERIES)
    recovered = jobs.recover(lifecycle.delivered_rollup(log), log, "2024-01-14", lambda events: lifecycle.delivered_rollup(events).filter("date >= '2024-01-14'"))
    return recovered.select("date", "route_id", "category_id", "severity", "orders", "sla_breaches")


@query()
def progress_digest(lake):
    """Health fields of a finished stream, taken from its progress reports."""
    path = scratch(lake.spark, "digest")
    reports = _reported(lake, lambda: jobs.start(clean_stream(lake), "digest", sinks.batch_folder(path), scratch(lake.spark, "digest-checkpoint"), every=None))
    return progress.progress_digest(reports).groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("dropped_duplicates").alias("dropped_duplicates"),
                                                                 F.sum("dropped_late").alias("dropped_late"))


@query()
def stream_dup_counter(lake):
    """Duplicates the state store dropped, by its own counter."""
    reports = _reported(lake, lambda: jobs.start(clean_stream(lake), "duplicates", sinks.batch_folder(scratch(lake.spark, "dup")), scratch(lake.spark, "dup-checkpoint"), every=None))
    return progress.progress_digest(reports).agg(F.sum("dropped_duplicates").alias("dropped_duplicates"))


@query()
def stream_triggers(lake):
    """A branch on a processing-time trigger, stopped once it has caught up."""
    path = scratch(lake.spark, "triggers")
    rejected = ingest.quarantine(jobs.checked(source(lake), CLOCK))
    stream = jobs.start(rejected, "triggers", sinks.batch_folder(path), scratch(lake.spark, "triggers-checkpoint"), every="1 second")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return lake.spark.read.parquet(path).groupBy("reason").agg(F.count("*").alias("rows"))


@query()
def stream_progress_listener(lake):
    """What the listener published about one query, digested."""
    mine = _reported(lake, lambda: jobs.start(clean_stream(lake), "listened", sinks.batch_folder(scratch(lake.spark, "listened")), scratch(lake.spark, "listened-checkpoint"), every=None))
    return progress.progress_digest(mine).groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("dropped_duplicates").alias("dropped_duplicates"))
