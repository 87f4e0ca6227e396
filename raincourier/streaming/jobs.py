"""The long-running queries: four branches of one event source, and recovery by
replay."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raincourier.operators import ingest
from raincourier.sources import sinks

FAST, SLOW = "5 seconds", "60 seconds"


def _trigger(writer, every: str | None):
    """A processing-time trigger, or (every=None) all available data once."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def checked(source: DataFrame, now=None) -> DataFrame:
    return ingest.with_reject_reason(ingest.parse_envelope(source), now)


def start(df: DataFrame, name: str | None, writer: sinks.Writer, checkpoints: str, every: str | None = FAST, mode: str = "append") -> StreamingQuery:
    """A query that hands every micro-batch to a writer, with its own checkpoint."""
    stream = (df.writeStream.outputMode(mode).foreachBatch(writer)
              .option("checkpointLocation", sinks.checkpoint_path(checkpoints, name or "query")))
    return _trigger(stream.queryName(name) if name else stream, every).start()


def start_raw(source: DataFrame, path: str, checkpoints: str, every: str | None = SLOW, name: str = "raw") -> StreamingQuery:
    """Parsed events as parquet, partitioned by arrival date; exactly once."""
    dated = checked(source).drop("raw").withColumn("date", F.to_date("kafka_ts"))
    stream = (dated.writeStream.queryName(name).format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", sinks.checkpoint_path(checkpoints, name)).partitionBy("date"))
    return _trigger(stream, every).start()


def start_branches(source: Callable[[], DataFrame], writers: dict, checkpoints: str, every: str | None = FAST,
                   raw_every: str | None = SLOW, now=None, prefix: str = "") -> list[StreamingQuery]:
    """Raw, quarantine, clean and metrics from one source; each query reads the
    source itself and keeps its own progress. `writers` maps a branch to its
    writer ("raw" to a folder); branches without one are not started."""
    queries = []
    if "raw" in writers:
        queries.append(start_raw(source(), writers["raw"], checkpoints, raw_every, f"{prefix}raw"))
    branches = {
        "quarantine": lambda: ingest.quarantine(checked(source(), now)),
        "clean": lambda: ingest.clean_dedup(checked(source(), now)),
        "metrics": lambda: ingest.agg_city_window(ingest.clean_dedup(checked(source(), now))),
    }
    for name, build in branches.items():
        if name in writers:
            queries.append(start(build(), f"{prefix}{name}", writers[name], checkpoints, every))
    return queries


def drain(queries: list[StreamingQuery], timeout_s: int | None = None) -> None:
    """Wait until availableNow queries have processed their input, however long it
    takes, or at most `timeout_s` seconds."""
    for query in queries:
        if timeout_s is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout_s):
            query.stop()
            raise TimeoutError(f"stream {query.name} did not finish in {timeout_s} s")
        if query.exception() is not None:
            raise query.exception()


def recover(history: DataFrame, log: DataFrame, replay_start: str, rollup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """History after a restart without checkpoint: days of the replay are
    dropped and rebuilt from the retained log."""
    from raincourier.operators.merge import reset_from_date
    kept = reset_from_date(history, replay_start)
    return kept.unionByName(rollup(log))
