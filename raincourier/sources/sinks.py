"""Writers. Streaming writers take (batch DataFrame, batch id) and are
idempotent: a replayed batch overwrites its own output."""
from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourier.operators import history

Writer = Callable[[DataFrame, int], None]


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def batch_folder(path: str) -> Writer:
    """Parquet table partitioned by batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def json_folder(path: str) -> Writer:
    """JSON values, as a topic would carry them, partitioned by batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        as_json(batch).write.mode("overwrite").text(f"{path}/batch_id={batch_id}")
    return write


def kafka_topic(servers: str, topic: str) -> Writer:
    """JSON values to a topic (at least once). Needs the Kafka connector package."""
    def write(batch: DataFrame, batch_id: int) -> None:
        as_json(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    return write


def jdbc_table(url: str, table: str, properties: dict | None = None, save=None) -> Writer:
    """Append to a relational table. `save(df, url, table, properties)` can be
    injected; by default Spark's JDBC writer is used. The batch id is written
    along, so that readers can drop the rows of a repeated batch."""
    def by_jdbc(df, url, table, properties):
        df.write.jdbc(url, table, mode="append", properties=properties)

    def write(batch: DataFrame, batch_id: int) -> None:
        (save or by_jdbc)(batch.withColumn("batch_id", F.lit(batch_id)), url, table, properties or {})
    return write


def sink_multi(*writers: Writer) -> Writer:
    """One micro-batch to several sinks: computed once, skipped when empty."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                for writer in writers:
                    writer(batch, batch_id)
        finally:
            batch.unpersist()
    return write


# ---- tables ----------------------------------------------------------------
def bulk_load(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at `path` (any file system Spark knows)."""
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as error:  # AnalysisException: path or files missing
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace only the partitions that occur in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def materialize_monthly(fact: DataFrame, path: str, months: list | None = None) -> None:
    """Write the monthly roll-up, or refresh only the given months of it."""
    if months is not None:
        # Ranges of the bare column, so that other months are not read.
        fact = fact.filter(reduce(or_, [(F.col("date") >= F.trunc(m, "month")) & (F.col("date") < F.add_months(F.trunc(m, "month"), 1)) for m in months], F.lit(False)))
    # One file per month: rows of a month meet in one writer, already aggregated.
    overwrite_partitions(history.mv_monthly(fact).repartition("month"), path, "month")


def save_scenario(run_id: str, sim_time, window_h: int, levers: dict, current: DataFrame, simulated: DataFrame, folder: str) -> None:
    """Append one run and its two result rows."""
    import json
    run = current.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(sim_time).cast("string").alias("sim_time"), F.lit(window_h).alias("window_h"),
        F.lit(json.dumps(levers, sort_keys=True)).alias("levers"))
    run.write.mode("append").parquet(f"{folder}/simulation_runs")
    results = [df.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("variant"), F.to_json(F.struct("*")).alias("metrics"))
               for name, df in (("current", current), ("simulated", simulated))]
    results[0].unionByName(results[1]).write.mode("append").parquet(f"{folder}/scenario_results")


def publish_views(views: dict, folder: str, tick: int, keep: int = 3) -> None:
    """Publish a tick's views, one table each. A view has `keep` slots that are
    overwritten in turn, so old ticks do not pile up; the newest is never the one
    overwritten, unless the same tick is repeated."""
    for name, df in views.items():
        path, slot = f"{folder}/{name}", 0
        if exists(df.sparkSession, path):
            last = df.sparkSession.read.parquet(path).agg(F.max(F.struct("tick", "slot")).alias("last")).select("last.*").first()
            if last.tick is not None:
                slot = last.slot if last.tick == tick else (last.slot + 1) % keep
        df.withColumn("tick", F.lit(tick)).write.mode("overwrite").parquet(f"{path}/slot={slot}")


def newest_view(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    """The rows of a view as its latest tick published them (before: the latest
    of the ticks below that one, which is what a repeated tick starts from)."""
    ticks = spark.read.parquet(f"{folder}/{name}")
    if before is not None:
        ticks = ticks.filter(F.col("tick") < before)
    newest = ticks.agg(F.max(F.struct("tick", "slot")).alias("n")).select("n.*").first()
    # The slot is a folder: others may be overwritten while these rows are read.
    return ticks.filter((F.col("slot") == F.lit(newest.slot)) & (F.col("tick") == F.lit(newest.tick))).drop("tick", "slot")


def checkpoint_path(root: str, name: str) -> str:
    return os.path.join(root, "checkpoints", name)
