"""Rows kept by bucket between micro-batches.

A table has rows/slot=<0 or 1>/bucket=<b>, one file each, and a manifest that says
which slot of each bucket holds. A batch reads the buckets it touches, writes
their new rows into the other slot and then publishes its manifest. So files stay
bounded, untouched buckets are neither read nor written, and a repeated batch
starts from the manifest before it and overwrites its own output."""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourier.sources import sinks

_MANIFEST = "batch bigint, mark double, bucket int, place int, rows bigint"
_SLOTS = 3  # manifests kept: the newest, the one a repeated batch starts from, and one being written


@dataclass
class Manifest:
    """What a batch left: the slot and the rows of each bucket that has any, and its mark."""
    batch: int = -1
    mark: float | None = None
    slots: dict[int, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)


class KeyedTable:
    """A table of `schema` (without bucket) below `folder`. Buckets are numbers from
    0 on; the driver holds one number pair per bucket, never a row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder = spark, folder
        self.schema = T.StructType.fromDDL(schema)

    def _read(self, name: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def manifest(self, before: int | None = None) -> Manifest:
        """As of the newest batch, or of the newest one below `before`."""
        table, out = self._read("manifest", _MANIFEST), Manifest()
        rows = [] if table is None else [r for r in table.collect() if before is None or r.batch < before]
        for r in rows:
            if r.batch > out.batch:
                out = Manifest(r.batch, r.mark)
            if r.batch == out.batch and r.bucket is not None:
                out.slots[r.bucket], out.rows[r.bucket] = r.place, r.rows
        return out

    def _files(self, slots: dict[int, int]) -> DataFrame:
        """Rows of buckets in the slots given; no other folder's files are opened."""
        by_slot: dict[int, list[int]] = {}
        for bucket, slot in slots.items():
            by_slot.setdefault(slot, []).append(bucket)
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        table = self._read("rows", schema) if by_slot else None
        if table is None:
            return self.spark.createDataFrame([], schema)
        return table.filter(reduce(or_, [(F.col("slot") == slot) & F.col("bucket").isin(buckets) for slot, buckets in by_slot.items()]))

    def rows(self, buckets: Iterable[int] | None = None, at: Manifest | None = None) -> DataFrame:
        """Rows of the given buckets (all by default) as of a manifest (the newest), with their bucket."""
        slots = (at or self.manifest()).slots
        return self._files(slots if buckets is None else {b: slots[b] for b in buckets if b in slots}).drop("batch", "slot")

    def replace(self, batch_id: int, rows: DataFrame, touched: Iterable[int], at: Manifest, mark: float | None = None) -> Manifest:
        """Make `rows` (with bucket) the content of the touched buckets. `at` is the
        manifest before this batch, `mark` a number to keep."""
        target = {b: 1 - at.slots.get(b, 1) for b in set(touched)}
        new = Manifest(batch_id, at.mark if mark is None else mark, *({b: v for b, v in old.items() if b not in target} for old in (at.slots, at.rows)))
        if target:
            columns = [*self.schema.names, F.lit(batch_id).cast("long").alias("batch"), _slot_of(target).alias("slot"), F.col("bucket").cast("int").alias("bucket")]
            # One file per bucket. A bucket left without rows keeps a stale file, which the batch number gives away.
            sinks.overwrite_partitions(rows.select(*columns).repartition("bucket"), f"{self.folder}/rows", "slot", "bucket")
            for r in self._files(target).filter(F.col("batch") == batch_id).groupBy("bucket").count().collect():
                new.slots[r["bucket"]], new.rows[r["bucket"]] = target[r["bucket"]], r["count"]
        # The row without a bucket stands even when the table is empty.
        lines = [(batch_id, new.mark, None, None, 0), *[(batch_id, new.mark, b, slot, new.rows[b]) for b, slot in new.slots.items()]]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/slot={batch_id % _SLOTS}")
        return new


def _slot_of(target: dict[int, int]) -> Column:
    ones = [b for b, slot in target.items() if slot == 1]
    return F.when(F.col("bucket").isin(ones), 1).otherwise(0) if ones else F.lit(0)


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class BucketState:
    """State of all keys of a bucket as one value of the state store, for a stateful
    processor grouped by bucket: one read, one write and one timer a bucket and
    batch, where a call per key would cost more than the work on it."""

    def __init__(self, handle):
        self.handle = handle
        self.value = handle.getValueState("bucket", "keys binary, timer bigint")
        self.timer = None

    def load(self, rung: int | None = None) -> dict:
        """What is kept by key. `rung` is the time of a timer that has just expired."""
        kept = self.value.get()
        self.timer = None if kept is None or kept[1] == rung else kept[1]
        return {} if kept is None else pickle.loads(bytes(kept[0]))

    def save(self, keys: dict, expiry: Callable[[object], int]) -> None:
        """Keep these, with a timer no later than the first expiry (in milliseconds);
        one that rings too early is set again."""
        if not keys:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.value.clear()
            return
        first = max(min(map(expiry, keys.values())), 1)
        if self.timer is None or first < self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(first)
            self.timer = first
        self.value.update((pickle.dumps(keys, pickle.HIGHEST_PROTOCOL), self.timer))
