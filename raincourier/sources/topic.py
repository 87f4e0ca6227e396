"""An append log with offsets, as a streaming source.

A topic is a folder: partition=<p>/<first>-<end>.parquet, where first and end are
the offsets of a segment's rows. Every micro-batch takes a range of offsets of
each partition, no more rows than the cap in all. Segments may go at any time
(retention): their range is skipped and noted beside the topic instead of
stopping the stream."""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from raincourier.sources.readers import MAX_OFFSETS_PER_TRIGGER

SCHEMA = "value binary, timestamp timestamp, partition int, offset bigint"
_ROWS = pa.schema([("value", pa.binary()), ("timestamp", pa.timestamp("us", tz="UTC"))])


@dataclass(frozen=True)
class Segment:
    partition: int
    first: int
    end: int
    path: str


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path; a path without a scheme is a local one."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


def segments(path: str) -> list[Segment]:
    """Segments a topic still has, by partition and offset. Names carry the ranges, so no file is opened."""
    files, root = _open(path)
    found = []
    for info in files.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        place = folder.rpartition("/")[2]
        if place.startswith("partition=") and name.endswith(".parquet") and not name.startswith((".", "_")):
            first, end = name.removesuffix(".parquet").split("-")
            found.append(Segment(int(place.removeprefix("partition=")), int(first), int(end), info.path))
    return sorted(found, key=lambda s: (s.partition, s.first))


def _ends(path: str, earliest: bool = False) -> dict[int, int]:
    """Per partition the offset after its last row (earliest: of its first one)."""
    out: dict[int, int] = {}
    for s in segments(path):
        out[s.partition] = min(out.get(s.partition, s.first), s.first) if earliest else max(out.get(s.partition, 0), s.end)
    return out


def publish(messages: DataFrame, path: str, partitions: int = 4, segment_rows: int = 10_000) -> None:
    """Append messages (value, timestamp), dealt to partitions by content; every
    Spark task writes one partition's segments. A repeated task overwrites its own
    segments; one publisher at a time."""
    spark, start = messages.sparkSession, _ends(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        files, root = _open(path)
        folder, at = f"{root}/partition={p}", start.get(p, 0)
        files.create_dir(folder, recursive=True)

        def put(table: pa.Table) -> int:
            # A hidden name first: a reader never sees half a segment.
            name = f"{at:020d}-{at + table.num_rows:020d}.parquet"
            pa.parquet.write_table(table, f"{folder}/_{name}", filesystem=files)
            files.move(f"{folder}/_{name}", f"{folder}/{name}")
            return at + table.num_rows

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= segment_rows:
                table = pa.Table.from_batches(held).cast(_ROWS)
                at = put(table.slice(0, segment_rows))
                held = table.slice(segment_rows).to_batches()
        if any(b.num_rows for b in held):
            at = put(pa.Table.from_batches(held).cast(_ROWS))
        yield pa.RecordBatch.from_pydict({"partition": pa.array([p], pa.int32()), "end": pa.array([at], pa.int64())})

    rows = messages.select(F.col("value").cast("binary").alias("value"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    dealt = rows.repartition(partitions, F.hash("value", "timestamp")) if partitions > 1 else rows.coalesce(1)
    dealt.sortWithinPartitions("timestamp", "value").mapInArrow(write, "partition int, end bigint").write.format("noop").mode("overwrite").save()


class _Range(InputPartition):
    def __init__(self, segment: Segment, start: int, end: int):
        super().__init__((segment.path, segment.partition, segment.first, start, end))


class TopicReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}. The reader remembers the end of the
    range it handed out last, from which the next one is capped."""

    def __init__(self, options):
        self.path, self.cap = options["path"], int(options.get("maxOffsetsPerTrigger", MAX_OFFSETS_PER_TRIGGER))
        self.earliest = options.get("startingOffsets", "earliest") == "earliest"
        self.notes = options.get("lostPath", "")
        self.first: dict[str, int] | None = None
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        if self.first is None:
            self.first = {str(p): o for p, o in _ends(self.path, self.earliest).items()}
        return dict(self.first)

    def latestOffset(self) -> dict:
        """At most `cap` rows past the range handed out last, the same share of
        what is waiting from each partition. A range that is gone is passed at once."""
        # Spark asks a new query's reader for this first, a restarted one's only after it has told where it stopped.
        if self.at is None:
            self.at = self.initialOffset()
        waiting, at, there = {}, dict(self.at), segments(self.path)
        first, end = {}, {}
        for s in there:
            p = str(s.partition)
            first[p], end[p] = min(first.get(p, s.first), s.first), max(end.get(p, 0), s.end)
        for p in end:
            at[p] = max(at.get(p, 0), first[p])
            waiting[p] = end[p] - at[p]
        total = sum(waiting.values())
        if total <= self.cap:
            return at | end
        shares = {p: self.cap * n // total for p, n in waiting.items()}
        left = self.cap - sum(shares.values())
        for p in sorted(waiting, key=lambda p: -waiting[p])[:left]:
            shares[p] += 1
        return at | {p: at[p] + shares[p] for p in shares}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task per piece of a segment. What of the range no segment has is noted."""
        self.at, out, there = dict(end), [], segments(self.path)
        for p, stop in end.items():
            at = start.get(p, 0)
            for s in there:
                if s.partition == int(p) and s.end > at and s.first < stop:
                    if s.first > at:
                        self._lost(p, at, s.first)
                    out.append(_Range(s, max(at, s.first), min(stop, s.end)))
                    at = min(stop, s.end)
            if at < stop:
                self._lost(p, at, stop)
        return out

    def _lost(self, partition: str, start: int, end: int) -> None:
        """One note per range: a batch that is planned again writes the same one."""
        if self.notes:
            files, root = _open(self.notes)
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{partition}-{start:020d}-{end:020d}.json") as out:
                out.write(json.dumps({"partition": int(partition), "first": start, "end": end, "rows": end - start}).encode())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, number, first, start, end = partition.value
        files, _ = _open(self.path)
        at = first
        with files.open_input_file(path) as source:
            for batch in pa.parquet.ParquetFile(source).iter_batches(batch_size=10_000):
                low, high = max(start - at, 0), min(end - at, batch.num_rows)
                if low < high:
                    part = batch.slice(low, high - low)
                    offsets = pa.array(range(at + low, at + high), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("value"), part.column("timestamp"), pa.array([number] * (high - low), pa.int32()), offsets],
                                                     names=["value", "timestamp", "partition", "offset"])
                at += batch.num_rows

    def commit(self, end: dict) -> None:
        self.at = {p: max(o, (self.at or {}).get(p, 0)) for p, o in end.items()}


class TopicSource(DataSource):
    """spark.readStream.format("event_topic") with options path, startingOffsets
    (earliest or latest), maxOffsetsPerTrigger and lostPath (a folder for notes)."""

    @classmethod
    def name(cls) -> str:
        return "event_topic"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicReader(self.options)


def topic_stream(spark: SparkSession, path: str, max_offsets: int = MAX_OFFSETS_PER_TRIGGER, starting: str = "earliest", lost: str = "") -> DataFrame:
    """The topic as messages (value, timestamp, partition, offset), rate-capped and
    tolerant of segments that are gone."""
    spark.dataSource.register(TopicSource)
    return (spark.readStream.format("event_topic").option("path", path).option("startingOffsets", starting)
            .option("maxOffsetsPerTrigger", max_offsets).option("lostPath", lost).load())


def lost_ranges(spark: SparkSession, notes: str) -> DataFrame:
    """Ranges that were skipped: partition, first, end, rows."""
    return spark.read.schema("partition int, first bigint, end bigint, rows bigint").json(notes)
