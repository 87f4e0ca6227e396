"""A streaming sink with a two-phase commit.

Tasks stage their rows in files of their own; the driver then names the files of
the tasks that succeeded in one manifest per batch, by a single move. Readers
take only what a manifest names, so they see whole batches or nothing, and each
batch once: a batch that is repeated after its manifest was written is dropped."""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from raincourier.sources.topic import _open


@dataclass
class Staged(WriterCommitMessage):
    """Files one task has written, by format, and their rows."""
    files: dict = field(default_factory=dict)
    rows: int = 0


class _Staging(DataSourceStreamArrowWriter):
    def __init__(self, path: str, formats: list[str]):
        self.path, self.formats = path, formats

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Phase one, in a task: every format gets the same rows in one pass."""
        files, root = _open(self.path)
        name, done, writer, lines = uuid.uuid4().hex, Staged(), None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                done.rows += batch.num_rows
                if "parquet" in self.formats:
                    if writer is None:
                        files.create_dir(f"{root}/parquet", recursive=True)
                        done.files["parquet"] = f"parquet/{name}.parquet"
                        writer = pa.parquet.ParquetWriter(f"{root}/{done.files['parquet']}", batch.schema, filesystem=files)
                    writer.write_batch(batch)
                if "json" in self.formats:
                    if lines is None:
                        files.create_dir(f"{root}/json", recursive=True)
                        done.files["json"] = f"json/{name}.json"
                        lines = files.open_output_stream(f"{root}/{done.files['json']}")
                    lines.write("".join(json.dumps(row, default=str) + "\n" for row in batch.to_pylist()).encode())
        finally:
            for out in (writer, lines):
                if out is not None:
                    out.close()
        return done

    def _manifest(self, batch: int) -> str:
        return f"{_open(self.path)[1]}/manifest/{batch:012d}.json"

    def commit(self, messages: list, batchId: int) -> None:
        """Phase two, on the driver. The manifest appears whole, by a move, and an
        existing one stands."""
        files, root = _open(self.path)
        manifest = self._manifest(batchId)
        if files.get_file_info(manifest).type != pa.fs.FileType.NotFound:
            return self.abort(messages, batchId)
        done = [m for m in messages if m is not None and m.rows]
        files.create_dir(f"{root}/manifest", recursive=True)
        hidden = f"{root}/manifest/_{batchId:012d}-{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps({"batch_id": batchId, "rows": sum(m.rows for m in done), "files": {f: [m.files[f] for m in done] for f in self.formats}}).encode())
        files.move(hidden, manifest)

    def abort(self, messages: list, batchId: int) -> None:
        """Forget what the tasks have staged. Files of tasks that died without a
        message stay behind unseen until `sweep`."""
        files, root = _open(self.path)
        for message in messages:
            for name in (message.files.values() if message is not None else ()):
                if files.get_file_info(f"{root}/{name}").type == pa.fs.FileType.File:
                    files.delete_file(f"{root}/{name}")


class StagedSink(DataSource):
    """df.writeStream.format("staged_table") with options path and formats (parquet, json or both)."""

    @classmethod
    def name(cls) -> str:
        return "staged_table"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Staging(self.options["path"], self.options.get("formats", "parquet").split(","))


def staged_writer(df: DataFrame, path: str, formats: str = "parquet"):
    """A DataStreamWriter into the staged table; the caller adds checkpoint and trigger."""
    df.sparkSession.dataSource.register(StagedSink)
    return df.writeStream.format("staged_table").option("path", path).option("formats", formats)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches: batch_id, rows, files by format."""
    return spark.read.schema("batch_id bigint, rows bigint, files struct<parquet: array<string>, json: array<string>>").option("pathGlobFilter", "*.json").json(f"{path}/manifest")


def read_committed(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """Rows of committed batches. As with any file table the driver holds the file
    names; the rows are read by Spark's own reader."""
    names = [f"{path}/{name}" for row in manifests(spark, path).select(f"files.{kind}").toLocalIterator() for name in row[0] or ()]
    reader = spark.read.schema(schema)
    return (reader.parquet(*names) if kind == "parquet" else reader.json(names)) if names else spark.createDataFrame([], schema)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete staged files that no manifest names, and count them. Only while no
    query writes to the table."""
    files, root = _open(path)
    named = {name for row in manifests(spark, path).select("files.*").collect() for names in row if names for name in names}
    gone = 0
    for kind in ("parquet", "json"):
        for info in files.get_file_info(pa.fs.FileSelector(f"{root}/{kind}", allow_not_found=True)):
            if f"{kind}/{info.base_name}" not in named:
                files.delete_file(info.path)
                gone += 1
    return gone
