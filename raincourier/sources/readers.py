"""Readers: event streams, rain files, tables by SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourier.functions.rain import daily_class
from raincourier.sources import schemas

MAX_OFFSETS_PER_TRIGGER = 50_000


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                   max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> DataFrame:
    """The event topic as (value, timestamp): rate-capped, and tolerant of
    offsets the broker no longer keeps. Needs the Kafka connector package."""
    stream = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", starting).option("failOnDataLoss", "false").option("maxOffsetsPerTrigger", max_offsets))
    return stream.load().select("value", "timestamp")


def file_stream(spark: SparkSession, folder: str, schema, name_glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """A growing folder of parquet files as a stream, capped per trigger."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A parquet table as a stream, be it one file or a folder of part files. A
    table that is not there raises an error instead of an empty stream."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    if status.isDirectory():
        return file_stream(spark, path, schema, max_files=max_files)
    # Without partition discovery, tables that lie beside the file as folders do no harm.
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", path.rpartition("/")[2])
    return reader.parquet(path.rpartition("/")[0])


def read_daily(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Daily rain CSV (city_id, date, rain_mm), gzip allowed; blank readings are
    null. A gzip file is one split, so it is spread out again when asked."""
    rows = spark.read.schema(schemas.DAILY_RAIN).csv(path, header=True, nullValue="")
    return rows.repartition(partitions) if partitions else rows


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Sparse hourly rain CSV (city_id, YYYY-MM-DDTHH, mm)."""
    rows = spark.read.schema(schemas.HOURLY_RAIN).csv(path, header=True, nullValue="")
    return rows.select("city_id", F.to_timestamp("hour", "yyyy-MM-dd'T'HH").alias("hour"), "mm")


def mmph(requests: DataFrame, hourly: DataFrame) -> DataFrame:
    """mm/h for (city_id, hour) rows; hours without a record are dry."""
    return requests.join(hourly, ["city_id", "hour"], "left").withColumn("mm", F.coalesce("mm", F.lit(0.0)))


def register_tables(tables: dict) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def rows(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL with bound parameters over registered tables."""
    return spark.sql(sql, args=args or {})


def classified_daily(spark: SparkSession, path: str) -> DataFrame:
    return read_daily(spark, path).withColumn("severity", daily_class(F.col("rain_mm")))
