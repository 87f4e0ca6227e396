"""Offset source and two-phase sink."""
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from oracle.parts import quoted
from raincourier.sources import staged, topic
from raincourier.streaming import jobs


def _messages(spark, first, n):
    return spark.range(first, first + n, numPartitions=3).select(F.concat(F.lit("m"), "id").cast("binary").alias("value"), F.timestamp_seconds(F.col("id")).alias("timestamp"))


def _run(spark, path, root, cap, seen, **options):
    """Take in all there is; the number of rows of each batch goes to `seen`."""
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")
        seen[batch_id] = batch.count()
    query = jobs.start(topic.topic_stream(spark, path, cap, lost=f"{root}/lost", **options), None, write, root, every="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_topic_is_read_in_capped_ranges_and_survives_lost_segments(spark, tmp_path):
    path, root, seen = str(tmp_path / "topic"), str(tmp_path), {}
    topic.publish(_messages(spark, 0, 1000), path, partitions=3, segment_rows=100)
    assert sum(s.end - s.first for s in topic.segments(path)) == 1000 and len({s.partition for s in topic.segments(path)}) == 3
    _run(spark, path, root, 300, seen)
    assert max(seen.values()) <= 300 and sum(seen.values()) == 1000
    # a restart goes on where it stopped, with the same cap; a range that went meanwhile is skipped and counted
    topic.publish(_messages(spark, 1000, 1000), path, partitions=3, segment_rows=100)
    ends = topic._ends(path)
    fresh = [s for s in topic.segments(path) if s.first >= 250]
    lost = fresh[1]
    os.remove(lost.path)
    _run(spark, path, root, 300, seen)
    assert max(seen.values()) <= 300 and sum(seen.values()) == 2000 - (lost.end - lost.first)
    notes = [tuple(r) for r in topic.lost_ranges(spark, f"{root}/lost").collect()]
    assert sum(n[3] for n in notes) == lost.end - lost.first and {n[0] for n in notes} == {lost.partition}
    rows = spark.read.parquet(f"{root}/out")
    assert rows.select("partition", "offset").distinct().count() == rows.count() == rows.select("value").distinct().count()
    assert {r.partition: r.top + 1 for r in rows.groupBy("partition").agg(F.max("offset").alias("top")).collect()} == ends


def test_topic_from_its_end_and_empty(spark, tmp_path):
    path, seen = str(tmp_path / "topic"), {}
    topic.publish(_messages(spark, 0, 50), path, partitions=2)
    query = jobs.start(topic.topic_stream(spark, path, 10, starting="latest"), None, lambda b, k: seen.update({k: b.count()}), str(tmp_path), every="0 seconds")
    try:
        query.processAllAvailable()
        assert sum(seen.values()) == 0
        topic.publish(_messages(spark, 50, 25), path, partitions=2)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(seen.values()) == 25 and max(seen.values()) <= 10
    topic.publish(_messages(spark, 0, 0), str(tmp_path / "none"))
    assert topic.segments(str(tmp_path / "none")) == [] and topic.segments(str(tmp_path / "nowhere")) == []


def _stage(spark, root, name, df, formats="parquet,json"):
    query = staged.staged_writer(df, f"{root}/table", formats).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_staged_sink_is_exactly_once(spark, tmp_path):
    """A task that fails on purpose leaves nothing behind; the batch repeated, once
    after the failure and once after its manifest, counts once, in both formats."""
    root, schema = str(tmp_path), "id long, v string"
    spark.range(40).select("id", F.concat(F.lit("v"), "id").alias("v")).repartition(4).write.parquet(f"{root}/in")
    broken = F.udf(lambda k: 1 // (0 if k == 17 and os.path.exists(f"{root}/break") else 1), "int")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    open(f"{root}/break", "w").close()
    with pytest.raises(Exception):
        _stage(spark, root, "cp", stream.where(broken("id") > 0))
    before = {r.id for r in staged.read_committed(spark, f"{root}/table", schema).collect()} if os.path.exists(f"{root}/table/manifest") else set()
    assert 17 not in before and len(before) in (0, 20)
    os.remove(f"{root}/break")
    _stage(spark, root, "cp", stream.where(broken("id") > 0))
    for kind in ("parquet", "json"):
        rows = staged.read_committed(spark, f"{root}/table", schema, kind).collect()
        assert sorted(r.id for r in rows) == list(range(40)) and all(r.v == f"v{r.id}" for r in rows)
    # the same batches again, as after a crash between manifest and checkpoint
    _stage(spark, root, "cp-lost", stream)
    assert staged.read_committed(spark, f"{root}/table", schema).count() == 40
    assert [r.batch_id for r in staged.manifests(spark, f"{root}/table").orderBy("batch_id").collect()] == [0, 1]
    staged.sweep(spark, f"{root}/table")
    named = [f for m in glob.glob(f"{root}/table/manifest/*.json") for fs in json.load(open(m))["files"].values() for f in fs]
    assert sorted(named) == sorted(os.path.relpath(f, f"{root}/table") for f in glob.glob(f"{root}/table/parquet/*.parquet") + glob.glob(f"{root}/table/json/*.json"))


def test_completing_a_twin_leaves_literals_alone():
    assert quoted("SELECT at, 'look at ''this'' at once' AS x, x.at FROM t WHERE at > 'at'") == """SELECT "at", 'look at ''this'' at once' AS x, x."at" FROM t WHERE "at" > 'at'"""
