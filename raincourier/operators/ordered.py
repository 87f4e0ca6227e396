"""Running values over a global order without a single-task window.

Rows are dealt to key ranges of similar size and written once; per-range totals
are carried forward over the (few) ranges, and only then does a window run inside
each range. Keys must be unique, so that no range can be dominated by one value.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raincourier.sources.scratch import written


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """Rows with the number of their key range, higher numbers for higher keys.
    The split points only balance work, results never depend on them."""
    return written(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")


def running_before(df: DataFrame, key: str, values: dict) -> DataFrame:
    """For each output name, (aggregate, column) over all rows with a smaller
    key; null for the first row. `aggregate` is F.sum or F.max."""
    split = in_ranges(df, key)
    sums = split.groupBy("_range").agg(*[agg(column).alias(f"_{name}") for name, (agg, column) in values.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    carry = sums.select("_range", *[agg(f"_{name}").over(earlier).alias(f"_c_{name}") for name, (agg, _) in values.items()])
    inside = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    out = split.join(carry, "_range")
    for name, (agg, column) in values.items():
        local, before = agg(column).over(inside), F.col(f"_c_{name}")
        both = F.greatest(local, before) if agg is F.max else local + before
        out = out.withColumn(name, F.when(local.isNull(), before).when(before.isNull(), local).otherwise(both))
    return out.drop("_range", *[f"_c_{name}" for name in values])
