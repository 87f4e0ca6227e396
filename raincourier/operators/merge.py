"""Table maintenance as pure merges: (old, new) in, next version out."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.functions import clock, rain


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mutable: list[str], version: str) -> DataFrame:
    """Insert unknown keys; for known ones overwrite only `mutable`, keeping
    the identity columns of the first insert. Of several new rows per key the
    highest `version` wins."""
    fixed = [c for c in old.columns if c not in keys and c not in mutable]
    newest = new.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in old.columns if c not in keys and c != version])).alias("n"))
    before = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    both = before.join(newest, keys, "full")
    known = F.col("o").isNotNull()
    kept = [F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in fixed]
    moved = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in mutable]
    return both.select(*keys, *kept, *moved).select(*old.columns)


def merge_additive(old: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], worst: str | None = None) -> DataFrame:
    """Add measures to existing keys; the severity becomes the worse of both."""
    columns = [*keys, *sums, *([worst] if worst else [])]
    both = old.select(*columns).unionByName(delta.select(*columns))
    aggregates = [F.sum(c).alias(c) for c in sums]
    if worst:
        aggregates.append(rain.worst_class(F.col(worst)).alias(worst))
    return both.groupBy(*keys).agg(*aggregates)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows with unknown keys; the first of equal new keys is the smallest."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row"))
    return old.unionByName(fresh.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def replace_current(new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the latest."""
    rest = [c for c in new.columns if c not in (key, version)]
    return new.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("row")).select(key, "row.*")


def retain(rows: DataFrame, ts: str, hours: float, now) -> DataFrame:
    """Rows no older than the retention."""
    return rows.filter(F.col(ts) >= clock.plus_hours(clock.moment(now), -float(hours)))


def reset_from_date(rows: DataFrame, date, column: str = "date") -> DataFrame:
    """History before a replay start; what the replay produced is dropped."""
    return rows.filter(F.col(column) < F.to_date(F.lit(date)))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Unique rows of an append-with-retry feed, sorted."""
    unique = rows.distinct()
    return unique.orderBy(*unique.columns)
