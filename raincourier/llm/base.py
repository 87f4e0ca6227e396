"""Shared column helpers of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
BROADCAST_ROWS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it by name inside lambdas, which would
    otherwise evaluate it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id written as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def checked_broadcast(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow id table only when its counted size allows it; a
    larger one is left to a shuffled join."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
