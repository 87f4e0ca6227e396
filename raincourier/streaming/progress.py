"""Health of the streaming queries."""
from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from raincourier.sources.schemas import PROGRESS

log = logging.getLogger(__name__)


def progress_digest(progress: DataFrame, column: str = "progress") -> DataFrame:
    """Progress JSON to the fields a health panel shows; drops are summed over
    the stateful operators, absent parts count as zero."""
    p = F.from_json(column, PROGRESS)
    rows = progress.select(p.alias("p"))

    def zero(value):
        return F.coalesce(value, F.lit(0).cast("bigint"))

    def summed(pick):
        return F.aggregate(F.coalesce("p.stateOperators", F.array().cast(PROGRESS["stateOperators"].dataType)), F.lit(0).cast("bigint"),
                           lambda acc, operator: acc + zero(pick(operator)))

    def number(value):
        return F.round(F.coalesce(value.try_cast("double"), F.lit(0.0)), 2)

    return rows.select(
        "p.name", F.col("p.batchId").alias("batch"), F.col("p.timestamp").alias("at"), zero(F.col("p.numInputRows")).alias("rows"),
        number(F.col("p.inputRowsPerSecond")).alias("input_rps"), number(F.col("p.processedRowsPerSecond")).alias("processed_rps"),
        zero(F.col("p.durationMs")["triggerExecution"]).alias("batch_ms"), F.col("p.eventTime")["watermark"].alias("watermark"),
        F.coalesce(F.get(F.col("p.sources"), 0)["metrics"]["avgOffsetsBehindLatest"].try_cast("double"), F.lit(0.0)).alias("offsets_behind"),
        summed(lambda s: s["numRowsDroppedByWatermark"]).alias("dropped_late"),
        summed(lambda s: s["customMetrics"]["numDroppedDuplicateRows"]).alias("dropped_duplicates"))


class ProgressListener(StreamingQueryListener):
    """Hands every progress report to `publish(name, json text)` and keeps the
    running drop counters. Reporting problems never stop a stream."""

    def __init__(self, publish: Callable[[str, str], None]):
        self.publish = publish
        self.dropped_late = 0
        self.dropped_duplicates = 0
        self.terminated: dict = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            text = event.progress.json
            for operator in json.loads(text).get("stateOperators", []):
                self.dropped_late += operator.get("numRowsDroppedByWatermark", 0)
                self.dropped_duplicates += int(operator.get("customMetrics", {}).get("numDroppedDuplicateRows", 0))
            self.publish(event.progress.name, text)
        except Exception:
            log.exception("progress report was not published")

    def onQueryTerminated(self, event) -> None:
        try:
            self.terminated[str(event.id)] = event.exception
            self.publish("terminated", json.dumps({"id": str(event.id), "exception": event.exception}))
        except Exception:
            log.exception("termination was not published")
