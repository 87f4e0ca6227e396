"""Registered queries: name → function of (spark, folder of parquet tables)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourier.sources.tables import lake

_QUERIES: dict = {}


def query(name: str | None = None):
    """Register a function of a Lake. Timestamps leave as TIMESTAMP_NTZ (UTC),
    the type the source tables use."""
    def register(build):
        def run(spark, folder: str) -> DataFrame:
            out = build(lake(spark, folder))
            zoned = [f.name for f in out.schema.fields if isinstance(f.dataType, T.TimestampType)]
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out
        run.__name__ = name or build.__name__
        run.__doc__ = build.__doc__
        assert run.__name__ not in _QUERIES, run.__name__
        _QUERIES[run.__name__] = run
        return build
    return register


def all_queries() -> dict:
    from raincourier.plans import history_queries, ingest_queries, live_queries, network_queries  # noqa: F401
    from raincourier.plans import rain_queries, scalar_queries, state_queries, stream_queries, table_queries  # noqa: F401
    return dict(_QUERIES)
