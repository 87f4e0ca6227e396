"""Ingest and stream-metric queries over the events table, run as batch."""
from pyspark.sql import functions as F

from raincourier.functions import clock
from raincourier.operators import ingest
from raincourier.plans.catalog import query

NOW = "2024-02-01T00:00:00Z"


def checked(lake):
    return ingest.with_reject_reason(ingest.parse_envelope(lake.messages()), NOW)


def clean(lake):
    return ingest.clean_dedup(checked(lake))


@query()
def parse_envelope(lake):
    return ingest.parse_envelope(lake.messages()).drop("raw", "payload")


@query()
def reject_reason(lake):
    return checked(lake).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason"), "type").agg(F.count("*").alias("rows"))


@query()
def quarantine(lake):
    return ingest.quarantine(checked(lake)).select("reason", "event_id", "type", "kafka_ts", F.length("raw").alias("raw_chars"))


@query()
def clean_dedup(lake):
    return clean(lake).drop("payload")


@query()
def reject_counts(lake):
    return ingest.reject_counts(checked(lake))


@query()
def agg_city_window(lake):
    return ingest.agg_city_window(clean(lake)).withColumn("avg_delay_min", F.round("avg_delay_min", 4))


@query()
def agg_network_window(lake):
    return ingest.agg_network_window(ingest.agg_city_window(clean(lake)))


@query()
def event_type_counts(lake):
    return ingest.event_type_counts(clean(lake))


@query()
def trailing_event_rate(lake):
    return ingest.trailing_event_rate(checked(lake), _latest(lake))


def _latest(lake):
    """The arrival time of the newest valid event, as the wall clock; repeated
    events do not change a maximum."""
    return ingest.valid(checked(lake)).agg(F.max("emitted_at")).scalar()


@query()
def event_freshness(lake):
    return ingest.event_freshness(ingest.valid(checked(lake)), clock.moment(NOW))
