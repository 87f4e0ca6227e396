"""Declared schemas; nothing is inferred."""
from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, DOUBLE, TIMESTAMP, INT, BOOLEAN = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.BooleanType()

ENVELOPE = _struct(event_id=STRING, type=STRING, sim_time=TIMESTAMP, emitted_at=TIMESTAMP, order_id=STRING,
                   city_id=STRING, route_id=STRING, payload=STRING)
CLEAN_COLUMNS = [*ENVELOPE.fieldNames(), "kafka_ts"]

ORDER_LINE = _struct(product_id=STRING, qty=INT, price_inr=DOUBLE)
# Union of the payload fields of every type; from_json leaves absent ones null.
PAYLOAD = _struct(
    customer_id=STRING, warehouse_id=STRING, hub_id=STRING, route_code=STRING, category_id=STRING, tier=STRING,
    value_inr=DOUBLE, items=T.ArrayType(ORDER_LINE), planned_dispatch=TIMESTAMP, promised_at=TIMESTAMP,
    trip_id=STRING, vehicle_id=STRING, planned_arrival=TIMESTAMP, near_city=STRING, progress=DOUBLE, lat=DOUBLE,
    lon=DOUBLE, cause=STRING, delay_min=DOUBLE, weather_delay_min=DOUBLE, weather_class=STRING, sla_breached=BOOLEAN,
    rain_mmph=DOUBLE, severity=STRING, orders=INT)

DAILY_RAIN = _struct(city_id=STRING, date=T.DateType(), rain_mm=DOUBLE)
HOURLY_RAIN = _struct(city_id=STRING, hour=STRING, mm=DOUBLE)

STATE_OPERATOR = _struct(numRowsDroppedByWatermark=T.LongType(), customMetrics=T.MapType(STRING, T.LongType()))
PROGRESS = T.StructType([
    T.StructField("name", STRING), T.StructField("batchId", T.LongType()), T.StructField("timestamp", STRING),
    T.StructField("numInputRows", T.LongType()), T.StructField("inputRowsPerSecond", DOUBLE),
    T.StructField("processedRowsPerSecond", DOUBLE), T.StructField("durationMs", T.MapType(STRING, T.LongType())),
    T.StructField("eventTime", T.MapType(STRING, STRING)),
    T.StructField("stateOperators", T.ArrayType(STATE_OPERATOR)),
    T.StructField("sources", T.ArrayType(_struct(metrics=T.MapType(STRING, STRING)))),
])

# The order table: what an order is, set when it is first seen, and how far it has come.
ORDER_IDENTITY = ["order_id", "customer_id", "city_id", "route_id", "warehouse_id", "hub_id", "category_id", "tier", "value_inr", "items"]
ORDER_PROGRESS = ["status", "created_at", "planned_dispatch", "promised_at", "dispatched_at", "eta_at", "delivered_at", "vehicle_id", "weather_class",
                  "delay_min", "sla_breached"]
