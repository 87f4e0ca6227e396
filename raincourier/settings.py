"""Model parameters.

Fixed values: everything in this file has to keep the published value for
results to agree with the operational model; nothing here is tuned.
"""

# ---- event contract --------------------------------------------------------
EVENT_TYPES = (
    "ORDER_CREATED",
    "ORDER_ASSIGNED",
    "VEHICLE_DISPATCHED",
    "VEHICLE_MOVEMENT",
    "HUB_ARRIVAL",
    "DELIVERY_DELAY",
    "DELIVERY_COMPLETED",
    "WEATHER_EVENT",
    "RISK_UPDATE",
)
TYPES_WITH_ORDER = ("ORDER_CREATED", "ORDER_ASSIGNED", "DELIVERY_COMPLETED")
TYPES_WITH_CITY = ("WEATHER_EVENT",)
FUTURE_TOLERANCE_S = 120
QUARANTINE_RAW_CHARS = 1024
WATERMARK = "30 seconds"
METRIC_WINDOW = "30 seconds"

# ---- rain ------------------------------------------------------------------
RAIN_CLASSES = ("none", "rain", "heavy", "extreme")
DAILY_EDGES_MM = (2.5, 64.5, 115.6)
HOURLY_EDGES_MM = (2.5, 7.6, 20.0)
SEASON_MONTHS = {
    "winter": (1, 2),
    "pre-monsoon": (3, 4, 5),
    "monsoon": (6, 7, 8, 9),
    "post-monsoon": (10, 11, 12),
}
MONSOON_MONTHS = (6, 9)
DAYS_PER_MONTH = 30.4
FORECAST_HIT_NOW = 0.9
FORECAST_HIT_LOSS_PER_H = 0.0085
FORECAST_HIT_FLOOR = 0.5
FORECAST_HOURS = 48

# ---- delay model, one value per rain class ---------------------------------
ETA_MULTIPLIER = (1.0, 1.12, 1.30, 1.56)
SEVERITY_WEIGHT = (0.0, 0.35, 0.7, 1.0)
P_AFFECTED = (0.0, 0.45, 0.8, 0.95)
FAILED_RATE = (0.0, 0.002, 0.008, 0.03)
COST_PER_DELAY_HOUR = 38
COST_RESHIP = 220
COST_SLA = {"express": 150, "standard": 60, "economy": 25}
EXPOSED_P_RAIN = 0.5

# ---- service promise -------------------------------------------------------
TIERS = ("express", "standard", "economy")
TIER_MIX = (0.20, 0.65, 0.15)
PROMISE = {"express": (1.25, 0.0), "standard": (1.5, 6.0), "economy": (2.0, 18.0)}
WAREHOUSE_DWELL_H = 0.5
LINEHAUL_KMPH = 50
HUB_DWELL_H = 0.5
LAST_MILE_H = 1.0

# ---- network ---------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
ROAD_FACTOR = 1.25
LOCAL_KM = 35.0
CORRIDOR_KM = 45.0
LONG_ROUTE_KM = 600
LONG_ROUTE_SENSITIVITY = 0.05
SENSITIVITY_RANGE = (0.7, 1.4)
ROUTE_SHARE = {"primary": 0.75, "secondary": 0.25}

# ---- demand ----------------------------------------------------------------
BASE_ORDERS = 9000
BASE_DAY = "2021-01-01"
YEARLY_GROWTH = 1.25
WEEKDAY_FACTOR = (1.04, 1.0, 0.98, 0.99, 1.02, 1.08, 0.92)  # Monday first
MONTH_FACTOR = (0.90, 0.92, 0.97, 0.97, 1.0, 0.98, 0.97, 1.02, 1.05, 1.35, 1.30, 1.08)
HOUR_FACTOR_IST = (
    0.35, 0.2, 0.12, 0.1, 0.12, 0.25, 0.5, 0.8, 1.0, 1.2, 1.4, 1.55,
    1.6, 1.5, 1.35, 1.25, 1.2, 1.25, 1.4, 1.6, 1.75, 1.7, 1.3, 0.75,
)
IST_OFFSET_H = 5.5

# ---- risk score ------------------------------------------------------------
RISK_CAPS = {
    "rainfall": 30,
    "route_history": 20,
    "exposure": 15,
    "load": 10,
    "timing": 8,
    "sla": 12,
    "performance": 5,
}
RISK_LABELS = {
    "rainfall": "Rain on the way",
    "route_history": "Past delays of the route",
    "exposure": "Hours in the rain",
    "load": "Warehouse under rain",
    "timing": "Hour of arrival",
    "sla": "Time to spare",
    "performance": "Dry on-time record",
}
RISK_EDGES = (("Critical", 75), ("High", 50), ("Medium", 25))
HISTORY_RATIO_FULL = 0.5
EXPOSURE_FULL_H = 10
LOAD_FULL_SHARE = 0.6
MISS_RATE_FULL = 0.25
DAYTIME_WEIGHT = 0.6
EVENING_FROM_H = 17
EVENING_UNTIL_H = 6
FALLBACK_ON_TIME = 0.95
LOGIT_CLAMP = 30.0

# ---- live views ------------------------------------------------------------
HORIZONS_H = (6, 12, 24, 48)
UPCOMING = ("scheduled", "assigned")
ON_THE_ROAD = ("in_transit", "at_hub")
ACTIVE = ("scheduled", "assigned", "in_transit", "at_hub")
KEEP_DELIVERED_H = 48
EXPIRE_AFTER_H = 6
AFFECTED_MIN = 5
LATE_TRIP_MIN = 15
DELAYED_MIN = 30
IMPACT_HORIZON_H = 12
LATE_TRIP_BONUS = 10
RAIN_NOW_BONUS = 5
LIVE_WEIGHT = 0.6
HISTORY_WEIGHT = 0.4
REPLAY_JUMP_H = 12

# ---- scenarios -------------------------------------------------------------
SCENARIO_LATE_MIN = 45
COST_PER_ORDER_KM = 0.15
HUB_COST_PER_DAY = 150_000
LOCAL_HUB_SENSITIVITY_CUT = 0.1
SHIFT_RANGE_H = (-4.0, 8.0)
RAIN_SCALE_RANGE = (0.5, 2.0)
WINDOW_RANGE_H = (1, 48)

# ---- expected history ------------------------------------------------------
BASE_SLA_RATE = 0.022
BASE_DELAYED_RATE = 0.055
DELAY_SIGMA = 0.3
