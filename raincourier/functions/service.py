"""Travel time, promise and demand expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions.numeric import pick
from raincourier.functions.rain import expected, per_class


def normal_eta_h(distance_km: Column) -> Column:
    handling = S.WAREHOUSE_DWELL_H + S.HUB_DWELL_H + S.LAST_MILE_H
    return handling + distance_km / S.LINEHAUL_KMPH


def promised_h(normal_h: Column, tier: Column) -> Column:
    return pick(tier, {t: normal_h * factor + extra for t, (factor, extra) in S.PROMISE.items()})


def weather_eta_h(normal_h: Column, sensitivity: Column, rain_class: Column) -> Column:
    return normal_h * (1 + (per_class(rain_class, S.ETA_MULTIPLIER) - 1) * sensitivity)


def weather_delay_h(normal_h: Column, sensitivity: Column, rain_class: Column) -> Column:
    return weather_eta_h(normal_h, sensitivity, rain_class) - normal_h


def expected_weight(probs: dict) -> Column:
    return expected(probs, S.SEVERITY_WEIGHT)


def expected_delay_h(normal_h: Column, sensitivity: Column, probs: dict) -> Column:
    return normal_h * (expected(probs, S.ETA_MULTIPLIER) - 1) * sensitivity


def sla_cost(tier: Column) -> Column:
    return pick(tier, {t: float(c) for t, c in S.COST_SLA.items()})


def expected_orders(day: Column) -> Column:
    """Company-wide orders of a day: yearly growth, weekday and month pattern."""
    years = F.datediff(day, F.to_date(F.lit(S.BASE_DAY))) / 365.25
    weekday = F.element_at(F.array(*map(F.lit, S.WEEKDAY_FACTOR)), F.weekday(day) + 1)
    month = F.element_at(F.array(*map(F.lit, S.MONTH_FACTOR)), F.month(day))
    return S.BASE_ORDERS * F.pow(F.lit(S.YEARLY_GROWTH), years) * weekday * month


def hourly_share(ist_hour: Column) -> Column:
    mean = sum(S.HOUR_FACTOR_IST) / 24
    return F.element_at(F.array(*map(F.lit, S.HOUR_FACTOR_IST)), (ist_hour + 1).cast("int")) / mean
