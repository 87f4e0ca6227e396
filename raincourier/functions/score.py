"""Risk category and SLA-breach probability."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions.numeric import clamp, total


def risk_category(score: Column) -> Column:
    expr = F
    for name, edge in S.RISK_EDGES:
        expr = expr.when(score >= edge, F.lit(name))
    return expr.otherwise(F.lit("Low"))


def breach_features(normal_h: Column, promised: Column, sensitivity: Column, weight: Column, km: Column):
    """Intercept, slack relative to travel time, sensitivity × severity, length."""
    return [F.lit(1.0), (promised - normal_h) / normal_h, sensitivity * weight, km / 1000]


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -S.LOGIT_CLAMP, S.LOGIT_CLAMP)))


def breach_probability(coefs, features) -> Column:
    return logistic(total(f * float(c) for c, f in zip(coefs, features)))
