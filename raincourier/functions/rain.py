"""Rain classes, seasons and the lead-time aware forecast, as expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions.numeric import clamp, rounded, total


def _class_by(mm: Column, edges) -> Column:
    mm = F.coalesce(mm, F.lit(0.0))
    expr = F
    for name, edge in reversed(list(zip(S.RAIN_CLASSES[1:], edges))):
        expr = expr.when(mm >= edge, F.lit(name))
    return expr.otherwise(F.lit(S.RAIN_CLASSES[0]))


def daily_class(mm: Column) -> Column:
    return _class_by(mm, S.DAILY_EDGES_MM)


def hourly_class(mm: Column) -> Column:
    return _class_by(mm, S.HOURLY_EDGES_MM)


def severity_rank(name: Column) -> Column:
    """none 0 … extreme 3."""
    return (F.array_position(F.array(*map(F.lit, S.RAIN_CLASSES)), name) - 1).cast("int")


def class_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, S.RAIN_CLASSES)), (rank + 1).cast("int"))


def worst_class(name: Column) -> Column:
    """Aggregate: the most severe class of a group."""
    return class_of_rank(F.max(severity_rank(name)))


def per_class(name: Column, values) -> Column:
    """The value belonging to a row's class (model tables of `settings`)."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), severity_rank(name) + 1)


def season_of(month: Column) -> Column:
    expr = F
    for season, months in S.SEASON_MONTHS.items():
        expr = expr.when(month.isin(*months), F.lit(season))
    return expr


# ---- forecast --------------------------------------------------------------
PROBABILITIES = tuple(f"prob_{name}" for name in S.RAIN_CLASSES)


def hit_rate(lead_h: Column) -> Column:
    return F.greatest(F.lit(S.FORECAST_HIT_FLOOR),
                      F.lit(S.FORECAST_HIT_NOW) - S.FORECAST_HIT_LOSS_PER_H * F.greatest(lead_h, F.lit(0.0)))


def forecast_probs(true_class: Column, lead_h: Column) -> dict:
    """One probability column per class: the true class keeps the hit rate,
    the rest is split evenly over its existing neighbours."""
    rank, hit, last = severity_rank(true_class), hit_rate(lead_h), len(S.RAIN_CLASSES) - 1
    spill = (1 - hit) / F.when(rank.isin(0, last), 1).otherwise(2)
    return {
        column: rounded(F.when(rank == i, hit).when(F.abs(rank - i) == 1, spill).otherwise(0.0), 4)
        for i, column in enumerate(PROBABILITIES)
    }


def wet_probability(p_none: Column) -> Column:
    return rounded(1 - p_none, 4)


def scale_rain(probs: dict, scale) -> dict:
    """Move |scale-1| of every class one class up (scale > 1) or down."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    share = F.least(F.lit(1.0), F.abs(scale - 1))
    p = [probs[c] for c in PROBABILITIES]
    last = len(p) - 1
    wetter = [p[i] - (p[i] * share if i < last else 0) + (p[i - 1] * share if i else 0) for i in range(last + 1)]
    drier = [p[i] - (p[i] * share if i else 0) + (p[i + 1] * share if i < last else 0) for i in range(last + 1)]
    return {c: F.when(scale > 1, up).when(scale < 1, down).otherwise(same)
            for c, up, down, same in zip(PROBABILITIES, wetter, drier, p)}


def expected(probs: dict, values) -> Column:
    """Probability-weighted mean of a per-class model table."""
    return total(probs[c] * float(v) for c, v in zip(PROBABILITIES, values))


def likeliest(probs: dict, classes=S.RAIN_CLASSES) -> Column:
    """Class of the greatest probability; the milder one on ties."""
    best = F.greatest(*[probs[f"prob_{c}"] for c in classes])
    expr = F
    for c in classes:
        expr = expr.when(probs[f"prob_{c}"] == best, F.lit(c))
    return expr


def exposure_probability(severity: Column, mm: Column) -> Column:
    """Share of a route-day's orders that meet the rain, by daily class."""
    # Fixed values of the long-run history model.
    return (F.when(severity == "none", 0.0)
            .when(severity == "rain", clamp(0.25 + mm / 80, 0.0, 0.9))
            .when(severity == "heavy", 0.9).otherwise(0.97))
