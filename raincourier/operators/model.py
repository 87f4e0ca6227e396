"""The SLA-breach model: features, logistic fit, rank AUC."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.functions import rain, score, service
from raincourier.functions.numeric import rounded, total
from raincourier.operators.ordered import running_before

FEATURES = ("x0", "x1", "x2", "x3")
RIDGE = 1e-6
STEP_DONE = 1e-8


def training_features(completed: DataFrame, routes: DataFrame) -> DataFrame:
    """Model rows of completed orders. The rain is what a forecast would have
    said `lead_h` hours ahead of the class that came (`true_class`)."""
    joined = completed.select("route_id", "tier", "true_class", "lead_h", "sla_breached").join(
        routes.select("route_id", "distance_km", "sensitivity", "normal_eta_h"), "route_id")
    joined = joined.withColumns(rain.forecast_probs(F.col("true_class"), F.col("lead_h")))
    weight = service.expected_weight({c: F.col(c) for c in rain.PROBABILITIES})
    normal = F.col("normal_eta_h")
    x = score.breach_features(normal, service.promised_h(normal, F.col("tier")), F.col("sensitivity"), weight, F.col("distance_km"))
    return joined.select(*[value.alias(name) for name, value in zip(FEATURES, x)], F.col("sla_breached").cast("int").alias("y"))


def fit_logistic(rows: DataFrame, features=FEATURES, label: str = "y", rounds: int = 25) -> list[float]:
    """Newton iterations for a logistic regression. Equal feature vectors are
    merged first; each round is one distributed aggregation of the gradient
    and Hessian sums, and the driver only solves the small system."""
    compact = rows.groupBy(*features).agg(F.count("*").alias("n"), F.sum(label).alias("positive")).persist()
    try:
        k = len(features)
        w = np.zeros(k)
        for _ in range(rounds):
            p = score.logistic(total(F.col(f) * float(c) for f, c in zip(features, w)))
            spread = F.col("n") * p * (1 - p)
            gradient = [F.sum(F.col(f) * (F.col("positive") - F.col("n") * p)).alias(f"g{i}") for i, f in enumerate(features)]
            hessian = [F.sum(F.col(features[i]) * F.col(features[j]) * spread).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            sums = compact.agg(*gradient, *hessian).first()
            h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + RIDGE * np.eye(k)
            step = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(k)]))
            w += step
            if np.abs(step).max() < STEP_DONE:
                break
        return [float(c) for c in w]
    finally:
        compact.unpersist()


def auc(rows: DataFrame, score_column: str = "score", label: str = "y") -> DataFrame:
    """Rank AUC; equal scores share their average rank. Labels are counted per
    score before ranking, so the ranked table is distinct scores only."""
    by_score = rows.groupBy(F.col(score_column).cast("double").alias("s")).agg(
        F.sum(label).cast("double").alias("positive"), F.sum(1 - F.col(label)).cast("double").alias("negative"))
    ranked = running_before(by_score, "s", {"below": (F.sum, F.col("negative"))})
    wins = F.sum(F.col("positive") * (F.coalesce("below", F.lit(0.0)) + F.col("negative") / 2))
    pairs = F.sum("positive") * F.sum("negative")
    return ranked.agg(rounded(F.try_divide(wins, pairs), 6).alias("auc"), F.sum("positive").cast("bigint").alias("positives"),
                      F.sum("negative").cast("bigint").alias("negatives"))


def breach_model(rows: DataFrame) -> DataFrame:
    """Fit and grade in one row: coefficients (4 decimals), AUC, base rate."""
    w = fit_logistic(rows)
    coefs = [round(c, 4) for c in w]
    scored = rows.select(score.breach_probability(w, [F.col(f) for f in FEATURES]).alias("score"), "y")
    return auc(scored).select(*[F.lit(c).alias(f"coef_{i}") for i, c in enumerate(coefs)], F.round("auc", 4).alias("auc"),
                              F.round(F.col("positives") / (F.col("positives") + F.col("negatives")), 4).alias("base_rate"),
                              (F.col("positives") + F.col("negatives")).alias("n"))
