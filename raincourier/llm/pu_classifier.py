"""Quality classifier from positive and unlabelled texts.

The non-negative unbiased risk  pi*E_p[l+] + max(0, E_u[l-] - pi*E_p[l-])  with
logistic loss is minimised over dense text features. Every sum runs over all
documents in Spark; the driver sees one small matrix a round."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourier.llm.base import fold
from raincourier.sources.scratch import written

ROUNDS, RIDGE, TOLERANCE, SLACK = 12, 1e-3, 1e-6, 1e-4
_SYMBOLS, _MARKS = b"#*$%&|<>{}[]^~_=+@\\/", b".,;:"
_CLASSES = [np.frombuffer(_SYMBOLS, np.uint8), np.frombuffer(_MARKS, np.uint8), np.frombuffer(b"!?", np.uint8), np.frombuffer(b"|<>", np.uint8),
            np.frombuffer(b"\"'()-", np.uint8), np.arange(65, 91), np.arange(48, 58), np.arange(128, 256)]
N_FEATURES = 2 * len(_CLASSES) + 10


def features(text: str | None) -> np.ndarray:
    """Character shares (each also square-rooted, so that rare ones count), size,
    vocabulary, repetition and line shape. An empty text has only the constant."""
    out = np.zeros(N_FEATURES, np.float32)
    out[0] = 1.0
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.array([seen[c].sum() for c in _CLASSES]) / len(raw)
    n, distinct = len(words), len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(_CLASSES)
    out[1:1 + m], out[1 + m:1 + 2 * m] = shares, np.sqrt(shares)
    out[1 + 2 * m:] = (np.log1p(n) / 10, distinct / n, np.log1p(distinct) / np.log1p(n), len(raw) / n / 10, min(3.0, max(map(len, words)) / 40),
                       len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, sum(a == b for a, b in zip(words, words[1:])) / n,
                       sum(w[:1].isalnum() and w[-1:].isalnum() or w[-1:] in b".,;:" for w in words) / n)
    return out


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, x)."""
    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), flat)], ["doc_id", "x"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


_UPPER = np.triu_indices(N_FEATURES)


def _sums(table: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Sums over all rows: [n, loss-, grad-, hessian | n_p, loss-_p, x_p], added
    up by slot in Spark so that the driver gets one vector whatever the input."""
    d = N_FEATURES

    def run(batches):
        total = np.zeros(2 + d + len(_UPPER[0]) + 2 + 2 * d)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, d)
            pos = np.asarray(batch.column(1)).astype(bool)
            z = x @ theta
            p, loss = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.logaddexp(0, z)
            h = (x * (p * (1 - p))[:, None]).T @ x
            total += np.concatenate([[len(x), loss.sum()], p @ x, h[_UPPER], [pos.sum(), loss[pos].sum()], x[pos].sum(0), p[pos] @ x[pos]])
        yield pa.RecordBatch.from_pydict({"slot": np.arange(len(total), dtype=np.int32), "value": total})
    rows = table.select("x", "pos").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(2 + d + len(_UPPER[0]) + 2 + 2 * d)
    for r in rows:
        out[r.slot] = r.value
    return out


def fit(table: DataFrame, prior: float) -> np.ndarray:
    """Weights of the features. Newton steps while the negative part of the risk
    is not below 0; a round in which it is steps back along that part instead."""
    d, theta = N_FEATURES, np.zeros(N_FEATURES)
    for _ in range(ROUNDS):
        s = _sums(table, theta)
        n, loss_u, grad_u, rest = s[0], s[1], s[2:2 + d], s[2 + d:]
        hess = np.zeros((d, d))
        hess[_UPPER] = rest[:len(_UPPER[0])]
        hess = np.maximum(hess, 0) + np.triu(hess, 1).T + np.minimum(hess, 0)
        n_p, loss_p, x_p, grad_p = rest[-2 * d - 2], rest[-2 * d - 1], rest[-2 * d:-d], rest[-d:]
        if not n or not n_p:
            return theta
        curved = hess / n + RIDGE * np.eye(d)
        if loss_u / n - prior * loss_p / n_p < -SLACK:
            step = np.linalg.solve(curved, -(grad_u / n - prior * grad_p / n_p))
        else:
            step = np.linalg.solve(curved, -prior * x_p / n_p + grad_u / n + RIDGE * theta)
        theta = theta - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < TOLERANCE * max(1.0, np.abs(theta).max()):
            break
    return theta


def class_prior(labels: DataFrame) -> float:
    """Share of positives among labelled documents, kept inside (0.01, 0.99); 0.5 without labels."""
    seen, good = labels.agg(F.count("*"), F.sum("pos")).head()
    return min(0.99, max(0.01, good / seen)) if seen else 0.5


def train(rows: DataFrame, labels: DataFrame, held_out: Column) -> np.ndarray:
    """Fit on featured rows (doc_id, x) with the labels that are not held out."""
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(~held_out)
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("pos"))
    table = rows.join(known.where("pos = 1"), "doc_id", "left").select("x", F.coalesce("pos", F.lit(0)).alias("pos"))
    return fit(written(table, "quality-training"), class_prior(known))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels count only from ids that are not `held_out` (by default the fold
    crc32 mod 3 = 1); a document is a trusted positive if all its labels say 1.
    All texts serve as unlabelled data. Null and empty texts get the score of
    the constant alone. Null ids are never labelled. Repeated rows count and
    come out each. Without positives every score is 0.5. Other columns are
    ignored."""
    out = fold(F.col("doc_id"), 3) == 1 if held_out is None else held_out
    rows = written(_featured(docs), "quality-features")
    theta = train(rows, labels, out)
    weights = F.array(*[F.lit(float(w)) for w in theta])
    z = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return rows.select("doc_id", out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier predicts good, all columns kept. The weights
    are fitted first; then each row is judged by its own text, without a join."""
    theta = train(written(_featured(docs), "quality-features"), labels, fold(F.col("doc_id"), 3) == 1)

    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([float(features(t).astype(np.float64) @ theta) >= 0 for t in texts], dtype=bool)
    return docs.where(F.pandas_udf(good, "boolean")(F.col("text")))
