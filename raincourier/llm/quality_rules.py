"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over a fixed number of hash buckets are counted, one over the
trusted documents and one over all. A document's score is the mean log ratio of
its words and word pairs; every document is held against one threshold."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourier.llm.base import checked_broadcast, let, words_of

BUCKETS = 16_384
THRESHOLD = -0.05
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def _bucket(*words: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of words and word pairs by bucket; combined before the shuffle."""
    words = docs.select(words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    pairs = words.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("a", "b"))
    grams = pairs.select(F.explode(F.array(_bucket(F.col("a"), buckets=buckets),
                                           F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b"), buckets=buckets)))).alias("bucket"))
    return grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p_trusted / p_raw) for each bucket, add-one smoothed. Trusted are the
    documents whose labels all say quality 1. The driver gets `buckets` numbers,
    whatever the input."""
    trusted = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    target = docs.select("doc_id", "text").join(checked_broadcast(trusted), "doc_id", "left_semi")
    rows = (_counts(docs, buckets).withColumn("side", F.lit(0)).unionAll(_counts(target, buckets).withColumn("side", F.lit(1)))
            .groupBy("bucket").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("raw"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("good"))
            .collect())
    raw, good = [1] * buckets, [1] * buckets
    for r in rows:
        raw[r.bucket] += r.raw or 0
        good[r.bucket] += r.good or 0
    n_raw, n_good = sum(raw), sum(good)
    return [math.log(g / n_good) - math.log(r / n_raw) for g, r in zip(good, raw)]


def _repeat_words(w: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Only texts with
    a repeated window are sorted; positions come from neighbours in hash order."""
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        repeated = let(ranked, lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda e, j: F.when(
            (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["p"])), lambda p: p.isNotNull()), lambda p: p)))
        return let(repeated, lambda ps: F.aggregate(F.transform(ps, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(ps, j + 1), p + 3) - p)),
                                                    F.lit(0), lambda a, x: a + x))

    return F.when(n >= 3, let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))).otherwise(F.lit(0))


def _mean_ratio(w: Column, n: Column, table: Column, buckets: int) -> Column:
    def add(total: Column, i: Column) -> Column:
        single = F.get(table, _bucket(F.get(w, i), buckets=buckets))
        pair = F.when(i + 1 < n, F.get(table, _bucket(F.get(w, i), F.get(w, i + 1), buckets=buckets))).otherwise(F.lit(0.0))
        return total + single + pair
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add) / (2 * n - 1)).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.

    Null and blank texts have no words, fail the base rule and score 0. Null and
    repeated ids give one row each; labels of unknown ids are ignored, and with
    no trusted document the ratio is that of the smoothing alone. Other columns
    are ignored."""
    ratios = log_ratios(docs, labels, buckets)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(words_of(F.col("text")), lambda w: let(F.size(w), lambda n: F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w, n).cast("long").alias("n_repeat_words"), _mean_ratio(w, n, table, buckets).alias("score"))))
    out = docs.select("doc_id", facts.alias("f"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                      let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    failed = (F.col("f.n_words") < MIN_WORDS) | (100 * F.col("f.n_repeat_words") > MAX_REPEAT_PCT * F.col("f.n_words"))
    return out.select("doc_id", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", failed.alias("base_failed"),
                      (~failed & (F.col("f.score") >= threshold)).alias("kept"), "f.score")
