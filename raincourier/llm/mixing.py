"""Source mixing: temperature weights, realised as budgeted block permutations."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raincourier.sources.scratch import written

BLOCK_TOKENS = 1_000_000
MOST_BLOCKS = 100_000
LEVELS, PASSES = 6, 6
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """exponent of the temperature, entropy it reaches (nats), the entropy asked for, budget in tokens."""
    exponent: float
    entropy: float
    target: float
    budget: int


def _at(shares: DataFrame, exponents: list[float]) -> list[dict]:
    """Entropy and highest repetition of the mix at each exponent: one aggregation, one row per exponent."""
    rows = (shares.select("share", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(exponents)])).alias("e"))
            .select(F.col("e.k").alias("k"), F.pow("share", F.col("e.a")).alias("w"), F.log("share").alias("l"), F.pow("share", F.col("e.a") - 1).alias("r"))
            .groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("wl"), F.max("r").alias("r"), F.count("*").alias("n")).collect())
    return [{"entropy": math.log(r.z) - exponents[r.k] * r.wl / r.z, "repeats": r.r / r.z, "sources": r.n} for r in sorted(rows, key=lambda r: r.k)]


def fit_exponent(shares: DataFrame, entropy_gain: float, most_repeats: float) -> tuple[float, float, float]:
    """The exponent in [0, 1] nearest 0 that keeps the entropy at or below the
    target and no source repeated more than `most_repeats` times: (exponent,
    entropy, target). Target: that share of the way from natural to uniform entropy.

    Entropy and repetition both fall as the exponent rises, so bisection finds
    it; each job answers six levels of it at once over the source table."""
    ends = _at(shares, [0.0, 1.0])
    if not ends:
        return 1.0, 0.0, 0.0
    target = ends[1]["entropy"] + entropy_gain * (ends[0]["entropy"] - ends[1]["entropy"])
    fits = lambda x: x["entropy"] <= target + 1e-12 and x["repeats"] <= most_repeats
    if fits(ends[0]):
        return 0.0, ends[0]["entropy"], target
    low, high, reached = 0.0, 1.0, ends[1]["entropy"]
    for _ in range(PASSES):
        n = 2 ** LEVELS
        grid = [low + (high - low) * k / n for k in range(1, n)]
        values, a, b = _at(shares, grid), 0, n
        while b - a > 1:
            mid = (a + b) // 2
            if fits(values[mid - 1]):
                b, reached = mid, values[mid - 1]["entropy"]
            else:
                a = mid
        low, high = (low if a == 0 else grid[a - 1]), (high if b == n else grid[b - 1])
    return high, reached, target


def mix_sources(docs: DataFrame, budget: int | None = None, entropy_gain: float = 0.5, most_repeats: float = 4.0, seed: int = 7,
                block_tokens: int = BLOCK_TOKENS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, Mix]:
    """The mixture as rows (doc_id, source, epoch, block, slot, n_tokens), and its figures.

    Token shares raised to one exponent give the weights; a source's budget is
    its weight times `budget` (all tokens if not given). A source is repeated
    whole as often as its budget holds, then once more in part. Documents are
    dealt to blocks by hash; every pass (`epoch`) has a block order of its own, and in
    each block a document order of its own. The partial pass takes whole blocks in
    its order and the last one up to the document that no longer fits. Sorting
    by `slot` (0 to 1) interleaves the sources in proportion.

    Blocks hold about `block_tokens` tokens. A source has at most `most_blocks` of
    them, since their order is worked out over all blocks of a source together:
    with more than `block_tokens` times `most_blocks` tokens in all (10^11 by default) blocks grow instead.

    Tokens are words. Null and empty texts have none: they go with their block
    where their source is taken. A null source is one source of its own, shown
    as null. A source without tokens has no weight and gives no rows. The hash is
    of id and text, so rows without an id, or with one id and many texts, are
    spread over blocks; equal rows each count and share a block. Other columns are ignored."""
    n_tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    lean = written(docs.select("doc_id", "source", n_tokens.alias("n_tokens"), F.xxhash64("text").alias("content")), "mixing-docs")
    totals = lean.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    whole = totals.agg(F.sum("tokens")).head()[0] or 0
    budget = whole if budget is None else budget
    sources = written(totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1)))), "mixing-sources")
    exponent, entropy, target = fit_exponent(sources, entropy_gain, most_repeats * whole / budget if budget else most_repeats)
    z = sources.agg(F.sum(F.pow("share", F.lit(exponent)))).head()[0] or 1.0
    size = max(block_tokens, -(-whole // most_blocks))
    plan = sources.select(F.col("source").alias("s"), "tokens", F.round(F.pow("share", F.lit(exponent)) / z * budget).cast("long").alias("budget"),
                          F.ceil(F.col("tokens") / size).cast("long").alias("blocks"))
    plan = plan.withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    dealt = (lean.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "content")).drop("content")
             .withColumn("block", F.pmod("h", F.col("blocks"))))
    # Blocks are few and of bounded size: their order and running totals in each pass, then a running total inside the one block that is cut.
    sums = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest"), F.first("full").alias("full"))
    passes = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "full")))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("null")), "epoch", "block"), "block")
    before = F.sum("in_block").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_block")
    state = (passes.withColumn("turn", F.row_number().over(turn) - 1).withColumn("before", before)
             .withColumn("taken", F.when(F.col("epoch") < F.col("full"), 1).when(F.col("rest") == 0, -1)
                         .when(F.col("before") + F.col("in_block") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 0).otherwise(-1))
             .where("taken >= 0").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "turn", "before", "taken"))
    placed = (dealt.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
              .withColumn("order", F.pmod(F.xxhash64("h", F.lit(seed), "epoch"), F.lit(1 << 40))))
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("taken = 0").withColumn("sofar", F.col("before") + F.sum("n_tokens").over(inside)).where("sofar <= rest").drop("sofar")
    inner = (F.col("turn") + F.col("order") / float(1 << 40)) / F.col("blocks")
    slot = (F.col("epoch") + inner) * F.col("tokens") / F.greatest(F.col("budget"), F.lit(1))
    rows = placed.where("taken = 1").unionByName(cut).select("doc_id", "source", "epoch", "block", slot.alias("slot"), "n_tokens")
    return rows, Mix(exponent, entropy, target, int(budget))
