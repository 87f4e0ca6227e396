"""Secret scan: known shapes by pattern, unknown ones by sliding-window entropy.

Everything is a column expression. Positions of matches come from the texts
between them, so no row leaves its document."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourier.llm.base import let

# Fixed values: (kind, pattern, captured part that is measured, its least length), in the order used for ties.
BASE = (("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]{32,}", 0, 32))  # runs are maximal, so the least length may stand in the pattern
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.9
# Strings that look random but are no secrets: one-case words, numbers, UUIDs, placeholders, paths whose parts have one case or one leading capital.
# No group is repeated, so a match needs neither a deep stack nor many tries however long the string is.
ALLOWED = (r"^[a-z_/=-]+$", r"^[A-Z_/=-]+$", r"^[A-Z]?[a-z]+$", r"^[0-9_/=-]+$", r"(?i)example|placeholder|changeme|xxxx|your[_-]?",
           r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^(?![_=-])(?!.*(//|[_=-]{2}|/[_=-]|[a-z][A-Z]|[A-Z]{2}[a-z]))[A-Za-z/_=-]+$")
_SPAN = "array<struct<start:int,kind:int,name:string,stop:int>>"


def _located(text: Column, pattern: str, kept) -> Column:
    """Spans of all matches for which `kept(matches, number of match)` holds."""
    def spans(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(gaps, i))
                stop = start + F.length(F.get(found, i))
                return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(i.alias("i"), start.alias("start"), stop.alias("stop")))).alias("out"))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,start:int,stop:int>>").alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step)["out"]
        return F.filter(let(F.split(text, pattern, -1), walk), lambda s: kept(found, s["i"]))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _term(n: Column) -> Column:
    """n * log2(n), 0 for 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(token: Column, width: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any `width` neighbouring characters.
    The sum of n*log2(n) over character counts is carried along: one count rises
    and one falls at each step."""
    def count(text: Column, char: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, char, F.lit("")))

    def step(acc: Column, char: Column) -> Column:
        def entered(char: Column) -> Column:
            n = count(acc["win"], char)
            return F.struct(F.concat(acc["win"], char).alias("win"), (acc["sum"] + _term(n + 1) - _term(n)).alias("sum"))

        def left(s: Column) -> Column:
            first = F.substring(s["win"], 1, 1)
            n = count(s["win"], first)
            return F.when(
                F.length(s["win"]) > width, F.struct(s["win"].substr(F.lit(2), F.lit(width)).alias("win"), (s["sum"] - _term(n) + _term(n - 1)).alias("sum"))).otherwise(s)

        def rated(s: Column) -> Column:
            bits = F.lit(math.log2(width)) - s["sum"] / width
            return F.struct(s["win"].alias("win"), s["sum"].alias("sum"), F.when(F.length(s["win"]) == width, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))
        return let(let(entered(char), left), rated)

    zero = F.struct(F.lit("").alias("win"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(F.split(token, ""), zero, step)["best"]


def _random(token: Column) -> Column:
    """Is a candidate string random for its character class and not allow-listed?"""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | token.rlike(pattern)
    need = F.when(token.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(token) >= need)


def _named(spans: Column, name: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), F.lit(name).alias("name"), s["stop"].alias("stop")))


def find_secrets(text: Column) -> Column:
    """Struct of two span arrays, base and added; a span has start, kind, name,
    stop in code points, the end exclusive, ordered by start and kind."""
    none, base = F.array().cast(_SPAN), []
    for order, (name, pattern, part, least) in enumerate(BASE):
        if part:
            kept = lambda found, i, p=pattern, g=part, n=least: F.length(F.regexp_extract(F.get(found, i), p, g)) >= n
        else:
            kept = lambda found, i, n=least: F.length(F.get(found, i)) >= n
        base.append(F.when(text.rlike(pattern), _named(_located(text, pattern, kept), name, order)).otherwise(none))
    added = F.when(text.rlike(CANDIDATE), _named(_located(text, CANDIDATE, lambda found, i: _random(F.get(found, i))), "entropy", len(BASE))).otherwise(none)
    return F.struct(F.sort_array(F.concat(*base)).cast(_SPAN).alias("base"), added.cast(_SPAN).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added spans (arrays).

    Null and empty texts have no spans. Null and repeated ids give one row each.
    Other columns are ignored."""
    return docs.select("doc_id", find_secrets(F.coalesce(F.col("text"), F.lit(""))).alias("s")).select("doc_id", "s.base", "s.added")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of `text` replaced by `mask`;
    overlapping spans count as one. A null text stays null."""
    def masked(spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(
                acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"))
        end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
        return let(end, lambda e: F.concat(e["out"], F.col("text").substr(e["at"] + 1, F.length("text"))))
    found = let(find_secrets(F.col("text")), lambda s: F.sort_array(F.concat(s["base"], s["added"])))
    clean = let(found, lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
