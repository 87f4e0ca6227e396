"""URL filter: path rules first, then a weighted vocabulary found by Aho-Corasick."""
from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourier.llm.base import LOWER, UPPER, ascii_lower

# The rules of the contract, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"))
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "warez", "hentai", "phishing")
SOFT = ("adult", "bet", "bonus", "cheap", "deal", "farm", "free", "hot", "loan", "pills", "poker", "sexy", "spam", "win")
SOFT_LIMIT = 2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word(term, (k, len(term)))
    machine.make_automaton()
    return machine


_FOLD = str.maketrans(UPPER, LOWER)
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def distinct_hits(url: str | None, terms: tuple[str, ...]) -> set[int]:
    """Numbers of the terms that occur with no ASCII letter or digit on either side."""
    if not url:
        return set()
    text, found = url.translate(_FOLD), set()
    for end, (k, size) in _automaton(terms).iter(text):
        start = end - size + 1
        if (start == 0 or text[start - 1] not in _INNER) and (end + 1 == len(text) or text[end + 1] not in _INNER):
            found.add(k)
    return found


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft
    (distinct terms of each list).

    The longest fitting rule decides; of rules of equal length the one that
    blocks. Without a rule one strict or `soft_limit` distinct soft terms block.
    A null or empty url, or one without "://", has empty host and path and no
    rule; vocabulary still applies to its text. Ids may be null or repeated
    (one row each); other columns are ignored."""
    terms = tuple(dict.fromkeys([*strict, *soft]))
    n_strict_terms = len(set(strict))

    def hits(urls: pd.Series) -> pd.DataFrame:
        found = [distinct_hits(u, terms) for u in urls]
        strict_hits = [sum(k < n_strict_terms for k in f) for f in found]
        return pd.DataFrame({"n_strict": strict_hits, "n_soft": [len(f) - s for f, s in zip(found, strict_hits)]}).astype("int64")

    count = F.pandas_udf(hits, "n_strict long, n_soft long")
    host, path = split_url(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"), count(F.col("url")).alias("_hits"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    bad = (F.col("_hits.n_strict") >= 1) | (F.col("_hits.n_soft") >= soft_limit)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                      F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"))
