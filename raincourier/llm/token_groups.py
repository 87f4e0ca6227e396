"""N-gram Jaccard join with a token-group matrix.

Equal shingle sets are one class. A census tells each class which of its
shingles others have; the rarest few of a set suffice to meet every possible
partner, and classes that share none of those are done. The rest is partitioned
into groups of similar documents, by links to the most central document that
shares a rare shingle. A matrix of rare shingles against groups then proposes
groups of other components to each document; a group is opened only if the
document's overlap with the union of the group's shingles reaches the least
overlap a link needs."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.llm.base import checked_broadcast
from raincourier.llm.components import components
from raincourier.llm.packs import Pack, census, find, make_packs, mixed, rolling, with_answers, word_hashes
from raincourier.sources.scratch import written

WIDTH, PERCENT, GROUP, GROUP_SHINGLES = 4, 85, 64, 1_000_000
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n", pa.int64()), ("digest", pa.binary()), ("central", pa.float64()), ("rare", pa.list_(pa.int64())), ("body", pa.binary())])


def _short(words: np.ndarray) -> np.uint64:
    """The one shingle of a text with fewer words than a window."""
    h = np.array([len(words)], np.uint64)
    for w in words:
        h = mixed(h + w)
    return h[0]


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a lower-cased text."""
    words, _ = word_hashes(raw)
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(rolling(words, width)) if len(words) >= width else np.array([_short(words)], np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(pack: Pack, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct (document, shingle) in order, and a digest of each document's set."""
    h, doc, _ = pack.windows(width)
    few = np.flatnonzero((pack.sizes > 0) & (pack.sizes < width))
    if len(few):
        h = np.concatenate([h, np.array([_short(pack.words[pack.bounds[k]:pack.bounds[k + 1]]) for k in few], np.uint64)])
        doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    cuts = np.searchsorted(doc, np.arange(len(pack.raws) + 1))
    return h, doc, [hashlib.blake2b(h[cuts[k]:cuts[k + 1]].tobytes(), digest_size=16).digest() for k in range(len(pack.raws))]


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Written rows (doc_id, text_key, n, digest, central, rare, body): digest of
    the text, set size, set digest, mean rank of its shingles by spread, its rare shingles that other
    sets have, and, where there are any, the packed text."""
    packs = make_packs(docs)

    def of_pack(body):
        h, doc, digests = _sets(Pack(body, lower=True), width)
        seen: set[bytes] = set()
        first = np.array([not (d in seen or seen.add(d)) for d in digests], bool)
        return np.unique(h[first[doc]], return_counts=True) if len(h) else (h, np.zeros(0, np.int64))

    def decide(keys, numbers, starts):
        total = np.repeat(np.add.reduceat(numbers, starts), np.diff(np.append(starts, len(keys)))) if len(keys) else numbers
        mask = total >= 2
        return mask, np.minimum(255, (8 * np.log2(total[mask])).astype(np.int64))

    def finish(body, keys, numbers):
        pack, press = Pack(body, lower=True), zstandard.ZstdCompressor(level=3)
        h, doc, digests = _sets(pack, width)
        at = find(keys, h)
        spread = np.where(at >= 0, numbers[np.maximum(at, 0)], 0) if len(numbers) else np.zeros(len(h), np.int64)
        n = np.bincount(doc, minlength=len(pack.raws))
        central = np.bincount(doc, weights=spread, minlength=len(pack.raws)) / np.maximum(n, 1)
        order = np.lexsort((h, spread, doc))
        starts = np.cumsum(n) - n
        place = np.arange(len(h)) - starts[doc]
        need = n - (-(-percent * n // 100)) + 1
        picked = order[(place < need[doc]) & (spread[order] > 0)]
        cuts = np.searchsorted(doc[picked], np.arange(len(pack.raws) + 1))
        own = h[picked].view(np.int64)
        rows = []
        for k, raw in enumerate(pack.raws):
            rare = own[cuts[k]:cuts[k + 1]]
            rows.append((pack.ids[k].as_py(), hashlib.md5(raw, usedforsecurity=False).hexdigest(), int(n[k]), digests[k], float(central[k]), rare,
                         press.compress(raw.translate(_FOLD)) if len(rare) else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return written(with_answers(packs, census(packs, of_pack, decide), finish, "doc_id long, text_key string, n long, digest binary, central double, rare array<long>, body binary", _OUT), "shingle-sets")


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (a, b) whose sets are linked."""
    bodies = nodes.select("node", "body")
    rows = (pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("text_a")), "a")
            .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep, last, held = [], None, None
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if b != last:
                    last, held = b, shingles(open_(y))
                keep.append(linked(shingles(open_(x)), held, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return rows.mapInArrow(run, "a long, b long")


def _overlaps(asking: list[np.ndarray], held: list[np.ndarray], percent: int):
    """(number asking, number held) of linked sets. A set is compared with the
    held ones, all at once, only if its overlap with their union allows a link."""
    owner = np.repeat(np.arange(len(held)), [len(s) for s in held])
    tokens = np.concatenate(held)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(s) for s in held])
    for k, own in enumerate(asking):
        left, right = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        if 100 * np.count_nonzero(right > left) < percent * len(own):
            continue
        n = right - left
        at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(held))
        for m in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)):
            yield k, int(m)


def _open_groups(proposed: DataFrame, placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links between components (a, b) found in pairs of groups (g, h)."""
    member = F.struct("comp", "body")
    blobs = placed.select("node", "comp", "group").join(nodes.select("node", "body"), "node").groupBy("group").agg(F.collect_list(member).alias("members"))
    left, right = blobs.select(F.col("group").alias("g"), F.col("members").alias("asking")), blobs.select(F.col("group").alias("h"), F.col("members").alias("held"))
    rows = proposed.join(left, "g").join(right, "h").select("asking", "held")

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = set()
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.as_py(), y.as_py()
                for k, m in _overlaps([shingles(open_(r["body"])) for r in x], [shingles(open_(r["body"])) for r in y], percent):
                    if x[k]["comp"] != y[m]["comp"]:
                        out.add((x[k]["comp"], y[m]["comp"]))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def _similar(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, digest) that may have partners, and their components (node, comp)."""
    nodes = written(sets.where(F.size("rare") > 0).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "central", "rare", "body")])
                    .withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    rare = nodes.select("node", "n", "central", F.explode("rare").alias("t"))
    # 1. Everyone meets the most central document among those that share a rare shingle.
    pivots = (rare.groupBy("t").agg(F.max(F.struct("central", "node", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
              .select("t", F.col("p.node").alias("b"), F.col("p.central").alias("weight"), F.col("p.n").alias("m")))
    met = written(rare.join(pivots, "t").groupBy("node", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("weight").alias("weight")), "shingle-met")
    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    stars = met.where((F.col("node") != F.col("b")) & near).select(F.col("node").alias("a"), "b")
    first = written(components(_verify(stars, nodes, percent)), "shingle-components")
    # 2. Groups of similar documents: parts of one component, or small components around the same central document.
    hubs = met.groupBy("node").agg(F.max(F.struct("weight", "b")).alias("h")).select("node", F.col("h.b").alias("hub"))
    placed = nodes.select("node", "n", "rare").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(hubs, "node", "left")
    # Only what is large is looked up, a 64th of the documents at most, so that a large component is not dealt to one task.
    large = placed.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= GROUP)
    placed = placed.join(checked_broadcast(large), "comp", "left").withColumn("base", F.when(F.col("size").isNotNull(), F.concat(F.lit("c"), F.col("comp").cast("string"))).otherwise(
        F.concat(F.lit("h"), F.coalesce("hub", "node").cast("string"))))
    split = (placed.groupBy("base").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("long").alias("parts"))
             .where("parts > 1"))
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    placed = written(placed.join(checked_broadcast(split), "base", "left").select("node", "n", "rare", "comp", F.concat_ws(":", "base", chunk.cast("string")).alias("group")), "shingle-groups")
    # 3. Token-group matrix. Pairs of groups that share a rare shingle, fit in size and span components are opened.
    about = placed.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    # Groups inside one component need no comparison with each other. Of the component with most groups around a shingle
    # only pairs with other groups are made, so that a large group of linked copies costs its size, not its square.
    matrix = placed.select("group", F.explode("rare").alias("t")).distinct().join(about, "group")
    pure = F.when(F.col("low") == F.col("high"), F.col("low"))
    per_comp = matrix.groupBy("t", pure.alias("comp")).agg(F.count("*").alias("c"))
    main = (per_comp.groupBy("t").agg(F.sum("c").alias("c"), F.max(F.when(F.col("comp").isNotNull(), F.struct("c", "comp"))).alias("m"))
            .where("m is null or c > m.c").where("c > 1").select("t", F.col("m.comp").alias("main")))
    matrix = written(matrix.join(main, "t").withColumn("in_main", F.coalesce(pure == F.col("main"), F.lit(False))).drop("main"), "shingle-matrix")
    other = matrix.select("t", *[F.col(c).alias(f"{c}_h") for c in ("group", "low", "high", "least", "most", "in_main")])
    fits = (100 * F.col("most") >= percent * F.col("least_h")) & (100 * F.col("most_h") >= percent * F.col("least"))
    mixed_pair = ~((F.col("low") == F.col("high_h")) & (F.col("high") == F.col("low_h")))
    once = F.col("in_main_h") | (F.col("group") < F.col("group_h"))
    proposed = (matrix.where("not in_main").join(other, "t").where(once & fits & mixed_pair)
                .select(F.least("group", "group_h").alias("g"), F.greatest("group", "group_h").alias("h")).distinct())
    inside = about.where("low <> high").select(F.col("group").alias("g"), F.col("group").alias("h"))
    proposed = written(proposed.unionAll(inside), "shingle-proposed")
    merged = components(_open_groups(proposed, placed, nodes, percent).distinct()).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    return nodes.select("node", "digest"), placed.select("node", "comp").join(merged, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))


def _named(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_key, n, part (the same for all of a component), component."""
    sets = described(docs, width, percent)
    nodes, comps = _similar(sets, percent)
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"))
    joined = classes.join(nodes, "digest", "left").join(comps, "node", "left")
    lows = joined.where("comp is not null").groupBy("comp").agg(F.min("low").alias("least"))
    names = joined.join(lows, "comp", "left").select(F.col("digest").alias("d"), F.coalesce(F.concat(F.lit("c"), F.hex("comp")), F.hex("digest")).alias("part"),
                                                     F.coalesce("least", "low").alias("component"))
    out = sets.select("doc_id", "text_key", "n", "digest").join(names, (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "text_key", "n", "part", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id
    reachable by links, its own included).

    Null and blank texts have no shingles and no links. Repeated rows are copies
    of each other and come out each. A row without an id takes part in links but
    gives no component its name; a component of such rows alone has none. Other
    columns are ignored."""
    return _named(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of documents that name their component, all columns kept. Rows
    that share an id are judged by their own texts, and one of them names a
    component. Rows without an id stay beside a row with one; of a component of
    such rows alone one stays. Blank texts stay, once for each id and text."""
    found = written(_named(docs, width, percent), "near-copies")
    gone = found.where("component is not null and doc_id <> component").select("doc_id").distinct()
    out = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    alone = found.where("component is null and n > 0")
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    if not twice.isEmpty():
        twice = checked_broadcast(twice)
        own = found.join(twice, "doc_id", "left_semi").where("doc_id = component")
        stay = own.where("n > 0").groupBy("doc_id").agg(F.min("text_key").alias("k")).unionByName(own.where("n = 0").select("doc_id", F.col("text_key").alias("k")).distinct())
        rows = docs.join(twice, "doc_id", "left_semi").select(docs.columns)
        stay = stay.select(F.col("doc_id").alias("own_id"), F.col("k").alias("own_key"))
        rows = rows.join(stay, (rows["doc_id"] == F.col("own_id")) & (key == F.col("own_key")), "left_semi")
        out = out.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(rows.dropDuplicates(["doc_id", "text"]))
    if not alone.isEmpty():
        least = alone.groupBy("part").agg(F.min("text_key").alias("own_key")).select("own_key")
        every = alone.select(F.col("text_key").alias("own_key")).distinct()
        rows, nameless = out.where("doc_id is null"), key == F.col("own_key")
        one = rows.join(least, nameless, "left_semi").dropDuplicates(["text"])
        out = out.where("doc_id is not null").unionByName(rows.join(every, nameless, "left_anti")).unionByName(one)
    return out
