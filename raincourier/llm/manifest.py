"""Merkle dataset manifest as a postorder append log.

A tree joins every two neighbouring nodes of a level, a last one alone, until one
is left. Aligned builders, each with 2^BITS items in a row, write all nodes below
their own root in the order of completion: a run. The roots of runs are the items
of the next tier, until one run holds the root. In such a log the node over the
items from s on, at height l, with m items below, stands at a position that needs
no index: what was complete before s, 2 s - ones(s), then the other nodes below
it, l + 2 (m - 1) - ones(m - 1). A proof is read from runs by these positions
alone."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raincourier.sources.scratch import written

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RUN = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("nodes", pa.binary()), ("last", pa.binary())])
_PATH = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("path", pa.binary())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string())])
LONE, LEFT, RIGHT = 0, 1, 2  # a path's entry: no sibling, sibling on the left, on the right; 32 bytes follow


@dataclass(frozen=True)
class Manifest:
    """leaves (doc_id, lang, leaf, tree, n, idx, and columns carried along), trees
    (lang, tree, n, subroot), runs of each tier, runs of the trees over the subroots, root in hex."""
    leaves: DataFrame
    trees: DataFrame
    runs: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def before(s: int) -> int:
    """Nodes that are complete before item s, where a run may start."""
    return 2 * s - s.bit_count()


def position(level: int, i: int, n: int) -> int:
    """Place of node i of a level in the log of a tree of n items."""
    s = i << level
    m = min(1 << level, n - s)
    return before(s) + level + before(m - 1)


def height(n: int) -> int:
    return max(n - 1, 0).bit_length()


def run_nodes(items: list[str], top: int) -> list[str]:
    """All nodes over the items, up to one at height `top`, in the order of completion."""
    out, left = [], []
    for i, node in enumerate(items):
        out.append(node)
        while i & 1:
            node, i = digest(left.pop(), node), i >> 1
            out.append(node)
        left.append(node)
    last, m = None, len(items)
    for level in range(top if m < 1 << top else 0):  # close what the last items leave open
        whole = m >> level & 1
        if last is not None:
            last = digest(left.pop(), last) if whole else digest(last)
        elif whole:
            last = digest(left.pop())
        if last is not None:
            out.append(last)
    return out


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column | None = None) -> Column:
    """Digest of a document's fields, with another n_chars if given."""
    return F.unhex(F.sha2(F.concat(*[_encoded(n_chars if f == "n_chars" and n_chars is not None else F.col(f)) for f in FIELDS]), 256))


def _ranged(df: DataFrame, *order) -> DataFrame:
    """Rows dealt to key ranges and written, with the number of their range."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "manifest-ranges")


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, n, idx; trees with lang, tree, n): places counted per key
    range and carried forward, so no task sees a whole language."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    split = _ranged(leaves, *order)
    earlier = lambda *by: W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = split.groupBy("part", "lang").agg(F.count("*").alias("rows"))
    langs = _ranged(counts.groupBy("lang").agg(F.sum("rows").alias("n")), F.col("lang").asc_nulls_first())
    sizes = langs.groupBy("part").agg(F.count("*").alias("c")).select(F.col("part").alias("p"), F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("trees_before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("lang").asc_nulls_first()))
    trees = written(langs.join(sizes, F.col("part") == F.col("p")).select("lang", (F.col("trees_before") + place - 1).cast("long").alias("tree"), "n"), "manifest-trees")
    starts = counts.select(F.col("part").alias("p"), F.col("lang").alias("l"), F.coalesce(F.sum("rows").over(earlier("lang")), F.lit(0)).alias("rows_before"))
    starts = starts.join(trees.withColumnRenamed("lang", "t"), F.col("l").eqNullSafe(F.col("t"))).drop("t")
    inside = F.row_number().over(W.partitionBy("part", "lang").orderBy(*order[1:]))
    numbered = split.join(starts, (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l"))).withColumn("idx", (F.col("rows_before") + inside - 1).cast("long"))
    return numbered.drop("part", "p", "l", "rows_before"), trees


def build_log(items: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Runs of each tier over items (tree, n, idx, digest); a tree's root is the
    last node of its only run in the tier that has one. Tiers follow the tallest tree."""
    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n, first = group.column("n")[0].as_py(), group.column("idx")[0].as_py()
        nodes = run_nodes([d.hex() for d in group.column("digest").to_pylist()], min(bits, height(n)))
        row = [group.column("tree")[0].as_py(), n, first >> bits, before(first), bytes.fromhex("".join(nodes)), bytes.fromhex(nodes[-1])]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _RUN)], schema=_RUN)

    tallest, tiers = height(items.agg(F.max("n")).head()[0] or 0), []
    for _ in range(max(-(-tallest // bits), 1)):
        keyed = items.select("tree", "n", "idx", "digest", F.shiftright("idx", bits).alias("block"))
        runs = keyed.groupBy("tree", "block").applyInArrow(build, "tree long, n long, block long, start long, nodes binary, last binary")
        tiers.append(written(runs, "manifest-runs"))
        items = tiers[-1].where(F.col("n") > 1 << bits).select("tree", F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.col("block").alias("idx"), F.col("last").alias("digest"))
    return tiers


def _roots(tiers: list[DataFrame], bits: int) -> DataFrame:
    found = [runs.where(F.col("n") <= 1 << bits).select("tree", F.col("last").alias("subroot")) for runs in tiers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def build_manifest(docs: DataFrame, carried: dict[str, Column] | None = None, bits: int = BITS) -> Manifest:
    """A tree per lang over the documents in the order of doc_id, and one over the
    trees' roots, null lang first. `carried` are columns kept beside each leaf.

    A null field counts as "-". Null ids come first, rows of one id follow in the
    order of their digests, repeated rows are leaves each. An empty table has no
    root. Other columns do not count."""
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of().alias("leaf"), *[c.alias(name) for name, c in (carried or {}).items()])
    numbered, trees = _numbered(written(leaves, "manifest-digests"))  # dealing to ranges would hash the texts twice
    numbered = written(numbered, "manifest-leaves")
    runs = build_log(numbered.select("tree", "n", "idx", F.col("leaf").alias("digest")), bits)
    trees = written(trees.join(_roots(runs, bits), "tree"), "manifest-roots")
    n_trees = trees.count()
    top = build_log(trees.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")), bits)
    root = _roots(top, bits).head()
    return Manifest(numbered, trees, runs, top, root.subroot.hex() if root else None)


def _levels(nodes: bytes, n_items: int, top: int) -> list[list[str]]:
    """A run's nodes by height, taken from their positions."""
    text = nodes.hex()
    rows = [[position(level, i, n_items) for i in range(-(-n_items >> level))] for level in range(top)]
    return [[text[64 * p:64 * p + 64] for p in row] for row in rows]


def _siblings(levels: list[list[str]], i: int) -> list[tuple[int, str]]:
    """(side, sibling) from the item upwards to the run's root."""
    out = []
    for row in levels:
        other = i ^ 1
        out.append((LEFT if i & 1 else RIGHT, row[other]) if other < len(row) else (LONE, ""))
        i >>= 1
    return out


def _packed(path: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + (bytes.fromhex(node) if side else bytes(32)) for side, node in path)


def _unpacked(path: bytes) -> list[tuple[int, str]]:
    return [(path[at], path[at + 1:at + 33].hex() if path[at] else "") for at in range(0, len(path), 33)]


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for side, other in path:
        node = digest(other, node) if side == LEFT else digest(node, other)
    return node


def _of_run(n: int, block: int, bits: int) -> tuple[int, int]:
    """Items of a run and the height of its root."""
    return min(1 << bits, n - (block << bits)), min(bits, height(n))


def paths(tiers: list[DataFrame], above: DataFrame | None, bits: int) -> DataFrame:
    """(tree, block, path): siblings over each run of the lowest tier, up to the
    root and then on by `above` (tree, path). Each tier hands its paths to the runs
    below, so a node is read by as many rows as it has runs below one tier."""
    def run(batches):
        for batch in batches:
            for tree, n, block, nodes, path in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "block", "nodes", "path")]):
                m, top = _of_run(n, block, bits)
                levels = _levels(nodes, m, top)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * m, pa.int64()), pa.array([(block << bits) + i for i in range(m)], pa.int64()),
                                                  pa.array([_packed(_siblings(levels, i)) + path for i in range(m)], pa.binary())], schema=_PATH)

    lower = None
    for runs in reversed(tiers):
        ended = runs.where(F.col("n") <= 1 << bits).select("tree", "n", "block", "nodes")
        ended = ended.withColumn("path", F.lit(b"")) if above is None else ended.join(above, "tree")
        if lower is not None:
            on = runs.where(F.col("n") > 1 << bits).select("tree", "n", "block", "nodes").join(lower.withColumnRenamed("idx", "block"), ["tree", "block"])
            ended = ended.select("tree", "n", "block", "nodes", "path").unionByName(on.select("tree", "n", "block", "nodes", "path"))
        if runs is tiers[0]:
            return ended
        lower = written(ended.mapInArrow(run, "tree long, idx long, path binary"), "manifest-paths")
    raise ValueError("a log has at least one tier")


def _item_paths(lowest: DataFrame, bits: int) -> DataFrame:
    """(tree, path) of each item of the tree over the trees."""
    def run(batches):
        for batch in batches:
            for n, block, nodes, path in zip(*[batch.column(c).to_pylist() for c in ("n", "block", "nodes", "path")]):
                m, top = _of_run(n, block, bits)
                levels = _levels(nodes, m, top)
                yield pa.RecordBatch.from_arrays([pa.array([(block << bits) + i for i in range(m)], pa.int64()), pa.array([_packed(_siblings(levels, i)) + path for i in range(m)], pa.binary())], names=["tree", "path"])
    return lowest.mapInArrow(run, "tree long, path binary")


def proofs(manifest: Manifest, claimed: str | None = None, bits: int = BITS) -> DataFrame:
    """A row per leaf: doc_id, leaf, subroot, proof (hex siblings from the leaf up
    to the root; levels without one are left out) and folded_root, computed from
    the digest in column `claimed` of the leaves where it is not null, else from the leaf."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PROOF.empty_table()
        n, block, nodes, path, subroot = (right.column(c)[0].as_py() for c in ("n", "block", "nodes", "path", "subroot"))
        m, top = _of_run(n, block, bits)
        levels, rest, rows = _levels(nodes, m, top), _unpacked(path), []
        for doc_id, idx, leaf, claim in zip(*[left.column(c).to_pylist() for c in ("doc_id", "idx", "leaf", "claim")]):
            way = _siblings(levels, idx - (block << bits)) + rest
            rows.append((doc_id, leaf, subroot, [node for side, node in way if side], fold((claim or leaf).hex(), way)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PROOF)], schema=_PROOF)

    over = _item_paths(paths(manifest.top, None, bits), bits)
    runs = paths(manifest.runs, over, bits).join(manifest.trees.select("tree", "subroot"), "tree")
    claim = F.col(claimed) if claimed else F.lit(None).cast("binary")
    leaves = manifest.leaves.select("tree", F.shiftright("idx", bits).alias("block"), "idx", "doc_id", "leaf", claim.alias("claim"))
    rows = leaves.groupBy("tree", "block").cogroup(runs.groupBy("tree", "block")).applyInArrow(run, "doc_id long, leaf binary, subroot binary, proof array<string>, folded_root string")
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    return rows.select("doc_id", hexed("leaf"), hexed("subroot"), "proof", "folded_root")


def verified_manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every document's proof, checked against the root after tampering: where 7
    divides the CRC-32 of the id as text, n_chars counts one more. A null n_chars
    stays, and a row without an id is never tampered with."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    manifest = build_manifest(docs, {"tampered": F.when(hit, leaf_of(F.try_add(F.col("n_chars").cast("long"), F.lit(1))))}, bits)
    root = F.lit(manifest.root)
    return proofs(manifest, "tampered", bits).select("doc_id", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def log_nodes(runs: list[DataFrame], bits: int = BITS) -> DataFrame:
    """The log node by node: (tree, position, level, node, digest), each once, at
    its place in the postorder of the whole tree."""
    def of_tier(tier: int):
        def run(batches):
            for batch in batches:
                for tree, n, block, nodes, real in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "block", "nodes", "n_items")]):
                    m, top = _of_run(n, block, bits)
                    out = []
                    for level in range(1 if tier else 0, top + 1):
                        for i in range(-(-m >> level)):
                            p, node, high = position(level, i, m), (block << bits >> level) + i, tier * bits + level
                            out.append((tree, position(high, node, real), high, node, nodes[32 * p:32 * p + 32].hex()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])] if out else
                                                     [pa.array([], t) for t in [pa.int64()] * 4 + [pa.string()]], names=["tree", "position", "level", "node", "digest"])
        return run
    real = runs[0].where("block = 0").select("tree", F.col("n").alias("n_items"))
    parts = [tier.join(real, "tree").mapInArrow(of_tier(t), "tree long, position long, level long, node long, digest string") for t, tier in enumerate(runs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
