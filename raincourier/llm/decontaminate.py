"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of length L with at most k edits shares at least
L - q + 1 - k*q of its q-grams, all within k + 1 neighbouring diagonals. q is 8,
and for short items the largest at which at least one is certain. Shared
q-grams are counted in overlapping diagonal bands, bands that reach the bound
are kept and verified by a banded alignment.

Memory for a text is bounded: hits are counted slice by slice and bands that
no later position can reach are closed. Items that repeat a q-gram often are
counted by text positions instead of pairs of positions, and bands over equal
stretches of a text are aligned once."""
from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, EDIT_RATE = 8, 0.1
BLOCK_CHARS = 4_000_000
FEW = 4  # places of one q-gram in an item, beyond which the item counts as repetitive
SLICE = 1 << 19  # pairs of a text position and an item place that are looked at together
REMEMBERED = 4_096  # alignments of a text kept for equal stretches
_FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> np.ndarray:
    """Code points with A-Z lowered and ASCII blanks made spaces; positions stay."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q neighbouring code points: widths double while
    they fit, then the rest is added point by point."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    points = codes.astype(np.uint64) + np.uint64(1)
    level, width, power = points, 1, _BASE
    while 2 * width <= q:
        level = level[:-width] * power + level[width:]
        width, power = 2 * width, np.uint64(int(power) ** 2 % (1 << 64))
    for extra in range(width, q):
        level = level[:len(points) - extra] * _BASE + points[extra:]
    return level ^ (level >> np.uint64(29))


def _sized(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of grams of different sizes kept apart."""
    return hashes ^ np.uint64(q * int(_BASE) % (1 << 64))


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes, and for each the items and
    positions that have it; a repetitive item stands once for each hash, without position."""
    sizes: list
    ids: list
    texts: list
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bloom: np.ndarray
    short: list
    repetitive: np.ndarray
    lengths: np.ndarray


def build_index(items: list[tuple], q: int = Q, rate: float = EDIT_RATE) -> Index:
    texts = [normal(t) for _, t in items]
    sizes = np.array([len(t) for t in texts], np.int64)
    edits = np.maximum(0, np.minimum((rate * sizes).astype(np.int64), sizes - 1))
    # The largest q for which at least one shared q-gram is certain; below q characters without edits an item is looked up as it is.
    fit = np.where(edits > 0, np.clip(sizes // (edits + 1), 1, q), q)
    hashes = [_sized(gram_hashes(t, k), k) for t, k in zip(texts, fit.tolist())]
    grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes]).astype(np.int64)
    place = np.concatenate([np.arange(len(h)) for h in hashes]).astype(np.int64) if hashes else np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    grams, item, place = grams[order], item[order], place[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
    heads = np.flatnonzero(first)
    repetitive = np.zeros(len(texts), bool)
    repetitive[item[heads[np.diff(np.append(heads, len(grams))) > FEW]]] = True
    use = first | ~repetitive[item]
    grams, item, place = grams[use], item[use], np.where(repetitive[item[use]], 0, place[use])
    unique, starts = np.unique(grams, return_index=True)
    bloom = np.zeros(1 << _FILTER_BITS, bool)
    bloom[(unique * _BASE) >> np.uint64(64 - _FILTER_BITS)] = True
    short = [k for k, n in enumerate(sizes) if 0 < n < fit[k]]
    return Index(np.unique(fit).tolist(), [i for i, _ in items], texts, edits, sizes - fit + 1 - edits * fit, unique, np.append(starts, len(grams)), item, place, bloom, short, repetitive, sizes)


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best occurrence of `item` in `doc` whose path stays on diagonals low to
    high (document minus item position): (edits, start, end), or None beyond
    `most` edits. Rows run over the item; cost and start travel in one number."""
    width = high - low + 1
    unit, far = np.int64(1) << np.int64(40), np.int64(1) << np.int64(60)
    at = np.arange(low, high + 1, dtype=np.int64)
    row = np.where((at >= 0) & (at <= len(doc)), np.clip(at, 0, None), far)
    climb = np.arange(width, dtype=np.int64) * unit
    for i, char in enumerate(item):
        j = at + i
        inside = (j >= 0) & (j < len(doc))
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside]] == char
        take = np.where(inside, row + np.where(same, 0, unit), far)
        drop = np.append(row[1:] + unit, far)
        new = np.minimum(take, drop)
        new = np.where((j + 1 >= 0) & (j + 1 <= len(doc)), new, far)
        row = np.minimum.accumulate(new - climb) + climb
        row = np.where((j + 1 >= 0) & (j + 1 <= len(doc)), row, far)
    best = int(np.argmin(row))
    cost, start = int(row[best] >> 40), int(row[best] & (unit - 1))
    return (cost, start, int(at[best]) + len(item)) if cost <= most else None


def _hits(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Text positions, in order, whose q-gram some item has, and its number in the index."""
    ats, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q in index.sizes if len(index.grams) else ():
        hashes = _sized(gram_hashes(codes, q), q)
        at = np.flatnonzero(index.bloom[(hashes * _BASE) >> np.uint64(64 - _FILTER_BITS)])
        slot = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
        real = index.grams[slot] == hashes[at]
        ats.append(at[real])
        slots.append(slot[real])
    at, slot = np.concatenate(ats), np.concatenate(slots)
    order = np.argsort(at, kind="stable")
    return at[order], slot[order]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _by_pairs(at, n, starts, item, place, index: Index, length: int):
    """Bands that reach their bound by pairs of text position and item place:
    (item number, band, median diagonal). Band b holds the diagonals of steps b
    and b + 1. What reaches it is counted once more, each item place once."""
    sizes = index.lengths
    shift = sizes.max() + 2
    span = np.int64(length) + 2 * shift  # bands run from -longest - 1 to the text's length
    step = index.edits + 1
    upto = np.cumsum(n)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(SLICE, upto[-1] if len(upto) else 0, SLICE)) + 1, [len(n)]]))
    keys, counts = np.zeros(0, np.int64), np.zeros(0)
    for a, b in zip(cuts[:-1], cuts[1:]):
        entry, pos = _runs(starts[a:b], n[a:b]), np.repeat(at[a:b], n[a:b])
        t, diagonal = item[entry], pos - place[entry]
        key = t * span + diagonal // step[t] + shift
        whole, where = np.unique(np.concatenate([keys, key, key - 1]), return_inverse=True)
        ones = np.ones(len(key))
        counts = np.bincount(where, np.concatenate([counts, ones, ones]), len(whole))
        keys = whole
        t, band = keys // span, keys % span - shift
        closed = np.full(len(keys), True) if b == len(n) else (band + 2) * step[t] + sizes[t] - 2 < at[b]
        for k in np.flatnonzero(closed & (counts >= index.need[t])):
            low, high = band[k] * step[t[k]], (band[k] + 2) * step[t[k]]
            near = slice(*np.searchsorted(at, (low, high + sizes[t[k]] - 1)))
            entry, pos = _runs(starts[near], n[near]), np.repeat(at[near], n[near])
            own, lag = place[entry], pos - place[entry]
            inside = (item[entry] == t[k]) & (lag >= low) & (lag < high)
            if len(np.unique(own[inside])) >= index.need[t[k]]:
                yield int(t[k]), int(band[k]), int(np.median(lag[inside]))
        keys, counts = keys[~closed], counts[~closed]


def _by_positions(at: np.ndarray, t: int, index: Index):
    """Bands of a repetitive item that enough of its text positions can lie in."""
    step, size = int(index.edits[t]) + 1, len(index.texts[t])
    band = np.arange((int(at[0]) - size) // step - 1, int(at[-1]) // step + 1)
    inside = np.searchsorted(at, (band + 2) * step + size - 1) - np.searchsorted(at, band * step)
    for b in band[inside >= index.need[t]].tolist():
        yield t, b, -1


def _bands(codes: np.ndarray, index: Index):
    """(item number, band, likely diagonal or -1) of every band that reaches its bound."""
    at, slot = _hits(codes, index)
    if not len(at):
        return
    own, where, times = np.unique(slot, return_inverse=True, return_counts=True)
    n = index.starts[own + 1] - index.starts[own]
    entry, gram = _runs(index.starts[own], n), np.repeat(np.arange(len(own)), n)
    item = index.item[entry]
    # No band of an item can reach its bound if all of the text's hits together do not.
    able = np.bincount(item, times[gram], len(index.need)) >= index.need
    if not able[item].any():
        return
    pairs = able[item] & ~index.repetitive[item]
    n = np.bincount(gram[pairs], minlength=len(own))
    starts = np.cumsum(n) - n
    hit = n[where] > 0
    yield from _by_pairs(at[hit], n[where][hit], starts[where][hit], item[pairs], index.place[entry[pairs]], index, len(codes))
    rest = able[item] & index.repetitive[item]
    item, gram = item[rest], gram[rest]
    order = np.argsort(item, kind="stable")
    item, gram = item[order], gram[order]
    for a, b in zip(edges := np.flatnonzero(np.diff(item, prepend=-1)), np.append(edges[1:], len(item))):
        mine = np.zeros(len(own), bool)
        mine[gram[a:b]] = True
        yield from _by_positions(at[mine[where]], int(item[a]), index)


def matches(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits): for each item its best occurrences,
    overlapping ones of the same item once."""
    codes = normal(text)
    found: set[tuple[int, int, int, int]] = set()
    known: dict = {}
    for t, b, start in _bands(codes, index):
        item, most = index.texts[t], int(index.edits[t])
        if start >= 0 and np.array_equal(codes[start:start + len(item)], item):
            found.add((t, start, start + len(item), 0))
            continue
        low, high = b * (most + 1) - most, (b + 2) * (most + 1) - 1 + most
        a, z = max(low, 0), min(high + len(item), len(codes))
        # Inside the text the outcome depends on the stretch alone.
        key = (t, codes[a:z].tobytes()) if low >= 0 and z == high + len(item) else None
        if key is None or key not in known:
            hit = align(item, codes[a:z], low - a, high - a, most)
            if key is not None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = hit
        else:
            hit = known[key]
        if hit:
            found.add((t, hit[1] + a, hit[2] + a, hit[0]))
    if index.short:
        plain = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for t in index.short:
            word = index.texts[t].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            start = plain.find(word)
            while start >= 0:
                found.add((t, start, start + len(word), 0))
                start = plain.find(word, start + len(word))
    kept: list[tuple[int, int, int, int]] = []
    taken: dict[int, tuple[list[int], list[int]]] = {}  # by item, starts and ends of what is kept, in order
    for t, start, end, cost in sorted(found, key=lambda m: (m[0], m[3], m[1], m[2])):
        begins, ends_ = taken.setdefault(t, ([], []))
        before = bisect_left(begins, end)
        if before and ends_[before - 1] > start:
            continue
        begins.insert(before, start)
        ends_.insert(before, end)
        kept.append((t, start, end, cost))
    return sorted(kept)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Items with a text, in blocks of bounded size, so that a benchmark of any
    size passes the driver piece by piece."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null and text <> ''").distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """Occurrences of benchmark items: doc_id, item_id, start, stop (code
    points), edits; up to `rate` of an item's length in edits, after ASCII case
    and blanks are levelled.

    Null and empty texts and items match nothing; items too short for an edit
    must occur exactly. Repeated rows of documents come out each, repeated items
    once; null ids stay null. Other columns are ignored. Blocks of a large
    benchmark are searched one after another."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, start long, stop long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(block, rate=rate))

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if t.is_valid for m in matches(t.as_py(), index)]
                if rows:
                    d, t, start, stop, edits = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(d, batch.column(0).type), pa.array([index.ids[k] for k in t]), pa.array(start), pa.array(stop), pa.array(edits)],
                                                     ["doc_id", "item_id", "start", "stop", "edits"])
        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(search, schema))
    return out


def _clean(shared):
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not (t and matches(t, shared.value)) for t in texts], dtype=bool)
    return F.pandas_udf(clean, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of documents whose text holds no benchmark item; all columns stay.
    Each row is judged by its own text, so null and repeated ids do no harm.
    Null and empty texts are kept, repeated rows share one verdict, without
    documents or items the rows stay as they are."""
    out = docs
    for block in item_blocks(benchmark):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast(build_index(block, rate=rate)))(F.col("text")))
    return out
