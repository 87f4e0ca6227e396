"""Packs of documents, and a census of hashed keys over them.

A pack is one row that holds some thousand texts as compressed Arrow data. Per
pack the keys of all its texts are reduced to distinct ones with one number
each, so that a key shared by any number of texts leaves a pack once. Key ranges
meet in Spark groups of bounded size, and what they find goes back to the packs
that asked. Keys travel as differences in sorted order, some six bytes each."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.sources.scratch import written

PACK_BYTES = 3 << 20
RANGE_KEYS = 1_000_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every `width` neighbouring numbers. Widths
    double while they fit, then the rest is added one by one."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    level, size, power = points, 1, _BASE
    while 2 * size <= width:
        level = level[:-size] * power + level[size:]
        size, power = 2 * size, np.uint64(int(power) ** 2 % (1 << 64))
    for extra in range(size, width):
        level = level[:len(points) - extra] * _BASE + points[extra:]
    return mixed(level)


def word_hashes(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text and their start bytes. A hash
    is a polynomial over the bytes, mixed with the length."""
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~_IS_BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = stops - starts
    powers = np.ones(int(sizes.max()) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    picked = data[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(picked)) - np.repeat(first, sizes)
    sums = np.add.reduceat(picked * powers[within], first)
    return mixed(sums + sizes.astype(np.uint64) * _MIX), starts


class Pack:
    """The texts of a pack, joined by line ends, with word hashes of all."""

    def __init__(self, body: bytes, lower: bool = False):
        batch = pa.ipc.open_stream(body).read_next_batch()
        self.ids, self.texts = batch.column(0), batch.column(1)
        raws = [(t.as_py() or "").encode() for t in self.texts]
        self.raws = raws
        self.words, self.starts = word_hashes(b"\n".join(raws), lower)
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows of `width` words inside one text, the number of
        the text, and the window's first word counted over the pack."""
        h = rolling(self.words, width)
        doc = np.repeat(np.arange(len(self.raws)), self.sizes)
        whole = np.flatnonzero(doc[:len(h)] == doc[width - 1:]) if len(h) else np.zeros(0, np.int64)
        return h[whole], doc[whole], whole


def make_packs(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Documents as a written table of packs: pack, n_docs, n_bytes, body. Ids
    are cast to long; a null or repeated id keeps its row. A text beyond the
    size of a pack is a pack of its own."""
    def run(batches):
        seq, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            batch = table.to_batches()[0]
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_batch(batch)
            return pa.RecordBatch.from_pydict({"pack": pa.array([seq], pa.int64()), "n_docs": pa.array([batch.num_rows], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
                                               "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + pack_bytes - size, side="right")))
                stop = min(stop, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - base
                at = stop
                if size >= pack_bytes or at < batch.num_rows:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(flat.mapInArrow(run, "pack long, n_docs long, n_bytes long, body binary"), "packs")


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of a few bytes each. The width is the
    cheapest; a difference that needs more stands as 0 and in a list beside."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, rest = steps[:1], steps[1:]
    costs = [k * len(rest) + 8 * np.count_nonzero(rest >> np.uint64(8 * k)) if k < 8 else 8 * len(rest) for k in range(1, 9)]
    size = 1 + int(np.argmin(costs))
    wide = rest[(rest >> np.uint64(8 * size)) > 0] if size < 8 else rest[:0]
    if len(wide):
        rest = np.where((rest >> np.uint64(8 * size)) > 0, np.uint64(0), rest)
    return np.array([size, len(wide)], np.uint32).tobytes() + first.tobytes() + wide.tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unsqueezed(blob: bytes) -> np.ndarray:
    size, n_wide = np.frombuffer(blob, np.uint32, 2).tolist()
    first, wide = np.frombuffer(blob, np.uint64, 1, 8), np.frombuffer(blob, np.uint64, n_wide, 16)
    narrow_ = np.frombuffer(blob, np.uint8, offset=16 + 8 * n_wide).reshape(-1, size)
    full = np.zeros((len(narrow_), 8), np.uint8)
    full[:, :size] = narrow_
    rest = full.view(np.uint64).ravel()
    if n_wide:
        rest[rest == 0] = wide
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers as a base and offsets of the fewest bytes (1, 2, 4 or 8)."""
    base = int(values.min()) if len(values) else 0
    top = int(values.max()) - base if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + np.int64(base).tobytes() + (values - base).astype(kind).tobytes()


def unnarrow(blob: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]]
    return np.frombuffer(blob, kind, offset=9).astype(np.int64) + np.frombuffer(blob, np.int64, 1, 1)[0]


_SENT = pa.schema([("key_range", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
_BACK = pa.schema([("pack", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])


def census(packs: DataFrame, of_pack: Callable[[bytes], tuple[np.ndarray, np.ndarray]],
           decide: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], keys_per_byte: float = 0.2,
           totals: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Answers to the packs: rows (pack, keys, numbers).

    `of_pack(body)` gives the sorted distinct keys of a pack and a number for
    each. `decide(keys, numbers, starts)` sees the entries of one key range
    sorted by key, equal keys side by side from `starts` on, and returns a mask
    of the entries that get an answer and the answers. `totals`, if given, adds
    a row of pack -1 per range with its sums. The number of ranges follows the
    input, so a group's size does not."""
    spark = packs.sparkSession
    total = packs.agg(F.sum("n_bytes")).head()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * keys_per_byte) // RANGE_KEYS, 1)
    width = (1 << 64) // ranges + 1
    limits = np.array([k * width for k in range(1, ranges)], dtype=np.uint64)

    def send(batches):
        for batch in batches:
            for pack, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, numbers = of_pack(body.as_py())
                cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
                full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pack] * len(full), pa.int64()),
                                                  pa.array([squeezed(keys[cuts[k]:cuts[k + 1]]) for k in full], pa.binary()),
                                                  pa.array([narrow(numbers[cuts[k]:cuts[k + 1]]) for k in full], pa.binary())], schema=_SENT)

    def meet(table: pa.Table) -> pa.Table:
        lists = [unsqueezed(b.as_py()) for b in table.column("keys")]
        packs_in = np.repeat(np.asarray(table.column("pack")), [len(k) for k in lists])
        keys, numbers = np.concatenate(lists), np.concatenate([unnarrow(b.as_py()) for b in table.column("numbers")])
        order = np.argsort(keys, kind="stable")
        keys, numbers, packs_in = keys[order], numbers[order], packs_in[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        mask, answers = decide(keys, numbers, starts)
        sums = (-1, b"", narrow(totals(keys, numbers, starts))) if totals else ()
        keys, packs_in = keys[mask], packs_in[mask]
        order = np.argsort(packs_in, kind="stable")
        keys, packs_in, answers = keys[order], packs_in[order], answers[order]
        edges = np.flatnonzero(np.concatenate([[True], packs_in[1:] != packs_in[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(keys))
        back = [packs_in[edges].tolist(), [squeezed(keys[a:b]) for a, b in zip(edges, ends)], [narrow(answers[a:b]) for a, b in zip(edges, ends)]]
        for column, value in zip(back, sums):
            column.append(value)
        return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(back, _BACK)], schema=_BACK)

    sent = packs.select("pack", "body").mapInArrow(send, "key_range long, pack long, keys binary, numbers binary")
    return sent.groupBy("key_range").applyInArrow(meet, "pack long, keys binary, numbers binary")


def with_answers(packs: DataFrame, answers: DataFrame, finish: Callable[[bytes, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Bring a pack and its answers together: `finish(body, keys, numbers)` with
    the keys sorted gives the rows of the pack."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        keys = [unsqueezed(b.as_py()) for b in right.column("keys")]
        numbers = [unnarrow(b.as_py()) for b in right.column("numbers")]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        order = np.argsort(keys)
        return pa.Table.from_batches(finish(left.column("body")[0].as_py(), keys[order], numbers[order]), schema=arrow)
    return packs.select("pack", "body").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among sorted keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
