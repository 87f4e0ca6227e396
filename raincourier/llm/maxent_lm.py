"""Language model: a hashed maximum-entropy model with a class-factored softmax.

A token is a path of three choices among 16: its class and its member of the
class, by its shape, and its cell, by its hash. The last factor is the token's
smoothed share in its cell, counted over all training texts:
P(class | context) * P(member | class, context) * P(cell | member, context) * share.
Each choice is log-linear in hashed features of its context: the previous token,
the one before it (a skip) and both. A choice below the first has weights of its
own for each choice above it.

Weights are trained by gradient steps inside each task and averaged, each row over
the tasks that met it and by how often they did, so a rare row is
not thinned out. Each kind of feature has 8 * V^(1/3) rows, V distinct training
tokens, so the model grows with the corpus, yet fits into a task and its changes stay small beside
the text it read: a billion distinct tokens make 8 000 rows a kind, 51 MB. Token
counts stay in Spark, whatever V is.

Scores depend on a text alone: equal texts score equally, learned from or held out."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourier.llm.packs import Pack, census, find, make_packs, mixed, unnarrow, with_answers
from raincourier.sources.scratch import written

FAN = 16  # choices at each of the three levels
SLOTS, CELLS = FAN ** 2, FAN ** 3
KINDS = 3
BATCH, RATE, ROUNDS, PIECE, MERGED = 16_384, 0.3, 1, 1_024, 64
ROW_FACTOR = 8.0
END = np.uint64(0xC0FFEE00000000F0)  # key of the end token; its slot is the first of the last class
_START = np.uint64(7)
_LOW, _CELL = np.uint64(255), np.uint64(CELLS - 1)
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                  ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None, parts: int = 7, part: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == part


def slots(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Slot (class * 16 + member) of each word from its length and last two bytes; class 15 is kept for the end."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    after = np.searchsorted(blank, starts)
    stops = np.where(after < len(blank), blank[np.minimum(after, len(blank) - 1)], len(data)) if len(blank) else np.full(len(starts), len(data))
    size, last = stops - starts, data[stops - 1].astype(np.int64)
    before = np.where(size > 1, data[np.maximum(stops - 2, 0)], 0).astype(np.int64)
    lower = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)
    last, before = lower(last), lower(before)
    by_size = 5 + np.minimum(9, np.searchsorted([2, 3, 4, 5, 6, 8, 10, 13, 17], size))
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    kind = np.where(last == 46, 0, np.where(last == 44, 1, np.where((last >= 48) & (last <= 57), 2, np.where(letter, by_size, 3))))
    kind = np.where((last == 33) | (last == 63), 4, kind)
    return kind * FAN + (mixed((last * 256 + before).astype(np.uint64)) % np.uint64(FAN)).astype(np.int64)


class Tokens:
    """Tokens of a pack in order, each text closed by the end token: keys whose
    low byte is the slot and whose next four bits are the cell in it."""

    def __init__(self, body: bytes):
        pack = Pack(body, lower=True)
        keys = (pack.words & ~_LOW) | slots(b"\n".join(pack.raws), pack.starts).astype(np.uint64)
        n, sizes = len(pack.raws), pack.sizes
        self.ids = pack.ids.to_pylist()
        self.bounds = pack.bounds + np.arange(n + 1)
        self.keys = np.full(len(keys) + n, END, np.uint64)
        self.keys[np.arange(len(keys)) + np.repeat(np.arange(n), sizes)] = keys
        self.doc = np.repeat(np.arange(n), sizes + 1)
        self.train = ~np.array([held_out(i) for i in self.ids], bool)

    def back(self, k: int) -> np.ndarray:
        out = np.full(len(self.keys), _START)
        out[k:] = np.where(self.doc[k:] == self.doc[:-k], self.keys[:-k], _START)
        return out

    def contexts(self) -> np.ndarray:
        """Hashes of the three features of each token: previous, skip, both."""
        one, two = self.back(1), self.back(2)
        return np.stack([mixed(one), mixed(two + np.uint64(1)), mixed(one * np.uint64(0x9E3779B97F4A7C15) + two)])

    @property
    def cells(self) -> np.ndarray:
        return (self.keys & _CELL).astype(np.int64)


def n_rows(distinct: int, factor: float = ROW_FACTOR) -> int:
    """Rows of each kind of feature for that many distinct training tokens."""
    return max(1, round(factor * distinct ** (1 / 3)))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """In place. Rows are only centred where their exponentials leave the range of the type."""
    ones = np.ones(FAN, x.dtype)
    total = np.exp(x) @ ones if x.size and x.max() < 60 else np.zeros(len(x), x.dtype)
    if x.size and total.min() < 1e-30:
        x -= x.max(axis=1, keepdims=True)
        total = np.exp(x) @ ones
    x -= np.log(total)[:, None]
    return x


def _sum_of(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = weights.take(places[0], axis=0)
    for rows in places[1:]:
        out += weights.take(rows, axis=0)
    return out


class Model:
    """Sixteen weights for each row of each level. The first row of a level, or the
    first for each choice above it, is the constant's; then come those of the kinds."""

    def __init__(self, rows: int, flat: np.ndarray):
        self.rows = rows
        self.sizes = [1 + KINDS * rows, FAN * (1 + KINDS * rows), SLOTS + FAN * KINDS * rows]
        ends = np.cumsum([0, *self.sizes]) * FAN
        self.levels = [flat[a:b].astype(np.float32).reshape(-1, FAN) for a, b in zip(ends[:-1], ends[1:])]

    @staticmethod
    def size(rows: int) -> int:
        return FAN * (1 + FAN + SLOTS + KINDS * rows * (1 + 2 * FAN))

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.levels])

    def places(self, contexts: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        """Rows of the four features at each level, a row of numbers per feature."""
        slot, kind = cells % SLOTS, cells % SLOTS // FAN
        own = (contexts % np.uint64(self.rows)).astype(np.int64)
        first, second, third = [np.zeros(len(cells), np.int64)], [kind], [slot]
        for k in range(KINDS):
            row = 1 + k * self.rows + own[k]
            first.append(row)
            second.append(row * FAN + kind)
            joint = mixed(contexts[k] + (slot.astype(np.uint64) << np.uint64(32)))
            third.append(SLOTS + k * FAN * self.rows + (joint % np.uint64(FAN * self.rows)).astype(np.int64))
        return [np.stack(x) for x in (first, second, third)]

    def logs(self, places: list[np.ndarray]) -> list[np.ndarray]:
        """Natural logs of the sixteen probabilities at each level."""
        return [_log_softmax(_sum_of(w, at)) for w, at in zip(self.levels, places)]

    def score(self, contexts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Natural log of P(cell | context), batch by batch."""
        out = np.zeros(len(cells))
        for a in range(0, len(cells), BATCH):
            part = cells[a:a + BATCH]
            at = np.arange(len(part))
            for log, choice in zip(self.logs(self.places(contexts[:, a:a + BATCH], part)), choices(part)):
                out[a:a + BATCH] += log[at, choice]
        return out

    def gradients(self, contexts: np.ndarray, cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the loss, the negative log probability: per level the rows of the
        features and each token's gradient by choice, which is that of all its rows."""
        places, out = self.places(contexts, cells), []
        for log, at, choice in zip(self.logs(places), places, choices(cells)):
            np.exp(log, out=log)
            log[np.arange(len(cells)), choice] -= 1
            out.append((at, log))
        return out

    def learn(self, contexts: np.ndarray, cells: np.ndarray, seen: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of gradient steps; `seen` holds each weight's squared gradients
        and, in a last column, how often its row was met."""
        for a in range(0, len(cells), BATCH):
            for weights, held, (places, grad) in zip(self.levels, seen, self.gradients(contexts[:, a:a + BATCH], cells[a:a + BATCH])):
                for rows in places:
                    _step(weights, held, rows, grad, rate)


def choices(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return cells % SLOTS // FAN, cells % FAN, cells // SLOTS


def ranked(rows: np.ndarray) -> np.ndarray:
    """Stable order of row numbers; numpy sorts 16 bits at a time by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    for shift in range(16, int(rows.max()).bit_length(), 16):
        order = order[np.argsort((rows[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def by_row(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each is met, and the sum of its gradients."""
    order = ranked(rows)
    own = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[starts], np.diff(np.append(starts, len(own))), np.add.reduceat(grad.take(order, axis=0), starts, axis=0)


def _step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Sum a batch's gradients by row, then scale each by its history."""
    hit, times, total = by_row(rows, grad)
    total /= np.float32(np.sqrt(BATCH))
    held = seen.take(hit, axis=0)
    held[:, :FAN] += total * total
    held[:, FAN] += times
    seen[hit] = held
    weights[hit] -= np.float32(rate) * total / np.sqrt(held[:, :FAN] + np.float32(1e-4))


def first_weights(counts: np.ndarray, rows: int) -> np.ndarray:
    """The model of cell counts alone: it sits in the constant's rows."""
    model = Model(rows, np.zeros(Model.size(rows), np.float32))
    by_cell = counts.reshape(FAN, SLOTS).T.reshape(FAN, FAN, FAN) + 1.0  # class, member, cell
    shares = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    model.levels[0][0] = shares(by_cell.sum(axis=(1, 2)))
    model.levels[1][:FAN] = shares(by_cell.sum(axis=2))
    model.levels[2][:SLOTS] = shares(by_cell).reshape(SLOTS, FAN)
    return model.flat()


def train_round(packs: DataFrame, flat: np.ndarray, rows: int, rate: float = RATE) -> np.ndarray:
    """Every task learns from its packs, starting at `flat`. Changes of rows,
    weighted by how often a task met the row, are added up piece by piece, some
    tasks at a time; the driver gets one model, however many tasks there were."""
    spark = packs.sparkSession
    shared = spark.sparkContext.broadcast(flat)
    tasks = packs.rdd.getNumPartitions()

    def learn(batches):
        model = Model(rows, shared.value)
        seen = [np.zeros((len(w), FAN + 1), np.float32) for w in model.levels]
        for batch in batches:
            for body in batch.column(0):
                tokens = Tokens(body.as_py())
                use = tokens.train[tokens.doc]
                model.learn(tokens.contexts()[:, use], tokens.cells[use], seen, rate)
        met = np.concatenate([x[:, FAN:] for x in seen])
        change = np.hstack([(model.flat() - shared.value).reshape(-1, FAN) * met, met]).astype(np.float32)
        pieces = [(k, change[a:a + PIECE]) for k, a in enumerate(range(0, len(change), PIECE))]
        pieces = [(k, p.tobytes()) for k, p in pieces if p[:, FAN].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int64()),
                                          pa.array([p for _, p in pieces], pa.binary())], ["piece", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in table.column("sums")).astype(np.float32)
        first = table.slice(0, 1)
        return pa.Table.from_arrays([first.column("piece").combine_chunks(), pa.array([first.column("task")[0].as_py() // MERGED], pa.int64()),
                                     pa.array([total.tobytes()], pa.binary())], ["piece", "task", "sums"])

    schema = "piece int, task long, sums binary"
    sums = packs.select("body").mapInArrow(learn, schema)
    while tasks > 0:
        sums = sums.groupBy("piece", F.expr(f"task div {MERGED}")).applyInArrow(add, schema)
        tasks //= MERGED
    out = flat.reshape(-1, FAN).copy()
    for r in sums.collect():
        change = np.frombuffer(r.sums, np.float32).reshape(-1, FAN + 1)
        out[r.piece * PIECE:r.piece * PIECE + len(change)] += change[:, :FAN] / np.maximum(change[:, FAN:], 1)
    return out.ravel()


def score_texts(docs: DataFrame, rounds: int = ROUNDS, row_factor: float = ROW_FACTOR) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text with its end).

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2; a null id counts
    as empty text there. Null and empty texts are the end token alone. Repeated
    rows count and come out each. With nothing to learn from, every token is
    unknown and the model is uniform over cells. Token keys have 56 hash bits and
    8 slot bits. Other columns are ignored."""
    packs = make_packs(docs)

    def of_pack(body):
        tokens = Tokens(body)
        keys, number = np.unique(tokens.keys, return_inverse=True)
        return keys, np.bincount(number, weights=tokens.train[tokens.doc], minlength=len(keys)).astype(np.int64)

    def decide(keys, numbers, starts):
        total = np.add.reduceat(numbers, starts)
        return np.ones(len(keys), bool), np.repeat(total, np.diff(np.append(starts, len(keys))))

    def totals(keys, numbers, starts):
        total, cell = np.add.reduceat(numbers, starts), (keys[starts] & _CELL).astype(np.int64)
        return np.concatenate([np.bincount(cell, weights=total, minlength=CELLS), np.bincount(cell[total > 0], minlength=CELLS)]).astype(np.int64)

    answers = written(census(packs, of_pack, decide, keys_per_byte=0.05, totals=totals), "token-counts")

    def add_up(batches):
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += unnarrow(b.as_py())
        yield pa.RecordBatch.from_pydict({"k": np.arange(2 * CELLS, dtype=np.int32), "v": total})
    sums = np.zeros(2 * CELLS, np.int64)
    for r in answers.where("pack = -1").select("numbers").mapInArrow(add_up, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r.k] = r.v
    by_cell, distinct = sums[:CELLS], sums[CELLS:]
    n_train, n_distinct = int(by_cell.sum()), int(distinct.sum())
    rows = n_rows(n_distinct, row_factor)
    flat = first_weights(by_cell, rows)
    for k in range(rounds if n_train else 0):
        flat = train_round(packs, flat, rows, RATE / (1 + k) ** 2)
    shared = docs.sparkSession.sparkContext.broadcast(flat)
    floor = np.log10(by_cell + distinct + 1.0)

    def finish(body, keys, counts):
        tokens = Tokens(body)
        at = find(keys, tokens.keys)
        count = np.where(at >= 0, counts[np.maximum(at, 0)], 0) if len(counts) else np.zeros(len(at), np.int64)
        own = np.log10(count + 1.0)
        log = Model(rows, shared.value).score(tokens.contexts(), tokens.cells) / np.log(10) + own - floor[tokens.cells]
        edges = tokens.bounds[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(tokens.ids, pa.int64()), pa.array(~tokens.train), pa.array(np.diff(tokens.bounds)), pa.array(np.add.reduceat((count > 0).astype(np.int64), edges)),
                                          pa.array(np.full(len(edges), n_train)), pa.array(np.add.reduceat(own - np.log10(n_train + n_distinct + 1.0), edges)),
                                          pa.array(np.add.reduceat(log, edges))], schema=_OUT)

    return with_answers(packs, answers.where("pack >= 0"), finish,
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", _OUT)
