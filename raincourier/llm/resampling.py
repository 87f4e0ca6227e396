"""Importance resampling towards a target corpus, by bit-sliced aggregation.

A document is the counts of its hashed n-grams over a fixed number of buckets.
Bit i of all its counts makes one plane of as many bits as there are buckets;
bit j of all gains, in two's complement, makes another. Two planes ANDed and
their ones counted give the number of buckets that have both bits, and the sum
of these numbers times 2^(i+j), the sign bit's negative, is the exact weight."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raincourier.sources.scratch import written

BUCKETS, LONGEST, SCALE = 10_000, 3, 1000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
DOCS_AT_ONCE, BYTES_AT_ONCE = 256, 4_000_000
_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
# Words up to so many bytes are hashed together, column by column; longer ones one by one.
_SHORT = 128
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


class Crc:
    """CRC-32 of many byte strings at once. The CRC of A followed by B is the CRC
    of A, moved on by the length of B, xor the CRC of B. Moving on is linear: four
    tables of 256 entries do it, kept for every length up to _SHORT + 1 and for
    every power of two."""

    def __init__(self):
        self.table = _byte_table()
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = self.table[bits & 255] ^ (bits >> np.uint32(8))  # each bit moved on by a byte
        lengths = [self._tables(bits)]
        for _ in range(_SHORT + 1):
            bits = self.table[bits & 255] ^ (bits >> np.uint32(8))
            lengths.append(self._tables(bits))
        self.by_length, self.by_power = np.array(lengths), []
        for _ in range(40):
            self.by_power.append(self._tables(one))
            one = self._through(self.by_power[-1], one)

    @staticmethod
    def _tables(images: np.ndarray) -> np.ndarray:
        """Four tables of 256 entries from the images of the 32 single bits."""
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte, 1 << bit:2 << bit] = out[byte, :1 << bit] ^ images[8 * byte + bit]
        return out

    @staticmethod
    def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]

    def moved(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC moved on by its own number of bytes."""
        small = lengths <= _SHORT + 1
        at = np.where(small, lengths, 0)
        out = self.by_length[at, 0, crc & 255] ^ self.by_length[at, 1, (crc >> 8) & 255] ^ self.by_length[at, 2, (crc >> 16) & 255] ^ self.by_length[at, 3, crc >> 24]
        far = np.flatnonzero(~small)
        for k in range(int(lengths[far].max()).bit_length() if len(far) else 0):
            hit = far[(lengths[far] >> k) & 1 == 1]
            out[hit] = self._through(self.by_power[k], out[hit])
        return out

    def of_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
        at, left = starts[order], sizes[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        longer = int(np.count_nonzero(left > _SHORT))
        at, left, part = at[longer:], left[longer:], crc[longer:]
        for k in range(_SHORT):
            n = int(np.searchsorted(-left, -k))
            if not n:
                break
            part[:n] = self.table[(part[:n] ^ data[at[:n] + k]) & 255] ^ (part[:n] >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        for k in range(longer):
            word = order[k]
            crc[k] = zlib.crc32(data[starts[word]:starts[word] + sizes[word]])
        out = np.empty(len(order), np.uint32)
        out[order] = crc
        return out


_CRC = Crc()


class Counts:
    """Features of some texts: `words` and `features` per text, and the distinct
    (text, bucket) pairs, as text * buckets + bucket, with their counts."""

    def __init__(self, texts: list[str], buckets: int = BUCKETS, longest: int = LONGEST):
        raws = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        edge = np.diff(np.concatenate([[False], _IS_WORD[data], [False]]).astype(np.int8))
        starts = np.flatnonzero(edge == 1)
        sizes = np.flatnonzero(edge == -1) - starts
        bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))])
        self.words = np.diff(bounds)
        doc = np.repeat(np.arange(len(raws)), self.words)
        word = _CRC.of_words(data, starts, sizes)
        spaced = _CRC.moved(np.full(len(word), zlib.crc32(b" "), np.uint32), sizes) ^ word
        grams, keys = word, []
        self.features = np.zeros(len(raws), np.int64)
        for n in range(1, longest + 1):
            if n > 1:  # every run of n words inside one text: its first n - 1 and the last
                inside = np.flatnonzero(doc[:len(grams) - 1] == doc[n - 1:]) if len(grams) else np.zeros(0, np.int64)
                grams = _CRC.moved(grams[:-1], sizes[n - 1:] + 1) ^ spaced[n - 1:] if len(grams) else grams
                keys.append(doc[inside] * buckets + grams[inside] % buckets)
            else:
                keys.append(doc * buckets + grams % buckets)
            self.features += np.maximum(self.words - n + 1, 0)
        pairs = np.concatenate(keys)
        dense = np.bincount(pairs, minlength=len(raws) * buckets)
        self.pairs = np.flatnonzero(dense)
        self.counts = dense[self.pairs]
        self.n, self.buckets = len(raws), buckets

    def by_bucket(self) -> np.ndarray:
        return np.bincount(self.pairs % self.buckets, weights=self.counts, minlength=self.buckets).astype(np.int64)

    def planes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bit i that occurs: i, the texts that have it, and their planes
        as rows of 64-bit words."""
        width = -(-self.buckets // 64) * 8
        text, bucket = self.pairs // self.buckets, self.pairs % self.buckets
        for i in range(int(self.counts.max()).bit_length() if len(self.counts) else 0):
            hit = (self.counts >> i) & 1 == 1
            texts, row = np.unique(text[hit], return_inverse=True)
            place = row * width + (bucket[hit] >> 3)
            plane = np.bincount(place, weights=(1 << (bucket[hit] & 7)).astype(float), minlength=len(texts) * width).astype(np.uint8)
            yield i, texts, plane.reshape(-1, width).view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Gains in two's complement: the value of each bit, the last one negative,
    and its plane over all buckets."""
    bits = max(int(np.abs(gains).max()).bit_length(), 1)
    width = -(-len(gains) // 64) * 8
    planes = np.zeros((bits + 1, width), np.uint8)
    for j in range(bits + 1):
        packed = np.packbits(((gains >> j) & 1).astype(np.uint8), bitorder="little")
        planes[j, :len(packed)] = packed
    return [1 << j for j in range(bits)] + [-(1 << bits)], planes.view(np.uint64)


def weights(counts: Counts, values: list[int], gains: np.ndarray) -> np.ndarray:
    out = np.zeros(counts.n, np.int64)
    for i, texts, plane in counts.planes():
        for value, gain in zip(values, gains):
            out[texts] += (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << i) * value
    return out


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in groups of bounded size, and their texts, empty for null."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[at] - sizes[at] + BYTES_AT_ONCE, side="right"))
            stop = min(max(at + 1, fits), at + DOCS_AT_ONCE)
            part = batch.slice(at, stop - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = stop


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sums its own
    texts before anything is shuffled; the driver gets one row per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            total += Counts(texts, buckets, longest).by_bucket()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for row in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of target and raw, rounded down."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(scale * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _noise(doc_id: Column, seed: int, scale: int) -> Column:
    """Gumbel noise of an id: the same in every run. A null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document with (doc_id, n_words, n_features, weight, score, rank); the
    drawn ones, the highest scores, are ranked from 1.

    `percent` of the documents with at least `least_words` words are drawn,
    rounded down; a tie goes to the smaller id, then to fewer features. Null and
    empty texts have no features and weight 0. Null ids come first and share one
    noise; repeated rows are drawn each for itself. Other columns are ignored. An
    empty target gives gains from raw counts alone, an empty table no rows."""
    raw, wanted = bucket_counts(docs, buckets), bucket_counts(target, buckets)
    values, planes = gain_planes(bucket_gains(raw, wanted))

    def run(batches):
        for part, texts in _texts(batches, 1):
            counts = Counts(texts, buckets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.words, pa.int64()), pa.array(counts.features, pa.int64()), pa.array(weights(counts, values, planes), pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = flat.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed, SCALE)).withColumn("able", F.col("n_words") >= least_words)
    # Ranks without a window over all rows: key ranges written once, counted, and numbered each for itself.
    scored = written(scored, "resampling-scores")  # dealing to ranges would read the texts twice
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    ranged = written(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampled")
    sizes = ranged.groupBy("part").agg(F.count_if("able").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per range
    drawn = (ranged.agg(F.count_if("able")).head()[0] * percent) // 100
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    out = ranged.join(F.broadcast(before), "part").withColumn("rank", rank)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
