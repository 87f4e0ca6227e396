"""Best-fit packing: documents as token ids, laid into sequences of fixed length.

A task packs the rows of its partition as they come, by bounded-space best fit:
at most `open_bins` sequences are open, one bit per amount of free space says
which amounts are on offer, and the lowest bit that is high enough names the
tightest sequence. When all are taken the fullest closes. A place is final as
soon as it is given, so a task holds no sequence, only the look-ahead, and
nothing is shuffled."""
from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 1024, 2
OPEN_BINS, LOOKAHEAD = 4096, 4096
MOST_FORMS = 800_000


def _forms(letters: str, numbers: str, blanks: str) -> re.Pattern:
    """What the tokenizer's rule takes for one form, among characters it knows the classes of."""
    return re.compile(rf" ?[{letters}]+| ?[{numbers}]+|'(?:[sdmt]|ll|ve|re)| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


# The classes up to U+007F and U+024F. Texts with other characters go to the tokenizer as a whole.
_ASCII = _forms("A-Za-z", "0-9", r"\t-\r ")
_LATIN = _forms(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")
_OTHER = re.compile(r"[^\x00-\u024f]")
_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    where it is printable, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Forms(dict):
    """Ids of word forms, found by the tokenizer's model where they are new."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, form: str) -> bytes:
        tokens = self.model.tokenize(form.encode().decode("latin-1").translate(self.letters))
        ids = self[form] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers. The tokenizer's
    model sees a word form once and the result is remembered, for some MOST_FORMS
    forms. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forms = _Forms(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        known = _ASCII if text.isascii() else _LATIN
        if known is _LATIN and _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.forms) > MOST_FORMS:
            self.forms.clear()
        return b"".join(map(self.forms.__getitem__, known.findall(text)))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, with the forms its earlier tasks met."""
    return Encoder(path)


class Bins:
    """Open sequences: a bit per amount of free space, and a stack of sequences
    behind each bit. A sequence's number, and its fill as `capacity` less its free
    space, are all that is kept of it."""

    def __init__(self, capacity: int, most: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.free, self.stacks, self.n_open = 0, [[] for _ in range(capacity + 1)], 0

    def _take(self, space: int) -> int:
        number = self.stacks[space].pop()
        if not self.stacks[space]:
            self.free ^= 1 << space
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of an item of 1 to `capacity` tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number, self.next = self.capacity, self.next, self.next + 1
            if length < self.capacity:
                if self.n_open == self.most:
                    self._take((self.free & -self.free).bit_length() - 1)
                else:
                    self.n_open += 1
        left = space - length
        if left:
            if not self.stacks[left]:
                self.free |= 1 << left
            self.stacks[left].append(number)
        elif length < self.capacity:
            self.n_open -= 1
        return number, self.capacity - space


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids, sequence_id, offset): `ids` holds
    the tokens as little-endian unsigned 32-bit numbers.

    A document is its text's ids and `end_id`. Only one longer than `capacity` is
    cut: what is over stands in its first piece, the others fill a sequence each.
    `lookahead` items of a partition are known at a time and offered largest first
    (1: strictly as they come). Each partition packs for itself and leaves up to
    `open_bins` sequences short at its end; its result depends on its rows and
    their order alone, so a repeated task gives the same places.

    Null and empty texts are the end id alone. Null and repeated ids keep their
    rows. An empty table gives none. Other columns are ignored."""
    path = path or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, bins = encoder_of(path), Bins(capacity, open_bins, TaskContext.get().partitionId() << 33)
        held: list[tuple] = []

        def rows(items):
            placed = [(*item, *bins.place(item[3])) for item in items]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*placed), _OUT)], schema=_OUT)

        def waiting(least):
            while len(held) >= least:
                items = sorted(held[:lookahead], key=lambda item: -item[3])
                del held[:lookahead]
                yield rows(items)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity
                cuts = [*([0] if first else []), *range(first, n, capacity), n]
                pieces = [(doc_id, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                held += pieces[:1]
                for at in range(1, len(pieces), 1000):  # these fill a sequence each
                    yield rows(pieces[at:at + 1000])
                yield from waiting(lookahead)
        yield from waiting(1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed sequences (sequence_id, length, ids, offsets): the pieces of a
    sequence side by side and where each starts. A sequence has at most as many
    pieces as it has tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, part: n + part["length"]).alias("length"), joined.alias("ids"), F.col("parts.offset").alias("offsets")))


def ids_crc32() -> Column:
    """Unsigned CRC-32 of a piece's ids."""
    return F.crc32("ids")
