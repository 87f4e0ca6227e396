"""Substring dedup: repeated windows of words merge into removal intervals.

Every window of `width` words gets a Rabin-Karp hash. Per window content Spark
finds the smallest document id; a window goes if its document is not that one.
Hashes have 64 bits: over n windows the expected number of wrong matches is
n * n / 2^65."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raincourier.llm.packs import Pack, census, find, make_packs, with_answers

WIDTH = 13
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept_text", pa.string())])


def _firsts(pack: Pack, width: int):
    """Windows of texts with an id: their documents' ids, distinct keys, the
    smallest id of each key, and each window's key number, document and place."""
    h, doc, at = pack.windows(width)
    known = np.asarray(pack.ids.is_valid())
    ids = np.asarray(pack.ids.fill_null(0), dtype=np.int64)
    if not known.all():
        keep = known[doc]
        h, doc, at = h[keep], doc[keep], at[keep]
    keys, number = np.unique(h, return_inverse=True)
    first = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(first, number, ids[doc])
    return ids, keys, first, number, doc, at


def intervals(covered: np.ndarray) -> list[int]:
    """Maximal runs of True as start, end, start, end, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edge.tolist()


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans
    (removed words as start, end, ...) and kept_text if asked for.

    A word goes if a window that covers it also starts in a document with a
    smaller id. Null, empty and short texts lose nothing. Rows of equal id do
    not count against each other; rows without an id neither lose nor take
    anything. Other columns are ignored."""
    packs = make_packs(docs)

    def of_pack(body):
        _, keys, first, *_ = _firsts(Pack(body), width)
        return keys, first

    def decide(keys, numbers, starts):
        # A pack resolves its own repeats; it has to hear of a key only if a smaller id is elsewhere.
        least = np.repeat(np.minimum.reduceat(numbers, starts), np.diff(np.append(starts, len(keys)))) if len(keys) else numbers
        mask = numbers > least
        return mask, np.zeros(int(mask.sum()), np.int64)

    def finish(body, keys, _):
        pack = Pack(body)
        ids, own, first, number, doc, at = _firsts(pack, width)
        elsewhere = find(keys, own) >= 0
        gone = elsewhere[number] | (first[number] < ids[doc])
        steps = np.zeros(len(pack.words) + 1, np.int64)
        np.add.at(steps, at[gone], 1)
        np.add.at(steps, at[gone] + width, -1)
        covered = np.cumsum(steps[:-1]) > 0
        rows = []
        for k, raw in enumerate(pack.raws):
            own_words, hit = raw.split(), covered[pack.bounds[k]:pack.bounds[k + 1]]
            kept = [w for w, g in zip(own_words, hit.tolist()) if not g] if hit.any() else own_words
            text = b" ".join(kept)
            rows.append((pack.ids[k].as_py(), len(own_words), len(own_words) - len(kept), hashlib.sha256(text).hexdigest(), intervals(hit), text.decode() if keep_text else None))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return with_answers(packs, census(packs, of_pack, decide), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, kept_text string", _OUT)
