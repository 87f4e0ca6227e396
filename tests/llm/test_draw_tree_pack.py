"""Resampling, Merkle manifest and packing against plain computations, and their odd rows."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raincourier.llm import manifest, packing, resampling
from raincourier.llm.catalog import llm_queries

SF = "/root/testdata/sf0.001"
PLAIN = " ".join(f"plain{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
DOCS = [(1, PLAIN, "en", "a", 1), (1, PLAIN, "en", "a", 1), (2, PLAIN + " end", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 3),
        (None, PLAIN, "en", "a", 9), (None, None, None, None, None), (6, LONG, "de", "b", len(LONG)), (7, "one two", "en", "b", 7),
        (9, "ünï çødé 🎉 " * 20, "fr", "a", 5), (10, "日本" * 3000 + " <|endoftext|>  x\n y", "fr", "a", 5), (11, "a" * 20_000, "", "a", 2 ** 63 - 1)]
CLASH = ("part", "idx", "tree", "n", "leaf", "rank", "score", "able", "weight", "ids", "piece", "start", "tampered")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH}).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- resampling ------------------------------------------------------------
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _plain_resample(docs, targets):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    counts = [Counter(map(bucket, _features(d[1])[1])) for d in docs]
    s, t = sum(counts, Counter()), sum((Counter(map(bucket, _features(x)[1])) for x in targets), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for (doc_id, text, *_), c in zip(docs, counts):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        rows.append([doc_id, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_features(text)[0])])
    able = sorted([r for r in rows if r[5] >= 20], key=lambda r: (-r[3], (r[0] is not None, r[0] or 0), r[1], r[2]))
    for k, row in enumerate(able[:5 * len(able) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _drawn(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_equals_plain_counts(spark, table):
    docs, targets = [tuple(r) for r in table.select("doc_id", "text").collect()], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _drawn(llm_queries()["op11_resampling"](spark, SF)) == _plain_resample(docs, targets)


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "plain1 plain2 and more"), (2, None), (2, "")], "item_id long, text string")
    want = _plain_resample(DOCS, ["plain1 plain2 and more"])
    assert _drawn(resampling.resample(odd, target)) == want
    assert _drawn(resampling.resample(odd.where("false"), target)) == []
    assert _drawn(resampling.resample(odd, target.where("false"))) == _plain_resample(DOCS, [])
    many = odd.where("doc_id = 1").crossJoin(spark.range(30).select("id"))  # 60 equal rows: ranks 1 to 3, each once
    assert sorted(r["rank"] for r in resampling.resample(many, target).collect() if r["rank"]) == [1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=300), min_size=1, max_size=6), st.integers(0, 2 ** 32))
def test_bit_planes_give_the_plain_weight(texts, seed):
    gains = np.random.default_rng(seed).integers(-20_000, 20_000, 10_000)
    counts = resampling.Counts(texts)
    want = [sum(int(gains[zlib.crc32(f.encode()) % 10_000]) for f in _features(t)[1]) for t in texts]
    assert resampling.weights(counts, *resampling.gain_planes(gains)).tolist() == want
    assert counts.features.tolist() == [len(_features(t)[1]) for t in texts] and counts.words.tolist() == [len(_features(t)[0]) for t in texts]


def test_long_words_and_repeats_are_hashed_alike():
    text = "x" * 128 + " " + "y" * 129 + " " + "z" * 70_000 + " q " + "the " * 5000
    counts = resampling.Counts([text, "é" * 500 + " a"])
    gains = np.arange(10_000) - 5_000
    assert resampling.weights(counts, *resampling.gain_planes(gains)).tolist() == [sum(int(gains[zlib.crc32(f.encode()) % 10_000]) for f in _features(t)[1]) for t in (text, "é" * 500 + " a")]
    assert resampling.weights(resampling.Counts([""]), *resampling.gain_planes(np.zeros(10_000, np.int64))).tolist() == [0]


# ---- manifest --------------------------------------------------------------
def _levels(items):
    rows = [items]
    while len(rows[-1]) > 1:
        rows.append([manifest.digest(*rows[-1][i:i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def _proof(rows, i):
    out = []
    for row in rows[:-1]:
        if (i ^ 1) < len(row):
            out.append((i & 1, row[i ^ 1]))
        else:
            out.append((0, None))
        i >>= 1
    return out


def _plain_manifest(docs):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, n: hashlib.sha256("".join(map(enc, (d[0], d[3], d[2], n, d[1]))).encode()).hexdigest()
    langs = defaultdict(list)
    for d in docs:
        tampered = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
        langs[d[2]].append((d[0], leaf(d, d[4]), leaf(d, d[4] + 1) if tampered else None))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: (sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), None) for lang, rows in langs.items()}
    trees = {lang: (rows, _levels([r[1] for r in rows])) for lang, (rows, _) in trees.items()}
    top = _levels([trees[lang][1][-1][0] for lang in order])
    root, out = top[-1][0], []
    for lang in order:
        rows, levels = trees[lang]
        for i, (doc_id, own, claim) in enumerate(rows):
            way = _proof(levels, i) + _proof(top, order.index(lang))
            node = claim or own
            for left, other in way:
                node = manifest.digest(other, node) if left else manifest.digest(node, other or "")
            out.append((doc_id, own, levels[-1][0], root, hashlib.sha256("".join(o for _, o in way if o).encode()).hexdigest(), node, node == root))
    return sorted(out, key=str)


def _checked(df):
    proof = F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256")
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_equals_a_plain_tree(table, bits):
    """Two items a run make a tier of every level."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.collect()]
    got = _checked(manifest.verified_manifest(table, bits))
    assert got == _plain_manifest(docs)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(odd):
    want = _plain_manifest(DOCS[:-1])
    assert _checked(manifest.verified_manifest(odd.where("doc_id IS NULL OR doc_id <> 11"))) == want
    assert manifest.verified_manifest(odd).count() == len(DOCS)  # the largest n_chars cannot grow: no overflow
    assert _checked(manifest.verified_manifest(odd.where("false"))) == []
    alone = manifest.verified_manifest(odd.where("doc_id = 4")).head()
    assert alone.leaf == alone.subroot == alone.root and alone.proof == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31, 100, 257])
def test_positions_are_the_postorder(n):
    rows = _levels([manifest.digest(str(i)) for i in range(n)])
    log = manifest.run_nodes(rows[0], len(rows) - 1)
    assert len(log) == sum(map(len, rows)) and all(log[manifest.position(level, i, n)] == node for level, row in enumerate(rows) for i, node in enumerate(row))


def test_log_is_gapless(spark, table):
    built = manifest.build_manifest(table, bits=2)
    sizes = {r.tree: r.n for r in built.trees.collect()}
    leaves = {(r.tree, r.idx): r.leaf.hex() for r in built.leaves.collect()}
    found = defaultdict(dict)
    for r in manifest.log_nodes(built.runs, 2).collect():
        assert r.position not in found[r.tree]
        found[r.tree][r.position] = r.digest
    for tree, n in sizes.items():
        want = manifest.run_nodes([leaves[tree, i] for i in range(n)], manifest.height(n))
        assert [found[tree][p] for p in range(len(want))] == want and len(found[tree]) == len(want)


# ---- packing ---------------------------------------------------------------
def _plain_ids(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = True
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _validate(pieces, docs, capacity=1024):
    """Pieces rebuild every document, only longer ones are cut, sequences are gapless and hold no more than they can."""
    want = Counter((d[0], tuple(ids)) for d, ids in zip(docs, _plain_ids([d[1] for d in docs])))
    rows = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= capacity
        rows[p.doc_id].append((p.piece, p.start, ids))
    for doc_id, parts in rows.items():
        texts = [k for k in want.elements() if k[0] == doc_id]
        if len(texts) == 1:
            parts.sort()
            assert [k for k, *_ in parts] == list(range(len(parts))) and [i for *_, ids in parts for i in ids] == list(texts[0][1])
            assert all(start == sum(len(x) for *_, x in parts[:k]) for k, start, _ in parts) and (len(parts) == 1 or all(len(ids) == capacity for *_, ids in parts[1:]))
        assert sum(len(ids) for *_, ids in parts) == sum(len(k[1]) for k in texts)
    assert set(rows) == {d[0] for d in docs}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_and_tight(spark, table):
    docs = [(r.doc_id, r.text) for r in table.collect()]
    pieces = packing.pack_documents(table.coalesce(1)).collect()
    tokens = sum(p.length for p in pieces)
    assert _validate(pieces, docs) <= 1.02 * math.ceil(tokens / 1024) + 1
    for r, p in zip(sorted(llm_queries()["op13_best_fit_packing"](spark, SF).collect(), key=lambda r: (r.doc_id, r.piece)), sorted(pieces, key=lambda p: (p.doc_id, p.piece))):
        assert (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) == (p.doc_id, p.piece, p.start, p.length, zlib.crc32(p.ids))


def test_packing_of_odd_rows(odd):
    pieces = packing.pack_documents(odd)
    _validate(pieces.collect(), DOCS)
    assert sorted((r.doc_id, r.length) for r in pieces.where("doc_id IN (3, 4)").collect()) == [(3, 1), (4, 1)]
    assert packing.pack_documents(odd.where("false")).collect() == []
    whole = {(r.sequence_id, r.length): bytes(r.ids) for r in packing.sequences(pieces).collect()}
    assert sum(n for _, n in whole) == sum(p.length for p in pieces.collect()) and all(len(ids) == 4 * n for (_, n), ids in whole.items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Z1 \n\t.,'é日  \x1c\x85🎉 ")), max_size=60), min_size=1, max_size=8))
def test_remembered_forms_give_the_tokenizer_ids(texts):
    encoder = _encoder()
    assert [np.frombuffer(b, "<u4").tolist() + [2] for b in map(encoder.encode, texts)] == _plain_ids(texts)


_ENCODERS: list = []


def _encoder():
    if not _ENCODERS:
        _ENCODERS.append(packing.Encoder(packing.vocabulary()))
    return _ENCODERS[0]


def test_forms_are_forgotten_in_bounds(monkeypatch):
    monkeypatch.setattr(packing, "MOST_FORMS", 50)
    encoder, texts = packing.Encoder(packing.vocabulary()), [" ".join(f"w{i * k}" for i in range(40)) for k in range(1, 20)]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() + [2] for t in texts] == _plain_ids(texts)
    assert len(encoder.forms) <= 50 + 41


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80), st.integers(1, 6))
def test_bins_are_best_fit_with_bounded_space(sizes, most):
    """The same places as a plain list of open bins, searched one by one."""
    bins, open_bins, number = packing.Bins(16, most), [], 0
    for size in sizes:
        fits = [b for b in open_bins if 16 - b[1] >= size]
        got = bins.place(size)
        if fits:
            space = min(16 - b[1] for b in fits)
            mine = next(b for b in open_bins if b[0] == got[0])
            assert 16 - mine[1] == space and got[1] == mine[1]
            mine[1] += size
        else:
            assert got == (number, 0)
            if size < 16 and len(open_bins) == most:
                fullest = max(b[1] for b in open_bins)
                assert bins.n_open == most
                open_bins = [b for b in open_bins if b[1] != fullest or b[0] in {n for stack in bins.stacks for n in stack}]
            open_bins.append([number, size])
            number += 1
        open_bins = [b for b in open_bins if b[1] < 16]
        assert sorted(b[0] for b in open_bins) == sorted(n for stack in bins.stacks for n in stack) and bins.n_open == len(open_bins) <= most
