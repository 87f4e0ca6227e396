"""Operators against plain reference computations and SQL twins on the small tables."""
import gzip
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from raincourier.llm import archives, decontaminate, maxent_lm, mixing, packs, secrets, token_groups
from raincourier.llm.catalog import llm_queries, llm_sql

SF = "/root/testdata/sf0.001"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(llm_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, llm_queries()[name](spark, SF).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_classifier_on_held_out_labels(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in llm_queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in good]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == good[r.doc_id] for r in rows]) > 0.95
    assert all(r.predicted == 1 for r in rows if good[r.doc_id] == 1)


def test_language_model(spark, texts):
    tokens = {i: t.encode().translate(_FOLD).split() + [None] for i, t in texts.items()}
    count = Counter(t for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in w)
    n, v = sum(count.values()), len(count)
    rows = llm_queries()["op5_lm_scoring"](spark, SF).collect()
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[t] > 0 for t in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_cells_are_a_distribution():
    model = maxent_lm.Model(50, np.random.default_rng(0).normal(size=maxent_lm.Model.size(50)) / 3)
    context = np.repeat(np.array([[11], [12 << 40], [13 << 50]], np.uint64), maxent_lm.CELLS, axis=1)
    assert math.isclose(np.exp(model.score(context, np.arange(maxent_lm.CELLS))).sum(), 1, rel_tol=1e-4)
    counts = np.random.default_rng(1).integers(0, 90, maxent_lm.CELLS)
    plain = maxent_lm.Model(50, maxent_lm.first_weights(counts, 50)).score(context, np.arange(maxent_lm.CELLS))
    assert np.allclose(np.exp(plain), (counts + 1) / (counts + 1).sum(), rtol=1e-4)


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    context, cells, rows = rng.integers(0, 1 << 62, (3, 200)).astype(np.uint64), rng.integers(0, maxent_lm.CELLS, 200), 5
    model = maxent_lm.Model(rows, rng.normal(size=maxent_lm.Model.size(rows)) / 3)
    model.levels = [w.astype(np.float64) for w in model.levels]
    loss = lambda: -model.score(context, cells).sum()
    for weights, (places, grad) in zip(model.levels, model.gradients(context, cells)):
        total = np.zeros_like(weights)
        for row in places:
            hit, _, sums = maxent_lm.by_row(row, grad)
            total[hit] += sums
        for r, c in zip(rng.choice(np.unique(places), 8), rng.integers(0, maxent_lm.FAN, 8)):
            at, eps = weights[r, c], 1e-5
            weights[r, c] = at + eps
            up = loss()
            weights[r, c] = at - eps
            down = loss()
            weights[r, c] = at
            assert math.isclose((up - down) / (2 * eps), total[r, c], rel_tol=1e-4, abs_tol=1e-4)


def test_rows_are_ranked_beyond_sixteen_bits():
    rows = np.random.default_rng(4).integers(0, 1 << 21, 5000)
    assert (maxent_lm.ranked(rows) == np.argsort(rows, kind="stable")).all()
    assert [maxent_lm.n_rows(v) for v in (0, 100, 10_000, 100_000_000)] == [1, 37, 172, 3713]


def test_equal_texts_score_equally(spark, texts):
    """A text has one probability, whether the model learned from it or not."""
    held, learned = next(i for i in range(10**6, 10**7) if maxent_lm.held_out(i)), next(i for i in range(10**6, 10**7) if not maxent_lm.held_out(i))
    docs = [*texts.items(), (held, texts[0]), (learned, texts[0])]
    score = {r.doc_id: r.score for r in maxent_lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert math.isclose(score[held], score[learned], rel_tol=1e-9) and math.isclose(score[held], score[0], rel_tol=1e-9)


def test_contexts_of_the_whole_corpus_count(spark):
    """5000 contexts, each followed by a word of its own out of one slot: more than any fixed table of rows tells apart."""
    n = 5000
    pair = [f"c{i:04d}qa f{7 * i % n:04d}qa" for i in range(n)]
    wrong = [f"c{i:04d}qa f{7 * (i + 1) % n:04d}qa" for i in range(n)]
    learned, held = [i for i in range(60) if not maxent_lm.held_out(i)][:40], [i for i in range(60) if maxent_lm.held_out(i)][:2]
    rng = random.Random(2)
    docs = [(i, " ".join(rng.sample(pair, n))) for i in learned] + [(held[0], " ".join(pair[:300])), (held[1], " ".join(wrong[:300]))]
    score = {r.doc_id: r.score for r in maxent_lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert score[held[0]] > score[held[1]] + 300 * 0.5


def test_quality_counts(spark, texts):
    for r in llm_queries()["op6_quality_rules"](spark, SF).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        many, seen = Counter(grams), set()
        for i, g in enumerate(grams):
            if many[g] > 1:
                seen |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(seen))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(seen) > 50 * len(words)) and not (r.base_failed and r.kept)


def _plain_spans(text: str) -> list[tuple[int, int, str, int]]:
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.BASE[0][1], text, re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def _plain_entropy(token: str) -> float:
    best = 0.0
    for i in range(len(token) - secrets.WINDOW + 1):
        n = Counter(token[i:i + secrets.WINDOW])
        best = max(best, -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n.values()))
    return best


def test_secrets(spark, texts):
    rng = random.Random(3)
    made = {-k: "".join(rng.choice(["token=", "API-KEY: ", "api_key ='", "Secret:", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "é🎉", " ", "\n", "abcdefghij", "Zq9+/x", "password "]) for _ in range(30))
            for k in range(1, 120)}
    every = {**texts, **made}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        text = every[r.doc_id]
        assert [tuple(s) for s in r.base] == _plain_spans(text)
        want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if not any(re.search(p, m[0]) for p in secrets.ALLOWED)
                and _plain_entropy(m[0]) >= (secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", m[0]) else secrets.MIXED_BITS) - 1e-9]
        assert [(s.start, s.stop) for s in r.added] == want
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    for i, text in every.items():
        assert not any(text[a:b] in masked[i] and b - a >= 40 for a, _, _, b in _plain_spans(text))


def test_allow_list_lets_words_pass_not_mixed_case(spark):
    """Random strings of the usual alphabets are found nearly always; paths, names and words in one case or with one leading capital never."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = {"letters": letters, "base64": letters + "0123456789+/", "hex": "0123456789abcdef"}
    random_ones = [(k, "".join(rng.choice(made[k]) for _ in range(40))) for k in made for _ in range(60)]
    plain = ["QUICK_BROWN_FOX_JUMPS_OVER_THE", "quick/brown/fox-jumps_over/the", "Quick-Brown-Fox-Jumps-Over-The", "src/Main/Java/Quick/BROWN/fox", "12345678901234567890123"]
    df = spark.createDataFrame([(k, "see " + t + " there") for k, t in enumerate([t for _, t in random_ones] + ["QwErTyUiOpAsDfGhJkLzXcVbNmPoIuYt"] + plain)], "doc_id long, text string")
    added = {r.doc_id: len(r.added) for r in secrets.scan_secrets(df).where("size(added) > 0").collect()}
    caught = Counter(k for n, (k, _) in enumerate(random_ones) if n in added or k == "hex")  # hex of 32 or more is a base span
    assert all(n >= 57 for n in caught.values()) and len(random_ones) in added
    assert all(n <= len(random_ones) for n in added)


def test_leaks_against_plain_alignment():
    rng = random.Random(5)
    items = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 200)))) for k in range(8)]
    index = decontaminate.build_index(items)

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
        return min(row)

    for _ in range(40):
        k, item = rng.choice(items)
        noisy = list(item)
        for _ in range(rng.randint(0, len(item) // 8)):
            at = rng.randrange(len(noisy))
            noisy[at:at + 1] = rng.choice([[], ["z"], [noisy[at], "y"]])
        text = "".join(rng.choice("abcdefgh ") for _ in range(50)) + "".join(noisy) + "".join(rng.choice("abcdefgh ") for _ in range(50))
        found = {t: edits for t, _, _, edits in decontaminate.matches(text, index)}
        for j, other in items:
            cost = least(other, text)
            assert (j in found) == (cost <= int(index.edits[j])) and found.get(j, cost) == cost


def test_near_copies_of_a_large_group(spark):
    """A base with many copies that are linked with it but not with each other, and copies just beyond it."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 220):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5])):
            words[at] = f"x{rng.randint(0, 9)}"
        rows.append((k, " ".join(words)))
    sets = {i: {tuple(w[j:j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in token_groups.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in sets}
    assert len(set(got.values())) > 3


def test_rows_of_a_shared_id_are_judged_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    near = lambda t: t + " end"
    rows = [(3, b), (7, a), (7, near(b)), (8, c), (8, near(c)), (8, c), (9, ""), (9, " "), (9, near(a))]
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in token_groups.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    got = kept(rows)
    assert [r for r in got if r[0] != 8] == sorted([(3, b), (7, a), (9, ""), (9, " ")], key=str)
    assert [r in ((8, c), (8, near(c))) for r in got if r[0] == 8] == [True]
    got = kept([(None, a), (None, a), (None, near(a)), (None, b), (3, b), (None, None), (None, None)])
    assert len(got) == 5 and got.count((None, None)) == 2 and (3, b) in got and (None, b) in got
    assert sum(r in ((None, a), (None, near(a))) for r in got) == 1


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, mix = mixing.mix_sources(docs, block_tokens=2000)
    assert abs(mix.entropy - mix.target) < 1e-6
    tokens = {r.source: 0 for r in docs.select("source").distinct().collect()}
    for r in docs.collect():
        tokens[r.source] += len((r.text or "").encode().split())
    whole = sum(tokens.values())
    powered = {s: (t / whole) ** mix.exponent for s, t in tokens.items() if t}
    used = Counter()
    most = Counter()
    for r in rows.collect():
        used[r.source] += r.n_tokens
        most[r.doc_id] += 1
    longest = max(len((r.text or "").encode().split()) for r in docs.collect())
    for s, p in powered.items():
        want = p / sum(powered.values()) * whole
        assert want - longest <= used[s] <= want + 1
    assert max(most.values()) - min(most.values()) <= 4
    assert mixing.mix_sources(docs, entropy_gain=1.0, most_repeats=1.0)[1].exponent == pytest.approx(1.0, abs=1e-6)


def _spark_hash(*values):
    """xxhash64 of a row: each value's bytes under the hash so far; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack(*v), seed=h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("budget", [None, 6_000, 137])
def test_mixture_against_a_plain_plan(spark, budget):
    rng = random.Random(17)
    docs = [(rng.choice([k, k, k, None]), rng.choice(["a", "a", "a", "b", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 90]))) for k in range(30)]
    docs += [docs[0], (5, "b", None), (6, "b", "x " * 60)]
    rows, mix = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, source string, text string"), budget=budget, block_tokens=100)
    tokens = Counter()
    for _, s, t in docs:
        tokens[s] += len((t or "").split())
    whole = sum(tokens.values())
    z = sum((t / whole) ** mix.exponent for t in tokens.values() if t)
    want = []
    for s, total in tokens.items():
        if not total:
            continue
        share = math.floor((total / whole) ** mix.exponent / z * mix.budget + 0.5)
        blocks, (full, rest) = -(-total // 100), divmod(share, total)
        own = []
        for i, source, t in docs:
            if source == s:
                h = _spark_hash(("<i", 7), "null" if i is None else str(i), ("<q", _spark_hash(t)))
                own.append((h, h % blocks, i, len((t or "").split())))
        for epoch in range(full + (rest > 0)):
            left, stop = rest if epoch == full else math.inf, False
            for turn, b in enumerate(sorted({b for _, b, _, _ in own}, key=lambda b: (_spark_hash(("<i", 7), s or "null", ("<q", epoch), ("<q", b)), b))):
                inside = sorted((_spark_hash(("<q", h), ("<i", 7), ("<q", epoch)) % (1 << 40), i is not None, i or 0, n) for h, x, i, n in own if x == b)
                size = sum(x[-1] for x in inside)
                if stop or left <= 0:
                    break
                stop = size > left
                for order, known, i, n in inside:
                    if n > left:
                        break
                    left -= n
                    want.append((i if known else None, s, epoch, b, round((epoch + (turn + order / (1 << 40)) / blocks) * total / max(share, 1), 9), n))
    got = [(r.doc_id, r.source, r.epoch, r.block, round(r.slot, 9), r.n_tokens) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_each_pass_has_its_own_order(spark):
    docs = spark.createDataFrame([(k, "small" if k < 40 else "large", "w " * 10) for k in range(1200)], "doc_id long, source string, text string")
    passes = {}
    for r in sorted(mixing.mix_sources(docs, entropy_gain=1.0, block_tokens=50)[0].where("source = 'small'").collect(), key=lambda r: r.slot):
        passes.setdefault(r.epoch, []).append((r.doc_id, r.block))
    whole = [p for p in passes.values() if len(p) == 40]
    assert len(whole) >= 3 and len({tuple(i for i, _ in p) for p in whole}) == len(whole)
    assert len({tuple(dict.fromkeys(b for _, b in p)) for p in whole}) == len(whole)


def test_archives_of_both_versions():
    pages = [(7, "http://x.org/a b", "päge".encode()), (None, None, b""), (8, "http://y.org", b"\r\n\r\nWARC/1.0\r\n")]
    for version in (1, 2):
        got = list(archives.parse_arc("n.arc", archives.arc_file("n.arc", version, pages)))
        assert [g["url"] for g in got] == ["filedesc://n.arc", "http://x.org/a%20b", "urn:x-no-url", "http://y.org"]
        assert [g["body"].partition(b"\r\n\r\n")[2] for g in got[1:]] == [p[2] for p in pages]
    about = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n\n"
    blank = b"filedesc://o.arc 0.0.0.0 20000101000000 text/plain %d\n" % len(about) + about + b"\nhttp://z.org/q r 1.2.3.4 20000102030405 text/html 5\nhello\n"
    assert [(g["url"], g["body"]) for g in archives.parse_arc("o.arc", blank)][1] == ("http://z.org/q r", b"hello")
    with pytest.raises(ValueError):
        list(archives.parse_arc("c.arc", archives.arc_file("c.arc", 1, pages)[:-9]))


def test_a_page_named_like_a_version_block_is_a_page():
    content = archives.arc_file("n.arc", 1, [(7, "filedesc://x", b"page")])
    got = [archives._described("n.arc", r, True) for r in archives.parse_arc("n.arc", content)]
    assert [(g["warc_type"], g["page_id"]) for g in got] == [("warcinfo", None), ("response", 7)]


def test_key_coding():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        for top in (2000, 2 ** 40, 2 ** 64 - 1):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (packs.unsqueezed(packs.squeezed(keys)) == keys).all()
    for values in (np.array([5]), np.array([-3, 2 ** 62]), np.arange(1000)):
        assert (packs.unnarrow(packs.narrow(values)) == values).all()
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_leaks_of_a_text_full_of_copies():
    """Thousands of occurrences are found once each, in time that grows with their number."""
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefgh ") for _ in range(120))
    index = decontaminate.build_index([(1, item)])
    text = ("-" * 40).join([item] * 4000)
    assert decontaminate.matches(text, index) == [(0, k * 160, k * 160 + 120, 0) for k in range(4000)]


@pytest.mark.parametrize("slice_", [7, 1 << 19])
def test_repetitive_texts_against_plain_alignment(monkeypatch, slice_):
    """Items and texts with runs and periods, whole and cut into tiny slices: found where the least cost is in budget."""
    monkeypatch.setattr(decontaminate, "SLICE", slice_)
    rng = random.Random(23)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = ["-" * 60, "ab" * 40, made(30) + "-" * 40, "=" * 25 + made(50) + "=" * 25, made(90), "x" * 8, made(9) * 9]
    index = decontaminate.build_index(list(enumerate(items)))
    assert index.repetitive.tolist() == [True, True, True, True, False, False, True]

    def costs(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
        return min(row)

    for _ in range(25):
        noisy = list(rng.choice(items))
        for _ in range(rng.randint(0, len(noisy) // 8)):
            at = rng.randrange(len(noisy))
            noisy[at:at + 1] = rng.choice([[], ["z"], [noisy[at], "y"]])
        text = rng.choice(["", "-" * 30, made(40), "ab" * 15]) + "".join(noisy) + rng.choice(["", "-" * 70, "=" * 30, made(40)])
        found = {}
        for t, start, stop, edits in decontaminate.matches(text, index):
            assert costs(items[t], text[start:stop]) <= edits
            found[t] = min(edits, found.get(t, edits))
        assert found == {t: cost for t, item in enumerate(items) if (cost := costs(item, text)) <= int(index.edits[t])}


@pytest.mark.parametrize("text", ["-" * 2_000_000, "ab" * 1_000_000, "-=" * 1_000_000, "abcdefg" * 300_000])
def test_repetitive_texts_in_bounded_memory(text):
    rng = random.Random(29)
    items = ["-" * 100, "ab" * 50, "".join(rng.choice("abcdefgh ") for _ in range(60)) + "-" * 100, "".join(rng.choice("abcdefgh ") for _ in range(150))]
    index = decontaminate.build_index(list(enumerate(items)))
    tracemalloc.start()
    found = decontaminate.matches(text, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    # Pure repeats are found from end to end, up to an item's length left over between two neighbours and at the ends.
    whole = [t for t, item in enumerate(items) if item in text]
    assert {t for t, *_ in found} == set(whole)
    for t in whole:
        hits = [(a, b) for u, a, b, _ in found if u == t]
        assert all(b - a == 100 for a, b in hits) and max(y - x for (_, x), (y, _) in zip([(0, 0), *hits], [*hits, (len(text), 0)])) <= 100


def test_short_items_late_in_a_long_text():
    rng = random.Random(11)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (8, 394, 12, 15)]
    for order in (items, items[::-1], items[1:] + items[:1]):
        index = decontaminate.build_index(list(enumerate(order)))
        for tail in (0, 30, 2000, 9000):
            text = "-" * 10_000
            places = {}
            for t, item in enumerate(order):
                if len(item) < 20:
                    start = len(text) - tail - 20 * (t + 1)
                    text = text[:start] + item + text[start + len(item):]
                    places[t] = start
            assert decontaminate.matches(text, index) == [(t, start, start + len(order[t]), 0) for t, start in sorted(places.items())]


def test_short_items_have_their_whole_budget():
    rng = random.Random(13)
    items = [(n, "".join(rng.choice("abcdefgh ") for _ in range(n))) for n in range(1, 46)]
    index = decontaminate.build_index(items)
    assert index.edits.tolist() == [n // 10 for n in range(1, 46)]

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
        return min(row)

    for n, item in items[7:]:
        for _ in range(4):
            noisy = list(item)
            for _ in range(rng.choice([n // 10, n // 10, n // 10 + 1])):
                at = rng.randrange(len(noisy))
                noisy[at:at + 1] = rng.choice([[], ["z"], [noisy[at], "y"]])
            text = "".join(rng.choice("abcdefgh ") for _ in range(50)) + "".join(noisy) + "".join(rng.choice("abcdefgh ") for _ in range(30))
            found = {}
            for t, _, _, edits in decontaminate.matches(text, index):
                found[t] = min(edits, found.get(t, edits))
            assert found == {t: cost for t, (m, other) in enumerate(items) if (cost := least(other, text)) <= m // 10}


def test_archives_are_read_record_by_record():
    def record(block, length=None):
        return b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % (len(block) if length is None else length) + block + b"\r\n\r\n"
    blocks = [b"", b"\r\n\r\nWARC/1.0\r\n", b"x" * 300_000]
    whole = b"".join(map(record, blocks))
    for content in (whole, gzip.compress(whole), b"".join(gzip.compress(record(b)) for b in blocks)):
        assert [b for _, b in archives.parse_warc(content)] == blocks
    for bad in (record(b"abc", 2), record(b"abc", 9), b"nonsense\r\n\r\n", whole[:-3], b"WARC/1.0\r\nContent-Length: 1"):
        with pytest.raises(ValueError):
            list(archives.parse_warc(bad))
