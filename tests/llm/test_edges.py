"""Null, empty, long, repeated and odd rows, extra columns and empty tables, for every operator and stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raincourier.llm import archives, decontaminate, maxent_lm, mixing, pu_classifier, quality_rules, secrets, substring_dedup, token_groups, url_filter

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
PLAIN = " ".join(f"plain{i}" for i in range(60))
DOCS = [(1, PLAIN, "en", "a", 1), (1, PLAIN, "en", "a", 1), (2, PLAIN + " end", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 3),
        (None, PLAIN, "en", "a", 9), (None, None, None, None, None), (6, LONG, "de", "b", len(LONG)), (7, "one two", "en", "b", 7), (8, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "b", 50),
        (9, "ünï çødé 🎉 " * 20, "fr", "a", 5)]
CLASH = ("score", "pack", "n", "kept", "spans", "block", "h", "digest", "component_id", "quality", "base")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, None), (2, 0, 0), (4, 0, 1), (None, 1, 1), (7, None, 0), (99, 1, 0), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "a benchmark passage that nobody else would ever write down here by chance"), (2, None), (3, ""), (3, ""), (4, "24be64")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(5))


def _each(odd, labels, benchmark):
    return {
        "op1": lambda d: pu_classifier.score_quality(d, labels), "op2": lambda d: substring_dedup.remove_repeats(d, keep_text=True), "op3": token_groups.near_copies,
        "op5": maxent_lm.score_texts, "op6": lambda d: quality_rules.quality_rules(d, labels), "op8": secrets.scan_secrets}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op8"])
def test_one_row_per_row(odd, labels, benchmark, name):
    run = _each(odd, labels, benchmark)[name]
    rows = run(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in DOCS)
    assert run(odd.where("false")).collect() == []


def test_values_of_odd_rows(odd, labels):
    removed = {r.doc_id: r for r in substring_dedup.remove_repeats(odd, keep_text=True).collect()}
    assert (removed[1].n_removed, removed[2].n_removed, removed[2].kept_text, removed[4].n_words) == (0, 60, "end", 0)
    comps = [(r.doc_id, r.n_shingles, r.component_id) for r in token_groups.near_copies(odd).collect()]
    assert {(1, 57, 1), (2, 58, 1), (None, 57, 1), (3, 0, 3), (4, 0, 4), (None, 0, None), (7, 1, 7)} <= set(comps)
    scores = {r.doc_id: r for r in pu_classifier.score_quality(odd, labels).collect()}
    assert scores[3].score == scores[4].score == scores[5].score and 0 <= scores[6].score <= 1
    lm = {r.doc_id: r for r in maxent_lm.score_texts(odd).collect()}
    assert lm[4].n_tokens == 1 and lm[6].n_tokens == 40_001 and all(r.score < 0 for r in lm.values())
    assert all(r.score == 0.5 for r in pu_classifier.score_quality(odd, labels.where("false")).collect())


def test_leaks_and_mixture(odd, benchmark):
    assert [(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(odd, benchmark).collect()] == [(8, 4, 0)]
    assert decontaminate.find_leaks(odd, benchmark.where("false")).collect() == []
    rows, mix = mixing.mix_sources(odd)
    used = rows.collect()
    assert used and 0 <= mix.exponent <= 1 and all(0 <= r.slot for r in used)
    assert mixing.mix_sources(odd.where("false"))[0].collect() == []


def test_pages(spark, tmp_path):
    pages = [(1, "http://a.org/x y", "h" * 200), (1, "http://a.org/x y", "h" * 200), (2, None, "h" * 200), (3, "", None), (None, "https://b.com", "é" * 90), (4, "no scheme casino", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit(0))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.pages_to_warc(df, str(tmp_path / "w")).collect()), key=str)
    assert got == sorted([(1, 200, "response", None), (1, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 0, "response", None), (None, 180, "response", None), (4, 0, "response", None)], key=str)
    assert archives.pages_to_warc(df.where("false"), str(tmp_path / "e")).collect() == []
    urls = {r.page_id: (r.host, r.path, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert urls[2] == ("", "", "allow") and urls[4] == ("", "", "block") and urls[None] == ("b.com", "", "allow")


def test_stages_keep_columns(spark, odd, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (odd, odd.where("false")):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    kept = [r.doc_id for r in token_groups.keep_one(odd, 5, 80).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, 4, 5, None, None, 6, 7, 8, 9]))


def test_long_candidates(spark):
    """Strings of many parts are judged without a deep stack or repeated tries."""
    texts = ["ab-" * 30_000, "aB" * 60 + "1", "aBcD/" * 20_000, "Qx7" * 20_000]
    df = spark.createDataFrame([(k, "see " + t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: len(r.added) for r in secrets.scan_secrets(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
