"""The pipeline and the registered queries over whole small tables, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from layerwalk import llm
from layerwalk.llm import html_text, quality_cnn, sentencepiece_fst
from tests.llm.test_operators import brute_leaks, brute_lines, brute_pii, passage, roots, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with junk, repeated lines, copies, near copies and benchmark passages."""
    d = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(0)
    item = [passage(900 + i, 20) for i in range(3)]
    shared = passage(800, 12)
    good = [f"{passage(i, 40)}.\n{passage(100 + i, 30)}." for i in range(50)]
    good += [f"{passage(200 + i, 40)}.\n{shared}" for i in range(8)]
    good += [g.replace(".", " .") for g in good[:5]] + good[5:9]
    for i in range(6):
        w = good[10 + i].split(" ")
        w[3] = "changed"
        good.append(" ".join(w))
    good += [f"{passage(300 + i, 30)} {item[i % 3]} {passage(310 + i, 30)}" for i in range(5)]
    bad = [" ".join(w + "!!" for w in rng.choice(["BUY", "NOW", "CASH", "FAST"], 60)) for _ in range(40)]
    texts = [*good, *bad, None, ""]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k], "en", "s", len(texts[k] or "")) for i, k in enumerate(order)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(int(i), int(k < len(good)), 0) for i, k in enumerate(order) if k < len(texts) - 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(i, "u", p) for i, p in enumerate([None, "", "<p>x &amp; y", "<article><p>" + passage(1, 50) + "</article><footer>f</footer>"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, {r[0]: r[1] for r in rows}


def digest(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def brute_kept(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    return roots(s, links)


def test_stages_in_order_and_columns(spark, tables):
    d, _ = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece"]
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, d).columns == empty.columns
    odd = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("item_id", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, d).columns == odd.columns


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c = (passage(k, 30) for k in (1, 2, 3))
    rows = [(1, a), (2, a), (3, b), (3, b), (3, b), (None, a), (None, a), (None, None), (4, c), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (3, b), (4, c), (5, ""), (None, a), (None, a), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_run_against_brute_force(spark, tables):
    d, texts = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = quality_cnn.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    keep = {r.doc_id for r in quality_cnn.score_texts(docs, net).filter(F.col("score") >= quality_cnn.THRESHOLD).collect()}
    now = {i: t for i, t in texts.items() if i in keep}
    now = {i: t if t is None else kept for i, t in now.items() for _, _, kept in [brute_lines(now)[i]]}
    root = brute_kept(now)
    now = {i: t for i, t in now.items() if root[i] == i}
    leaks = {k for k, _ in brute_leaks(now, {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()})}
    now = {i: t for i, t in now.items() if i not in leaks}
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(now) and 30 < len(now) < len(texts) - 40 and leaks
    for i, t in now.items():
        ids = sp.encode(t or "")
        assert (got[i].n_pieces, got[i].ids_sha256, got[i].decoded_sha256, got[i].round_trip) == (len(ids), digest(",".join(map(str, ids))), digest(t), True)


def test_queries_over_whole_tables(spark, tables):
    d, texts = tables
    q = llm.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in q) == list(range(1, 11))
    got = {r.doc_id: r for r in q["op10_pii_crf"](spark, d).collect()}
    for i, t in texts.items():
        base = brute_pii(t)
        assert got[i].base_sha256 == digest(",".join(f"{k}:{s}:{e}" for k, s, e in base)) and got[i].n_email == sum(k == "email" for k, *_ in base)
    assert {r.page_id: (r.text, r.n_chars) for r in q["op4_html_text"](spark, d).collect()} == {r.page_id: (t, len(t)) for r in spark.read.parquet(f"{d}/pages.parquet").collect() for t in [html_text.main_text(r.html)]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r for r in q["op2_quality_cnn"](spark, d).collect()}
    held = [i for i in labels if got[i].held_out]
    assert len(got) == len(texts) and sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held)
    assert {r.doc_id for r in q["op8_lm_score"](spark, d).collect()} == set(texts) == {r.doc_id for r in q["op9_sentencepiece"](spark, d).collect()}
    want = brute_lines(texts)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in q["op3_line_dedup"](spark, d).collect()} == {i: (a, b, digest(t)) for i, (a, b, t) in want.items()}
