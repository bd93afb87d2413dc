"""The pipeline's stages, each on its own input, and the whole run against a brute-force version of the decisions."""

import corpus_pipeline as cp
import public_tokenizers
import pytest
from loomtext.llm import pii
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_neardup import brute


def test_stages_decide_like_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]

    good = cp.quality_stage(spark, docs, sf)
    assert good.columns == list(cp.COLUMNS)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    judged = [(labels[d], d in kept) for d in {r.doc_id for r in docs.select("doc_id").collect()} if d in labels]
    assert sum(q == k for q, k in judged) >= 0.97 * len(judged) and all(k for q, k in judged if q == 1)

    one = cp.near_dedup_stage(spark, good, sf)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {i for i, root in brute(rows).items() if i == root}
    got = {r.doc_id for r in one.collect()}
    assert got == want

    clean = cp.decontamination_stage(spark, one, sf)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in clean.collect():
        text = " ".join(r.text.lower().split())
        assert not any(i in text for i in items)
    assert clean.count() < one.count()

    safe = cp.pii_stage(spark, clean, sf)
    assert safe.columns == list(cp.COLUMNS) and safe.count() == clean.count()
    for r in safe.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)

    packed = cp.packing_stage(spark, safe, sf)
    size = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert size == {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in safe.collect()}


def test_run_gives_the_last_stage(spark, sf):
    out = cp.run(spark, sf)
    assert set(out.columns) == {"doc_id", "source", "piece", "piece_start", "n_tokens", "bin_start", "bin_id"} and out.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, cluster_id string, score double"  # extra columns with clashing names
STAGES = dict(cp.STAGES)


def odd_rows(sf):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "some plain text of a few words here", "en", "a"), (1, "some plain text of a few words here", "en", "a"), (1, "another text under one id", None, None), (None, None, None, None), (None, "text without an id", "en", "b"), (None, "text without an id", "en", "b"), (7, None, "de", None), (8, "", None, "a"), (9, "  \n ", "fr", "b"), (10, long, "en", "a"), (11, long, "en", "b"), (12, "mail to a.b@c.org or 10.0.0.1", "en", "c")]
    return [(i, t, lang, s, None if t is None else len(t), "x", 0.5) for i, t, lang, s in rows]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows_and_empty_tables(spark, sf, name):
    stage = STAGES[name]
    rows = odd_rows(sf)
    out = stage(spark, spark.createDataFrame(rows, ODD), sf)
    none = stage(spark, spark.createDataFrame([], ODD), sf)
    assert none.count() == 0 and none.columns == out.columns
    got = out.collect()
    if name != "best-fit packing":
        assert out.columns == list(cp.COLUMNS)
    ids = [r.doc_id for r in got]
    if name == "minhash near-dedup":
        assert sorted(i for i in ids if i is not None) == [1, 7, 10, 12] and ids.count(None) == 3
        assert [r.text for r in got if r.doc_id == 1] == ["another text under one id"]
    if name == "pii":
        assert len(got) == len(rows) and [r.text for r in got if r.doc_id == 12] == ["mail to <EMAIL> or <IP>"]
    if name == "benchmark decontamination":
        assert len(got) == len(rows)
    if name == "best-fit packing":
        assert len({(r.bin_id, r.bin_start) for r in got}) == len(got) and {r.doc_id for r in got} == {r[0] for r in rows}
