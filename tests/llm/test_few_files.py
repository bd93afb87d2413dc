"""Narrow tables are written by few tasks: every file costs a process beside the executor."""

import os

import corpus_pipeline
import public_tokenizers
from loomtext.llm import _encoding, neardup, packing, tokenbin
from loomtext.llm._shared import Workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")


def files(folder):
    return sum(name.startswith("part-") for name in os.listdir(str(folder).removeprefix("file://")))


def test_manifest_of_many_token_files_is_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and\nmore") for i in range(200)], "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write_tokens(docs, folder, PATH, docs_per_file=10)
    assert manifest.count() > 10 and files(f"{folder}/manifest") == 1
    read = tokenbin.read_tokens(spark, folder)
    assert read.rdd.getNumPartitions() <= -(-manifest.count() // tokenbin.FILES_PER_READER)
    rows = read.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(200))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_words_with_marks_and_line_feeds_inside_are_one_text_to_the_library():
    odd = ["are.\nWhat", "x.\n\ny", "tab\there", "a b", "end\n", "***", " mid", "\x1cmid", "don't", "a_b\r\nc", "é\n日本", "😀\n😀"]
    texts = [" ".join(odd), " ".join(reversed(odd)), "\nfirst " + " ".join(odd), " x y", "a \x85b"]
    coder = _encoding.Encoder(PATH)
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    many = [f"p{i}.\nq{i}" for i in range(3000)]
    asked, plain = [], coder._plain
    coder._plain = lambda x: (asked.append(len(x)), plain(x))[1]
    ids, sizes = coder.encode(texts)
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    asked.clear()
    ids, _ = coder.encode([" ".join(many)])
    assert ids.tolist() == coder.tokenizer.encode(" ".join(many), add_special_tokens=False).ids
    assert sum(asked) < 100


def test_narrow_tables_of_near_duplicates_are_one_file_each(spark, monkeypatch):
    texts = [" ".join(f"w{(i % 9) * 7 + j}" for j in range(40)) + (" more" if i % 4 == 0 else "") for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    made, save = {}, Workspace.save

    def watched(self, df, name):
        out = save(self, df, name)
        made[name] = files(self.path(name))
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neardup.near_duplicates(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r.doc_id: r.cluster_id for r in found} == {i: i % 9 for i in range(240)}
    narrow = {k: n for k, n in made.items() if k in ("signs", "least", "members", "pivots", "pairs", "wanted", "links", "more") or k.startswith("round")}
    assert len(narrow) > 9 and set(narrow.values()) == {1}, narrow


def test_sizes_of_many_partitions_are_one_file(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i}", "s", "en", 5) for i in range(60)], "doc_id long, text string, source string, lang string, n_chars int").repartition(30)
    made, save = {}, Workspace.save

    def watched(self, df, name):
        out = save(self, df, name)
        made[name] = files(self.path(name))
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    assert corpus_pipeline.packing_stage(spark, docs, "").count() == 60 and made == {"sizes": 1}


def test_items_to_pack_are_one_file(spark, monkeypatch, tmp_path):
    rows = [(i, f"word{i} and some more", "s", "en", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").repartition(30).write.parquet(f"{tmp_path}/documents.parquet")
    made, save = {}, Workspace.save

    def watched(self, df, name):
        out = save(self, df, name)
        made[name] = files(self.path(name))
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    coalesce, packed = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes"
    before = {k: spark.conf.get(k) for k in (coalesce, packed, "spark.sql.files.openCostInBytes")}
    spark.conf.set(coalesce, "false")
    spark.conf.set(packed, "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        out = packing.op2_best_fit_packing(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in out) == list(range(60)) and {r.source for r in out} == {"s"} and len({r.bin_id for r in out}) == 60
    assert made["sizes"] == made["items"] == 1
