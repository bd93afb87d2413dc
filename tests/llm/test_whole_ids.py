"""Real token ids and near copies in packing."""

import public_tokenizers
from loomtext.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, source string"


def test_sizes_are_real_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(1, "one 12345 &&& très élevé " * 300, "a"), (2, "短い文 " * 900, "b"), (3, None, None), (4, "", "a")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    size = {}
    for r in packing.op2_best_fit_packing(spark, str(tmp_path)).collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows}


def test_near_copies_share_no_bin(spark, tmp_path):
    base = [f"word{i}" for i in range(120)]
    rows = [(d, " ".join([*base[:-1], f"end{d}"]), f"s{d}") for d in range(6)] + [(10 + d, f"short text number {d}", f"t{d}") for d in range(6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bins = {}
    for r in packing.op2_best_fit_packing(spark, str(tmp_path)).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert sorted(d for b in bins.values() for d in b) == sorted(r[0] for r in rows)
    assert all(sum(d < 6 for d in b) <= 1 for b in bins.values())
