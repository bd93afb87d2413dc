"""Operator 2 reads its texts once for sizes and digests; sizes, hashes and their order are as those made one by one."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from loomtext.llm import _encoding, _hashing, neardup, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", "\n", "a\nb", "a.\nB c", "a\n\nb", "a \nb", "a\n b", "\na b", "a b\n", "a\r\nb c", "a\n\x85b", "a\n b", "x\n.y z", "x\n's it", "it's\nx's", "x \n", "q .\n-- z\n\"A\"", "1\n2 3\n4",
    "ä\nÖl groß.\nÜber straße", "ª µ º ʯ ʰ à á", "日本\n語 の", "x\n日本", "a\n<|endoftext|> b", "no-break space here", "don't\ncan't we'll", "x\t\ny", "x\n​y z", "q\nx́ ý.",
]


def test_sizes_are_those_of_the_library_at_line_feeds_and_letters():
    rng = random.Random(3)
    texts = ODD + [t + " " + u for t in ODD for u in ODD] + ["".join(rng.choice(["a", "Be", "ß", "é", " ", " ", "\n", ".", ",", "'", "s", "7", "\t", "-", "日"]) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for remembered in (_encoding.CACHED_WORDS, 8):
        coder = _encoding.Encoder(PATH, remembered)
        want = [len(x.ids) for x in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [n for i in range(0, len(texts), 500) for n in coder.sizes(texts[i : i + 500]).tolist()] == want == coder.encode(texts)[1].tolist()


def test_words_of_letters_are_not_cut_by_the_library():
    coder = _encoding.Encoder(PATH)
    asked, plain = [], coder._plain
    coder._plain = lambda x: (asked.extend(x), plain(x))[1]
    coder.sizes(["x " + " ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}.\nNext" for i in range(600))])
    assert sum(map(len, asked)) < 100


def test_counted_words_are_not_held_without_end():
    coder = _encoding.Encoder(PATH, remembered=1000)
    for i in range(60):
        coder.sizes(["x " + " ".join("ab" * 200 + chr(97 + i % 26) + chr(97 + j % 26) * j for j in range(40))])
        assert sum(map(len, [*coder.counted, *coder.counted_before])) < 60_000


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, " ", "a", "a b c d", "a b c d e", " a  b\tc\nd e f ", "long " * 70_000, "x" * 300_000 + " y"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    hasher = _hashing.WordHasher(31)
    for size in (64, _hashing.GROUP):
        monkeypatch.setattr(_hashing, "GROUP", size)
        for given in (pa.array(texts), pa.chunked_array([texts[:5], texts[5:]]), pa.array([None, *texts])[1:]):
            h, owner = hasher.shingles_of(given)
            for i, t in enumerate(texts):
                assert sorted(h[owner == i].tolist()) == sorted(hasher.shingles(hasher.words(t)).tolist())
    assert [len(x) for x in hasher.shingles_of(pa.array([], pa.string()))] == [0, 0]


def test_order_of_hashes_is_stable_and_exact():
    rng = np.random.Generator(np.random.PCG64(5))
    for bits in (1, 3, 8, 20, 63):
        for shift in (0, 40):
            h = (rng.integers(0, 1 << bits, 3000, dtype=np.uint64) << np.uint64(shift)) + np.uint64(7)
            order, found = _hashing.in_order(h)
            assert order.tolist() == np.argsort(h, kind="stable").tolist() and found.tolist() == np.sort(h).tolist()
    assert [len(x) for x in _hashing.in_order(np.empty(0, np.uint64))] == [0, 0]


def test_texts_are_read_once_for_sizes_and_digests(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(1, " ".join(base), "a"), (2, " ".join([*base[:-1], "x"]), "b"), (3, "\n ".join(base), "c"), (4, "other words", "d"), (None, "no id", "e"), (6, None, "f"), (6, "again", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = {r.doc_id: r.cluster_id for r in neardup.near_duplicates(docs).collect()}
    measured = packing.sized_and_digested(docs, PATH)
    assert sorted(map(tuple, measured.select("doc_id", "source", "cluster", "size").collect()), key=repr) == sorted(map(tuple, packing.sized_by_ids(docs, PATH).collect()), key=repr)
    signs = measured.where("doc_id IS NOT NULL").select("doc_id", "t", "c1", "c2", "words")
    assert sorted(map(tuple, signs.collect())) == sorted(map(tuple, neardup.named_texts(docs).mapInArrow(neardup._digests, neardup.DIGEST).collect()))

    def fail(batches):
        raise AssertionError("the texts are digested again")

    monkeypatch.setattr(neardup, "_digests", fail)
    out = packing.op2_best_fit_packing(spark, str(tmp_path)).collect()
    bins = {r.doc_id: r.bin_id for r in out}
    assert near[1] == near[2] == near[3] and len({bins[i] for i in (1, 2, 3)}) == 3 and len(out) == len(rows)
