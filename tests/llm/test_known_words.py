"""The library is asked once for a word, whatever marks follow it, and long words are not held without end."""

import public_tokenizers
import pyarrow as pa
from loomtext.llm import _encoding

PATH = public_tokenizers.path("byte_bpe_50k.json")


def same(coder, texts):
    ids, sizes = coder.encode(texts)
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    return ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_known_words_are_not_asked_for_again_with_other_marks():
    coder = _encoding.Encoder(PATH)
    words = [f"p{i}" for i in range(3000)]
    assert same(coder, ["x " + " ".join(words)])
    asked, plain = [], coder._plain
    coder._plain = lambda x: (asked.extend(x), plain(x))[1]
    for marks in ("***", "%%%", '")', "_", "...", "--"):
        assert same(coder, ["x " + " ".join(w + marks for w in words)])
    assert sum(map(len, asked)) < 100


def test_marks_that_are_no_pieces_of_their_own_stay_with_their_word():
    texts = ["it's' x'", "a' 's. ''s", "*** .. - _", "́. é. ². Ⅷ! 　. ।.", "x\n. y\n\n. z.\n.", "don't. we'll, 'tis'"]
    assert same(_encoding.Encoder(PATH), texts) and all(same(_encoding.Encoder(PATH), ["q " + t, t + " q"]) for t in texts)


def test_long_words_end_a_generation():
    coder = _encoding.Encoder(PATH, remembered=1000)
    for i in range(60):
        assert same(coder, ["x " + f"日本{i}語" * 1000])
    assert sum(p.words.nbytes + p.ids.nbytes for p in (coder.young, coder.old)) < 300_000


def test_groups_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(_encoding, "BATCH_CHARS", 10)
    texts = ["abcd", None, "", "efghij", "k", "0123456789ab", "", "l"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = [(first, t.to_pylist()) for first, t in _encoding.groups(batch)]
    assert [x for _, t in got for x in t] == [t or "" for t in texts]
    assert [first for first, _ in got] == [0, 4, 5, 6] and all(len(t) == 1 or sum(map(len, t)) <= 10 for _, t in got)
