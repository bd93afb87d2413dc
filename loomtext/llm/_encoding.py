"""Ids of whole texts, each distinct word encoded by the ``tokenizers`` library once.

With a byte-level BPE and its usual pattern a space before a visible character
always begins a new piece, and so do marks after a letter or number: a text may
be cut at both and the ids of the parts put together.  Texts are cut, and their
words numbered and looked up, in Arrow; words the library has not been asked for
yet go to it many at a time, and the ids of a batch are one gather from them all.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 2_000_000  #: words a Python worker remembers, in two generations (about 50 bytes each); results don't depend on it
WORD_BYTES = 24  #: of a remembered word and its ids on average; with longer ones a generation ends earlier
BATCH_CHARS = 16_000_000  #: characters of texts worked on at once; a longer text is a batch of its own
GATHERED = 500_000  #: words, of whole texts, whose ids are gathered at once
_MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""  #: no apostrophe, which begins a piece of its own before some letters
_UNSAFE = r" (?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|\z)"  #: a space that begins no word
_BLANK = r"^(?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|\z)"  #: a word, cut at spaces, that begins with no visible character
_SOLID = r"[\p{L}\p{N}]"
_LINES = r"(?:^|[\s\p{Z}\x0b\x1c-\x1f\x{85}])\n|\n(?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|\z)"  #: a line feed that is no piece of its own
_LETTERS = r"^\n?[A-Za-zªµºÀ-ÖØ-öø-ʯ]+\z"  #: one piece, but for the line feed


def _byte_characters() -> dict[int, str]:
    """What byte-level models have for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters()


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``ids[start : start + size]``, one after the other."""
    ends = np.cumsum(size)
    kind = np.int32 if len(ids) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return ids.take(at)


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, x.dtype)
    out[: len(x)] = x
    return out


def _joined(words: pa.StringArray) -> str:
    """Words without a space, and one between them."""
    ends = pa.array([0, len(words)], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, words.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))[0].as_py()


class Pool:
    """Ids of words, numbered in the order they are met."""

    def __init__(self, kind):
        self.words = pa.array([], pa.string())
        self.start = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.ids = np.zeros(1, kind)
        self.used = 0

    def __len__(self) -> int:
        return len(self.words)

    @property
    def bytes(self) -> int:
        return self.words.nbytes + self.used * self.ids.itemsize

    def find(self, words: pa.StringArray) -> np.ndarray:
        """Their numbers, -1 for words that are not here."""
        if not len(self):
            return np.full(len(words), -1, np.int32)
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)

    def add(self, words: pa.StringArray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of words that are not here yet."""
        n, held = len(words), len(self)
        if held + n > len(self.size):
            self.start, self.size = (_longer(x, 3 * (held + n) // 2) for x in (self.start, self.size))
        if self.used + len(ids) > len(self.ids):
            self.ids = _longer(self.ids, 3 * (self.used + len(ids)) // 2)
        self.size[held : held + n] = sizes
        self.start[held : held + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.words = pa.concat_arrays([self.words, words])
        self.used += len(ids)
        return np.arange(held, held + n, dtype=np.int32)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.ids, self.start[at], self.size[at]), self.size[at]


class Encoder:
    """Ids as the library gives them with ``add_special_tokens=False``, for whole texts."""

    def __init__(self, path: str, remembered: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("model") or {}).get("type") == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]  # found before a text is cut
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  #: ids whose token begins with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.young, self.old = Pool(self.kind), Pool(self.kind)
        self.counted, self.counted_before, self.counted_chars = {}, {}, 0  #: words and their number of ids, for ``sizes``

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with a visible character, each with its space before it; many are one text to the library."""
        if not words:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        ids = self._plain([" " + " ".join(words[i : i + 500]) for i in range(0, len(words), 500)])[0]
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(words):
            raise ValueError("a token begins with a space inside a word")
        return ids, np.diff(cuts, append=len(ids))

    def _learn(self, words: pa.StringArray) -> np.ndarray:
        """Adds words that neither generation holds to the young one; their numbers."""
        blank = pc.match_substring_regex(words, _BLANK)
        odd = words.filter(blank).to_pylist()  # first words of texts alone
        at = np.empty(len(words), np.int32)
        blank = blank.to_numpy(zero_copy_only=False)
        if odd:
            at[blank] = self.young.add(pa.array(odd, pa.string()), *self._plain([" " + w for w in odd]))
        rest = words.filter(pa.array(~blank)) if odd else words
        at[~blank] = self.young.add(rest, *self._run(rest.to_pylist()))
        return at

    def _numbers(self, words: pa.StringArray) -> np.ndarray:
        """Numbers in the young pool, which afterwards holds all the words; no word may be there twice."""
        if len(self.young) > self.remembered // 2 or self.young.bytes > self.remembered // 2 * WORD_BYTES:
            self.old, self.young = self.young, Pool(self.kind)
        at = self.young.find(words).copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            lacking = words.take(pa.array(new))
            before = self.old.find(lacking)
            kept = before >= 0
            at[new[kept]] = self.young.add(lacking.filter(pa.array(kept)), *self.old.ids_of(before[kept]))
            at[new[~kept]] = self._learn(lacking.filter(pa.array(~kept)))
        return at

    def _bodies(self, words: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, pa.DictionaryArray]:
        """(distinct words without the marks after their last letter or number, which of the words have such, these marks)."""
        bodies = pc.ascii_rtrim(words, characters=_MARKS)
        last = pc.utf8_slice_codeunits(bodies, -1).dictionary_encode()
        solid = pc.match_substring_regex(last.dictionary, _SOLID).take(last.indices)
        cut = pc.and_(solid, pc.less(pc.binary_length(bodies), pc.binary_length(words)))
        ended = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        marks = pc.replace_substring_regex(words.take(pa.array(ended)), rf"^(?s:.*)[^{re.escape(_MARKS)}]", "").dictionary_encode()
        return pc.if_else(cut, bodies, words).dictionary_encode(), ended, marks

    def _ids_of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): those of each distinct word; marks after its last letter or number are looked up apart from it."""
        numbered, ended, marks = self._bodies(words)
        at = self._numbers(numbered.dictionary)[numbered.indices.to_numpy()]
        ids, sizes = self._plain(marks.dictionary.to_pylist())
        pool, begins, place = self.young, np.cumsum(sizes) - sizes, marks.indices.to_numpy()
        start, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        start[:, 0], size[:, 0] = pool.start[at], pool.size[at]
        start[ended, 1], size[ended, 1] = pool.used + begins[place], sizes[place]
        both = gathered(np.concatenate([pool.ids[: pool.used], ids]), start.ravel(), size.ravel())
        size = size.sum(1)
        return both, np.cumsum(size) - size, size

    def _pieces(self, words: pa.StringArray, before: str) -> list[int]:
        """Numbers of ids of words of letters, which the model is asked for without cutting them again."""
        ask = self.tokenizer.model.tokenize
        held = _joined(words).encode().decode("latin-1").translate(_BYTES)
        return [len(ask(before + w)) for w in held.split(_BYTES[32])]

    def _count(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of ids of words, each with its space before it; or none, if it begins with a line feed, which then is a piece of its own."""
        feed = len(self._plain(["\n"])[0])
        line, letters = pc.starts_with(words, "\n"), pc.match_substring_regex(words, _LETTERS)
        blank = pc.and_(pc.match_substring_regex(words, _BLANK), pc.invert(line))
        sizes = np.empty(len(words), np.int64)
        for kind, count in (
            (pc.and_(letters, pc.invert(line)), lambda w: self._pieces(w, _BYTES[32])),
            (pc.and_(letters, line), lambda w: np.array(self._pieces(pc.utf8_slice_codeunits(w, 1), "")) + feed),
            (pc.and_(pc.invert(letters), line), lambda w: self._plain([x[1:] for x in w.to_pylist()])[1] + feed),
            (blank, lambda w: self._plain([" " + x for x in w.to_pylist()])[1]),  # first words of texts alone
            (pc.invert(pc.or_(pc.or_(letters, line), blank)), lambda w: self._run(w.to_pylist())[1]),
        ):
            some = words.filter(kind)
            if len(some):
                sizes[kind.to_numpy(zero_copy_only=False)] = count(some)
        return sizes

    def _sizes_of_words(self, words: pa.StringArray) -> np.ndarray:
        """Of each distinct word; marks after its last letter or number are looked up apart from it."""
        numbered, ended, marks = self._bodies(words)
        if len(self.counted) > self.remembered // 2 or self.counted_chars > self.remembered // 2 * WORD_BYTES:
            self.counted, self.counted_before, self.counted_chars = {}, self.counted, 0
        keys = _joined(numbered.dictionary).split(" ")
        sizes = np.array([self.counted.get(w, -1) for w in keys], np.int64)
        for find in (lambda new: np.array([self.counted_before.get(keys[i], -1) for i in new.tolist()], np.int64), lambda new: self._count(numbered.dictionary.take(pa.array(new)))):
            new = np.flatnonzero(sizes < 0)
            if len(new):
                sizes[new] = found = find(new)
                kept = {keys[i]: n for i, n in zip(new.tolist(), found.tolist()) if n >= 0}
                self.counted.update(kept)
                self.counted_chars += sum(map(len, kept))
        size = sizes.take(numbered.indices.to_numpy())
        size[ended] += self._plain(marks.dictionary.to_pylist())[1].take(marks.indices.to_numpy())
        return size

    def _split(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, pa.DictionaryArray]:
        """(where texts begin among all words, number of each word, the distinct words, the first word of each text, which has no space before it)."""
        parts = pc.split_pattern(texts, " ")
        begins = parts.offsets.to_numpy()
        begins = begins - begins[0]
        numbered = parts.flatten().dictionary_encode()
        del parts
        place = numbered.indices.to_numpy()
        return begins, place, numbered.dictionary, numbered.dictionary.take(pa.array(place[begins[:-1]])).dictionary_encode()

    def _cut(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        begins, place, words, firsts = self._split(texts)
        ids, start, size = self._ids_of_words(words)
        first_ids, first_size = self._plain(firsts.dictionary.to_pylist())
        first_start = len(ids) + np.cumsum(first_size) - first_size
        first = firsts.indices.to_numpy()
        ids = np.concatenate([ids, first_ids])
        out, sizes, a = [], [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(begins, begins[a] + GATHERED, "right")) - 1)
            at, heads = place[begins[a] : begins[b]], begins[a:b] - begins[a]
            s, n = start[at], size[at]
            s[heads], n[heads] = first_start[first[a:b]], first_size[first[a:b]]
            out.append(gathered(ids, s, n))
            sizes.append(np.add.reduceat(n, heads))
            a = b
        return np.concatenate(out), np.concatenate(sizes)

    def _cut_sizes(self, texts: pa.StringArray) -> np.ndarray:
        texts = pc.if_else(pc.match_substring_regex(texts, _LINES), texts, pc.replace_substring(texts, "\n", " \n"))
        begins, place, words, firsts = self._split(texts)
        n = self._sizes_of_words(words).take(place)
        n[begins[:-1]] = self._plain(firsts.dictionary.to_pylist())[1].take(firsts.indices.to_numpy())
        return np.add.reduceat(n, begins[:-1])

    def _may_cut(self, texts: pa.StringArray) -> np.ndarray:
        if not self.by_words:
            return np.zeros(len(texts), bool)
        cut = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut = cut & ~pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        for a in self.added:
            cut = cut & ~pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        return cut

    def sizes(self, texts: list[str] | pa.StringArray) -> np.ndarray:
        """Number of ids of each text, as ``encode`` gives it, without putting the ids together."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = self._may_cut(texts)
        sizes = np.empty(len(texts), np.int64)
        if cut.any():
            sizes[cut] = self._cut_sizes(texts if cut.all() else texts.filter(pa.array(cut)))
        if not cut.all():
            sizes[~cut] = self._plain(texts.filter(pa.array(~cut)).to_pylist())[1]
        return sizes

    def encode(self, texts: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = self._may_cut(texts)
        if not cut.any():
            return self._plain(texts.to_pylist())
        if cut.all():
            return self._cut(texts)
        sizes = np.empty(len(texts), np.int64)
        held = [self._cut(texts.filter(pa.array(cut))), self._plain(texts.filter(pa.array(~cut)).to_pylist())]
        starts = np.empty(len(texts), np.int64)
        for (ids, n), mine, before in zip(held, (cut, ~cut), (0, len(held[0][0]))):
            sizes[mine] = n
            starts[mine] = before + np.cumsum(n) - n
        return gathered(np.concatenate([held[0][0], held[1][0]]), starts, sizes), sizes


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = CACHED_WORDS) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, remembered)
    if key not in _encoders:
        _encoders[key] = Encoder(path, remembered)
    return _encoders[key]


def groups(batch: pa.RecordBatch):
    """(first row, texts) of runs of rows of a batch's ``text`` that are encoded at once; null is empty."""
    texts = batch.column("text").cast(pa.string()).fill_null("")
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + BATCH_CHARS, "right")))
        yield first, texts.slice(first, end - first)
        first = end
