"""Vectorised hashes of words and word shingles (numpy, 64 bits).

A word is a run of bytes other than ASCII white space.  A word's hash is a
polynomial over random byte codes, taken as the difference of two prefix sums
modulo 2**64, so a text of any length costs a few passes over its bytes, and
many short texts are hashed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  #: bytes hashed at once; memory does not follow the length of a text
GROUP = 1 << 16  #: bytes of short texts hashed together, which stay in a processor's cache
SHINGLE = 5

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    step = _U(base)
    while filled < n:
        k = min(filled, n - filled)
        out[filled : filled + k] = out[:k] * step
        filled += k
        step = step * step
    return out


def _spaces(a: np.ndarray) -> np.ndarray:
    return (a == 32) | ((a - np.uint8(9)) < 5)


def in_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of 64-bit hashes in ascending order, equal ones in the order they stand; the hashes in it): a stable ``argsort``, by a sort of plain numbers."""
    low = _U((1 << max(1, len(h).bit_length())) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the upper bits of a hash, and its place
    key.sort()
    order = (key & low).view(np.int64)
    found = h.take(order)
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):  # hashes that differ in the lower bits alone
        again = np.flatnonzero(np.isin(key & ~low, key[wrong] & ~low))
        some = order[again]
        order[again] = some[np.lexsort((some, h.take(some)))]
        found = h.take(order)
    return order, found


class WordHasher:
    """One family member per ``seed``; equal seeds hash alike in every process."""

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        with np.errstate(over="ignore"):
            base = int(rng.integers(1, 1 << 61)) * 8 + 5
            inverse = pow(base, -1, 1 << 64)
            self.up = _powers(base, BLOCK + 1)
            self.down = _powers(inverse, BLOCK + 1)
            self.word_base = int(rng.integers(1, 1 << 61)) * 8 + 5
        self.seed = _U(int(rng.integers(1, 1 << 62)))

    def _block(self, a: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words, where they start)."""
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        if not space[-1]:
            edge = np.concatenate((edge, [len(a)]))
        start, end = edge[0::2], edge[1::2]
        prefix = np.empty(len(a) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(self.codes.take(a) * self.up[: len(a)], out=prefix[1:])
        h = (prefix.take(end) - prefix.take(start)) * self.down.take(start)
        return _mix(h + self.seed + (end - start).astype(np.uint64)), start

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, in order (none for null or blank texts)."""
        data = (text or "").encode("utf-8", "surrogatepass")
        a = np.frombuffer(data, np.uint8)
        if not len(a):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            space = _spaces(a)
            if len(a) <= BLOCK:
                return self._block(a, space)[0]
            out, at = [], 0
            gaps = np.flatnonzero(space)
            while at < len(a):
                if len(a) - at <= BLOCK:
                    end = len(a)
                else:
                    k = int(np.searchsorted(gaps, at + BLOCK, "right")) - 1
                    end = int(gaps[k]) + 1 if k >= 0 and gaps[k] >= at else 0
                    if end <= at:  # one word longer than a block: hash it by itself
                        k = int(np.searchsorted(gaps, at + BLOCK))
                        end = int(gaps[k]) if k < len(gaps) else len(a)
                        out.append(self._giant(a[at:end]))
                        at = end
                        continue
                out.append(self._block(a[at:end], space[at:end])[0])
                at = end
            return np.concatenate(out)

    def _giant(self, a: np.ndarray) -> np.ndarray:
        import hashlib

        key = int(self.seed).to_bytes(8, "little")
        return np.frombuffer(hashlib.blake2b(a.tobytes(), digest_size=8, key=key).digest(), np.uint64).copy()

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of every run of ``k`` consecutive words (none if there are fewer)."""
        n = len(words) - k + 1
        if n < 1:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            if k <= 8:
                h = np.zeros(n, np.uint64)
                for j in range(k):
                    h *= _U(self.word_base)
                    h += words[j : j + n]
                return _mix(h + self.seed)
            # Horner over prefix sums: sum of words[i + j] * base ** j
            up = _powers(self.word_base, len(words))
            prefix = np.empty(len(words) + 1, np.uint64)
            prefix[0] = 0
            np.cumsum(words * up, out=prefix[1:])
            down = _powers(pow(self.word_base, -1, 1 << 64), n)
            return _mix((prefix[k:] - prefix[:n]) * down + self.seed)

    def shingles(self, words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
        """Hashes of word shingles; a text of fewer words than ``k`` has one, of all its words."""
        if not len(words):
            return words
        return self.windows(words, min(k, len(words)))

    def shingles_of(self, texts: pa.Array | pa.ChunkedArray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the shingles of all texts, the number of each one's text): those of ``shingles``, for many texts at once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ended = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))  # a blank ends each text
        if not len(ended):
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        _, offsets, data = ended.buffers()
        offsets = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
        data = np.frombuffer(data, np.uint8)
        hashes, owners, at = [], [], 0
        while at < len(ended):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
            a = data[offsets[at] : offsets[end]]
            if len(a) > BLOCK:  # a long text is a group of its own
                h = self.shingles(self.words(texts[at].as_py()), k)
                hashes.append(h)
                owners.append(np.full(len(h), at, np.int32))
            else:
                with np.errstate(over="ignore"):
                    words, start = self._block(a, _spaces(a))
                sizes = np.diff(np.searchsorted(start, offsets[at : end + 1] - offsets[at]))
                owner = np.repeat(np.arange(at, end, dtype=np.int32), sizes)
                if len(words) >= k:
                    whole = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1])
                    hashes.append(self.windows(words, k).take(whole))
                    owners.append(owner.take(whole))
                ends = np.cumsum(sizes)
                for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
                    hashes.append(self.windows(words[ends[i] - sizes[i] : ends[i]], int(sizes[i])))
                    owners.append(np.array([at + i], np.int32))
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        return np.concatenate(hashes), np.concatenate(owners)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x.copy())


def int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
