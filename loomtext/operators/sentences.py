"""Sentence segmentation of growing transcripts (SEG9)."""

from __future__ import annotations

import pyarrow as pa

from loomtext.functions.arrow import arrow_function

# Korean sentence endings, abbreviations and marks.
STRONG = ("습니다", "ㅂ니다", "입니다", "합니다", "됩니다", "군요", "네요", "지요", "죠")
AT_END_ONLY = ("임",)
WEAK = ("다", "어", "아")
FINAL = frozenset("다요죠어아임")
TERMINATORS = frozenset(".!?。！？…")
CLOSERS = frozenset("\"')]}”’»」』】〉》")
SEPARATORS = frozenset("\"')]}”’")
ABBREVIATIONS = frozenset(("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st"))
NEWLINES = frozenset("\n\r\x0b\x0c\x85\u2028\u2029")


class _Scanner:
    """Finds where sentences end in one trimmed text."""

    def __init__(self, text: str, trailing: bool):
        self.text, self.trailing, self.end = text, trailing, len(text)

    def past(self, at: int, chars) -> int:
        while at < self.end and self.text[at] in chars:
            at += 1
        return at

    def word_before(self, at: int) -> str:
        first = at
        while first and self.text[first - 1].isalpha():
            first -= 1
        return self.text[first:at].lower()

    def stop(self, at: int) -> int:
        """End of the sentence that a mark at ``at`` closes, or -1."""
        t = self.text
        if t[at] != ".":
            return self.past(at + 1, CLOSERS)
        between_digits = 0 < at < self.end - 1 and t[at - 1].isnumeric() and t[at + 1].isnumeric()
        if between_digits or at and t[at - 1] == "." or self.word_before(at) in ABBREVIATIONS:
            return -1
        return self.past(self.past(at + 1, "."), CLOSERS)

    def korean(self, end: int) -> bool:
        """Whether the syllable before ``end`` ends a sentence."""
        t = self.text
        apart = end < self.end and (t[end].isspace() or t[end] in SEPARATORS)
        if t.endswith(STRONG, 0, end):
            return apart or end == self.end and self.trailing
        if t.endswith(AT_END_ONLY, 0, end):
            return self.trailing and self.past(end, CLOSERS) == self.end
        return apart and t.endswith(WEAK, 0, end)

    def ends(self):
        at = 0
        while at < self.end:
            c = self.text[at]
            if c in TERMINATORS or c in NEWLINES:
                stop = self.stop(at)
                if stop > 0:
                    yield stop
                    at = stop
                    continue
            elif c in FINAL and self.korean(at + 1):
                yield self.past(at + 1, CLOSERS)
            at += 1


def split_sentences(text: str, trailing: bool = True) -> tuple[list[str], str]:
    """(completed sentences, rest) of a transcript; ``trailing``: an ending at the very end counts."""
    text = text.replace("\r\n", "\n").strip()
    done, at = [], 0
    for end in _Scanner(text, trailing).ends():
        if part := text[at:end].strip():
            done.append(part)
        at = max(at, end)
    return done, text[at:].strip()


_SPLIT = pa.struct([("completed", pa.list_(pa.string())), ("remainder", pa.string())])


@arrow_function(_SPLIT)
def sentences(text: pa.Array) -> pa.Array:
    """Column form, endings at the end of the text counted."""
    found = [split_sentences(x or "") for x in text.to_pylist()]
    return pa.array([{"completed": a, "remainder": b} for a, b in found], _SPLIT)
