"""Two-sided live transcripts: turns assembled from text snapshots (STM1-STM7, JN14).

``TurnAssembler`` is the one implementation; ``assemble`` runs it over a table
(grouped by conversation and direction, in order) and
``loomtext.streaming.turns`` runs it inside a stateful stream, so batch and
stream agree.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions.merging import merge
from loomtext.operators.sentences import split_sentences

ORIGINAL, TRANSLATION = "original", "translation"


def spaced(*parts: str) -> str:
    return " ".join(x for x in map(str.strip, parts) if x)


@dataclass
class Side:
    """What is known of one side of a turn."""

    consumed: str = ""
    buffer: str = ""
    queue: list[str] = field(default_factory=list)

    @property
    def visible(self) -> str:
        return spaced(*self.queue, self.buffer)

    def _drain(self, trailing: bool) -> None:
        done, rest = split_sentences(self.buffer, trailing)
        if done:
            self.buffer = rest
        for sentence in done:
            self._queue(sentence)

    def _queue(self, sentence: str) -> None:
        self.queue.append(sentence)
        self.consumed = merge(self.consumed, sentence)

    def take(self, snapshot: str) -> bool:
        """Whether the snapshot changed what is visible."""
        new, used = snapshot.strip(), self.consumed.strip()
        if used and new.startswith(used):
            new = new[len(used) :].strip()
        if not new:
            return False
        before = self.visible
        self.buffer = merge(self.buffer, new)
        self._drain(False)
        return self.visible != before

    def close(self) -> None:
        self._drain(True)
        if rest := self.buffer.strip():
            self._queue(rest)
        self.buffer = ""

    def pop(self, count: int) -> str:
        taken, self.queue = self.queue[:count], self.queue[count:]
        return spaced(*taken)


@dataclass
class TurnAssembler:
    """State of one conversation direction; every call returns the changes it makes.

    A change is (``append`` or ``update``, message number, original, translated).
    """

    sides: dict[str, Side] = field(default_factory=lambda: {ORIGINAL: Side(), TRANSLATION: Side()})
    last: list | None = None  #: number, original, translated of the turn's newest message
    numbered: int = 0

    def _append(self, original: str, translated: str):
        self.last = [self.numbered, original, translated]
        self.numbered += 1
        return ("append", *self.last)

    def _extend(self, original: str, translated: str):
        self.last = [self.last[0], spaced(self.last[1], original), spaced(self.last[2], translated)]
        return ("update", *self.last)

    def _pair(self):
        a, b = self.sides[ORIGINAL], self.sides[TRANSLATION]
        while a.queue and b.queue:
            yield self._append(a.pop(1), b.pop(1))

    def update(self, name: str, text: str) -> list[tuple]:
        side = self.sides[name]
        waiting = len(side.queue)
        changes = []
        if side.take(text) and waiting and self.last:
            # sentences that found no partner belong to the message before, once this side moves on
            late = side.pop(waiting)
            if late:
                changes.append(self._extend(late if name == ORIGINAL else "", late if name == TRANSLATION else ""))
        return [*changes, *self._pair()]

    def finish(self) -> list[tuple]:
        """The turn is complete: everything is flushed and the state cleared."""
        for side in self.sides.values():
            side.close()
        changes = list(self._pair())
        original, translated = (self.sides[n].pop(len(self.sides[n].queue)) for n in (ORIGINAL, TRANSLATION))
        if self.last and (original or translated):
            changes.append(self._extend(original, translated))
        elif original:
            changes.append(self._append(original, translated))
        self.reset()
        return changes

    def reset(self) -> list[tuple]:
        self.sides = {ORIGINAL: Side(), TRANSLATION: Side()}
        self.last = None
        return []

    @property
    def draft(self) -> tuple[str, str]:
        return self.sides[ORIGINAL].visible, self.sides[TRANSLATION].visible

    def apply(self, tag: str, text: str | None) -> list[tuple]:
        """One event: inputTranscript, outputTranscript, turnComplete or interrupted; others change nothing."""
        if tag == "inputTranscript":
            return self.update(ORIGINAL, text or "")
        if tag == "outputTranscript":
            return self.update(TRANSLATION, text or "")
        if tag == "turnComplete":
            return self.finish()
        return self.reset() if tag == "interrupted" else []

    def dump(self) -> dict:
        return {"sides": {k: asdict(v) for k, v in self.sides.items()}, "last": self.last, "numbered": self.numbered}

    @classmethod
    def load(cls, data: dict) -> TurnAssembler:
        return cls({k: Side(**v) for k, v in data["sides"].items()}, data["last"], data["numbered"])


def message_id(conversation, speaker: str, number: int) -> str:
    """Replayable id: the same events give the same message."""
    return hashlib.sha256(f"{conversation}/{speaker}/{number}".encode()).hexdigest()[:32]


CHANGES = "conv_id long, speaker string, seq long, step int, change string, id string, original string, translated string"


def _rows(conversation, speaker, events):
    assembler = TurnAssembler()
    for seq, tag, text in events:
        for step, (change, number, original, translated) in enumerate(assembler.apply(tag, text)):
            yield conversation, speaker, seq, step, change, message_id(conversation, speaker, number), original, translated


def _assemble(key: tuple[pa.Scalar, ...], events: pa.Table) -> pa.Table:
    events = events.sort_by([("seq", "ascending"), ("ordinal", "ascending")])
    found = list(_rows(key[0].as_py(), key[1].as_py(), zip(*(events.column(c).to_pylist() for c in ("seq", "tag", "text")))))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in CHANGES.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 8, types)], names)


def assemble(events: DataFrame) -> DataFrame:
    """Change log of event rows (conv_id, speaker, seq, ordinal, tag, text). A conversation's direction is one group."""
    return events.select("conv_id", "speaker", "seq", "ordinal", "tag", "text").groupBy("conv_id", "speaker").applyInArrow(_assemble, CHANGES)


def latest_messages(changes: DataFrame) -> DataFrame:
    """STM6: the newest state of every message of a change log."""
    newest = F.max_by(F.struct("original", "translated"), F.struct("seq", "step")).alias("m")
    return changes.groupBy("conv_id", "speaker", "id").agg(F.min("seq").alias("seq"), newest).select("conv_id", "speaker", "id", "seq", "m.original", "m.translated")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str, a: str, b: str) -> DataFrame:
    """JN14: k-th row of the left with the k-th row of the right, per key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return left.select(key, place.alias("k"), F.col(a).alias("a")).join(right.select(key, place.alias("k"), F.col(b).alias("b")), [key, "k"])
