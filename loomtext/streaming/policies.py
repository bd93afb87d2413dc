"""Flow policies of live input as streams (STM8-STM13).

Policies that fold a key's rows in order are one function each, from the held
state and the new rows to the next state and what is given out; the same
function runs over a whole table (``folded``) and inside keyed state of a
stream (``fold_stream``).  A stream that runs on may drop the state of keys that
have been idle for ``idle`` milliseconds (``IDLE_MS`` is a day); that takes
processing time, in which a stream never finds that all is done, so a run over
what is available is made without.  Debouncing waits in event time; coalescing
is a window aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtext.streaming.flow import advance, cue_plan

Fold = Callable[[dict | None, list[dict]], tuple[dict, list[tuple]]]
IDLE_MS = 24 * 3_600_000


def refused_events(capacity: int = 128) -> Fold:
    """STM10: rows (drain, seq) that find ``capacity`` unread ones of their drain before them."""

    def fold(held, rows):
        held = held or {"drain": None, "n": 0}
        out = []
        for r in rows:
            if r["drain"] != held["drain"]:
                held = {"drain": r["drain"], "n": 0}
            held["n"] += 1
            if held["n"] > capacity:
                out.append((r["drain"], r["seq"]))
        return held, out

    return fold


def played(seconds: float = 2.0) -> Fold:
    """STM10: rows (drain, seq, duration) that fit into the playback buffer between two drains; a refused one takes its time as well."""

    def fold(held, rows):
        held = held or {"drain": None, "used": 0.0}
        out = []
        for r in rows:
            if r["drain"] != held["drain"]:
                held = {"drain": r["drain"], "used": 0.0}
            held["used"] += r["duration"]
            if held["used"] <= seconds + 1e-9:
                out.append((r["drain"], r["seq"]))
        return held, out

    return fold


def newest_sent(capacity: int = 10) -> Fold:
    """STM10: the newest ``capacity`` rows of a drain, given out when the next drain begins."""

    def fold(held, rows):
        held = held or {"drain": None, "kept": []}
        out = []
        for r in rows:
            if r["drain"] != held["drain"]:
                out += [(held["drain"], s) for s in held["kept"]]
                held = {"drain": r["drain"], "kept": []}
            held["kept"] = [*held["kept"], r["seq"]][-capacity:]
        return held, out

    return fold


def cues_of_updates(highlight: int = 0) -> Fold:
    """STM11: rows (seq, text), growing or rewritten -> (seq, preserved, start, reset): what is still to be spoken."""

    def fold(held, rows):
        before, out = (held or {"text": ""})["text"], []
        for r in rows:
            plan = cue_plan(before, r["text"] or "", highlight)
            out.append((r["seq"], plan["preserved"], plan["cue"]["start"] if plan["cue"] else -1, plan["reset"]))
            before = plan["tracked"]
        return {"text": before}, out

    return fold


def spoken_cues(most: float = 8.0) -> Fold:
    """STM12: rows (seq, duration, elapsed): cues join the queue, elapsed time is spoken of it -> (seq of the clock, place, spoken)."""

    def fold(held, rows):
        held = held or {"queue": [], "carried": 0.0}
        out = []
        for r in rows:
            if r["duration"] == r["duration"] and r["duration"] is not None:
                held["queue"].append([r["seq"], r["duration"]])
            if r["elapsed"] == r["elapsed"] and r["elapsed"] is not None:
                spoken, held["carried"] = advance([d for _, d in held["queue"]], r["elapsed"], held["carried"], most)
                out += [(r["seq"], place, s) for (place, _), s in zip(held["queue"], spoken) if s > 0]
                held["queue"] = [[place, d - s] for (place, d), s in zip(held["queue"], spoken) if d - s > 1e-9]
        return held, out

    return fold


def items_of_turns() -> Fold:
    """STM13: rows (seq, turn_id, view, item): ``turn`` makes a turn known, ``full`` replaces its items, ``delta`` adds one.

    Items of a turn that is not yet known wait for it; what is given out is (seq, turn_id, number of items, items).
    """

    def fold(held, rows):
        held = held or {"known": [], "items": {}}
        out = []
        for r in rows:
            turn = r["turn_id"]
            if r["view"] == "turn":
                held["known"] = sorted({*held["known"], turn})
            elif r["view"] == "full":
                held["items"][turn] = [r["item"]]
            else:
                held["items"].setdefault(turn, []).append(r["item"])
            if turn in held["known"] and held["items"].get(turn):
                out.append((r["seq"], turn, len(held["items"][turn]), ",".join(held["items"][turn])))
        return held, out

    return fold


def _schema(rows: DataFrame, keys: tuple[str, ...], out: str) -> str:
    types = dict(rows.dtypes)
    return ", ".join([*(f"{k} {types[k]}" for k in keys), out])


def folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Fold, out: str) -> DataFrame:
    """The fold over each key's rows of a table; a key's rows are one group."""
    names = [*keys, *(c.split()[0] for c in out.split(", "))]

    def run(key: tuple[object, ...], part: pd.DataFrame) -> pd.DataFrame:
        _, got = fold(None, part.sort_values(list(order), kind="stable").to_dict("records"))
        return pd.DataFrame([(*key, *g) for g in got], columns=names)

    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, out))


class _Folder(StatefulProcessor):
    def __init__(self, order: tuple[str, ...], fold: Fold, names: list[str], idle: int | None):
        self.order, self.fold, self.names, self.idle = list(order), fold, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", StructType([StructField("json", StringType())]), self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records")
        held, got = self.fold(held, part)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame([(*key, *g) for g in got], columns=self.names)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Fold, out: str, idle: int | None = None) -> DataFrame:
    """The fold over each key's rows of a stream, in the order of ``order`` within a batch; needs the RocksDB state store."""
    names = [*keys, *(c.split()[0] for c in out.split(", "))]
    return rows.groupBy(*keys).transformWithStateInPandas(_Folder(order, fold, names, idle), _schema(rows, keys, out), "Append", "ProcessingTime" if idle else "None")


class _Debouncer(StatefulProcessor):
    """Holds the newest event of a key until the key has been idle in event time."""

    def __init__(self, at: str, number: str, idle_ms: int, names: list[str]):
        self.at, self.number, self.idle_ms, self.names = at, number, idle_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", StructType([StructField("micros", LongType()), StructField("number", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values([self.at, self.number], kind="stable")
        held = self.state.get() if self.state.exists() else None
        if held:
            self.handle.deleteTimer(held[0] // 1000 + self.idle_ms + 1)
        fired = []
        for micros, number in zip(part[self.at].astype("datetime64[us]").astype("int64"), part[self.number]):
            if held and micros - held[0] > self.idle_ms * 1000:
                fired.append((*key, held[1]))
            if not held or (micros, number) >= tuple(held):
                held = (int(micros), int(number))
        self.state.update(held)
        self.handle.registerTimer(held[0] // 1000 + self.idle_ms + 1)
        yield pd.DataFrame(fired, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        self.state.clear()
        yield pd.DataFrame([(*key, held[1])] if held else [], columns=self.names)

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, key: str, at: str = "ts", number: str = "event_id", idle_seconds: float = 1.0, late: str = "0 seconds") -> DataFrame:
    """STM8: (key, number) of the newest event of each burst, once the watermark is ``idle_seconds`` past it."""
    rows = events.select(key, F.col(at).cast("timestamp").alias(at), F.col(number).cast("long").alias(number)).withWatermark(at, late)
    work = _Debouncer(at, number, int(idle_seconds * 1000), [key, number])
    return rows.groupBy(key).transformWithStateInPandas(work, f"{key} {dict(rows.dtypes)[key]}, {number} long", "Append", "EventTime")


def coalesced_stream(events: DataFrame, key: str, at: str = "ts", millis: int = 100, late: str = "0 seconds") -> DataFrame:
    """STM9: of the changes of a key within one interval the newest; state of an interval goes with the watermark."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    slots = rows.groupBy(key, F.window(at, f"{millis} milliseconds").alias("w")).agg(F.max_by("event_id", F.struct(at, "event_id")).alias("event_id"), F.count("*").alias("changes"))
    return slots.select(key, F.floor(F.unix_millis("w.start") / millis).alias("slot"), "event_id", "changes")
