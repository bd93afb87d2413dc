"""Flow policies of live input (STM8-STM13) on tables; a stream uses trigger intervals and source limits for the same ends."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions.arrow import arrow_function
from loomtext.functions.merging import common_prefix
from loomtext.functions.timing import speech_seconds


def debounced(events: DataFrame, key: str, at: str = "ts", idle_seconds: float = 1.0) -> DataFrame:
    """STM8: events after which their key is idle: the latest of each burst."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    wait = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return events.withColumn("wait", wait).where(F.col("wait").isNull() | (F.col("wait") > idle_seconds)).drop("wait")


def coalesced_writes(events: DataFrame, key: str, at: str = "ts", millis: int = 100) -> DataFrame:
    """STM9: of the changes of a key within one interval the newest is written."""
    slot = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / millis)
    return events.withColumn("slot", slot).groupBy(key, "slot").agg(F.max_by("event_id", F.struct(at, "event_id")).alias("event_id"), F.count("*").alias("changes"))


def bounded_events(events: DataFrame, key: str, order: str, capacity: int = 128) -> DataFrame:
    """STM10: events that a buffer of ``capacity`` unread ones would refuse (an error for the session)."""
    n = F.row_number().over(Window.partitionBy(key, "drain").orderBy(order))
    return events.withColumn("n", n).where(F.col("n") > capacity).drop("n")


def newest_kept(chunks: DataFrame, key: str, order: str, capacity: int = 10) -> DataFrame:
    """STM10: of what waits for one send, the newest chunks."""
    n = F.row_number().over(Window.partitionBy(key, "drain").orderBy(F.desc(order)))
    return chunks.withColumn("n", n).where(F.col("n") <= capacity).drop("n")


def playback_accepted(chunks: DataFrame, key: str, order: str, seconds: float = 2.0) -> DataFrame:
    """STM10: chunks that fit into the playback buffer between two drains; later ones are refused."""
    used = F.sum("duration").over(Window.partitionBy(key, "drain").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("used", used).where(F.col("used") <= seconds + 1e-9).drop("used")


def cue_plan(previous: str, updated: str, highlight: int) -> dict:
    """STM11: what of an updated text is still to be spoken.

    A grown text keeps its highlight and adds the new end; a rewritten one
    falls back to the common beginning and resets the queue.
    """
    before, now = previous.strip(), updated.strip()
    mark = min(max(0, highlight), len(now))
    grown = now.startswith(before)
    if not now:
        kept, start, reset = 0, 0, bool(before)
    elif grown:
        kept, start, reset = mark, max(len(before), mark), False
    else:
        kept = start = min(mark, common_prefix(before, now))
        reset = True
    cue = {"start": start, "text": now[start:]} if start < len(now) else None
    return {"preserved": kept, "tracked": now, "cue": cue, "reset": reset}


_PLAN = pa.struct([("preserved", pa.int32()), ("tracked", pa.string()), ("cue", pa.struct([("start", pa.int32()), ("text", pa.string())])), ("reset", pa.bool_())])


@arrow_function(_PLAN)
def cue_plans(previous: pa.Array, updated: pa.Array, highlight: pa.Array) -> pa.Array:
    return pa.array([cue_plan(a or "", b or "", h or 0) for a, b, h in zip(previous.to_pylist(), updated.to_pylist(), highlight.to_pylist())], _PLAN)


def advance(durations: list[float], elapsed: float, carried: float = 0.0, most: float = 8.0) -> tuple[list[float], float]:
    """STM12: seconds spoken of each queued cue, and what is left over, carried up to ``most``."""
    left, spoken = elapsed + carried, []
    for d in durations:
        spoken.append(min(d, max(0.0, left)))
        left -= spoken[-1]
    return spoken, min(max(0.0, left), most)


def cue_advance(cues: DataFrame, elapsed: DataFrame, key: str) -> DataFrame:
    """STM12 on tables: each queued cue's spoken seconds by a running sum of the durations before it."""
    before = F.coalesce(F.sum("duration").over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = cues.withColumn("before", before).join(elapsed.select(key, "elapsed"), key)
    return rows.withColumn("spoken", F.least(F.col("duration"), F.greatest(F.lit(0.0), F.col("elapsed") - F.col("before")))).drop("before")


def timed(cues: DataFrame, text: str = "text") -> DataFrame:
    return cues.withColumn("duration", speech_seconds(F.col(text)))


def turn_items(events: DataFrame, turns: DataFrame) -> DataFrame:
    """STM13: items of each turn in order of arrival, early ones included; a full view replaces what came before it.

    ``events``: session, seq, turn_id, view, item; ``turns``: session, turn_id.
    """
    mine = events.join(turns, ["session", "turn_id"])
    full = mine.where(F.col("view") == "full").groupBy("session", "turn_id").agg(F.max("seq").alias("from_seq"))
    kept = mine.join(full, ["session", "turn_id"], "left").where(F.col("seq") >= F.coalesce("from_seq", F.lit(-1)))
    return kept.groupBy("session", "turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]).alias("items"))
