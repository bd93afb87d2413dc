"""Live transcripts as a stateful stream (STM1-STM7): the batch assembler inside keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from loomtext.operators.turns import CHANGES, TurnAssembler, message_id

_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]


class TurnProcessor(StatefulProcessor):
    """One assembler per (conversation, speaker), kept as JSON between batches."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("assembler", StructType([StructField("json", StringType())]), self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        conversation, speaker = key
        held = self.state.get() if self.state.exists() else None
        assembler = TurnAssembler.load(json.loads(held[0])) if held else TurnAssembler()
        events = pd.concat(list(rows)).sort_values(["seq", "ordinal"], kind="stable")
        out = []
        for seq, tag, text in zip(events["seq"], events["tag"], events["text"]):
            text = None if text is None or text != text else text
            for step, (change, number, original, translated) in enumerate(assembler.apply(tag, text)):
                out.append((int(conversation), speaker, int(seq), step, change, message_id(conversation, speaker, number), original, translated))
        self.state.update((json.dumps(assembler.dump()),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, idle: int | None = None) -> DataFrame:
    """Change log of a stream of (conv_id, speaker, seq, ordinal, tag, text); needs the RocksDB state store.

    The state of a conversation is dropped after ``idle`` milliseconds without events (``policies.IDLE_MS`` is a day), if that is given.
    """
    return events.select("conv_id", "speaker", "seq", "ordinal", "tag", "text").groupBy("conv_id", "speaker").transformWithStateInPandas(TurnProcessor(idle), CHANGES, "Update", "ProcessingTime" if idle else "None")


def upsert_into(path: str):
    """STM6: a ``foreachBatch`` sink of a change log.

    A batch writes the newest state of each of its messages into a folder of
    its own, so a repeated batch replaces itself; ``upserted`` reads the newest
    state over all folders, ``compact`` folds folders that are complete into one.
    """

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch.withColumn("first_seq", F.col("seq"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _newest(changes: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("seq", "step", "original", "translated"), F.struct("seq", "step")).alias("m")
    return changes.groupBy("conv_id", "speaker", "id").agg(newest, F.min("first_seq").alias("first_seq")).select("conv_id", "speaker", "id", "first_seq", "m.*")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message: its first number and its newest state."""
    rows = _newest(spark.read.parquet(path).drop("batch"))
    return rows.select("conv_id", "speaker", "id", F.col("first_seq").alias("seq"), "original", "translated")


def compact(spark: SparkSession, path: str, up_to: int) -> None:
    """Folds the folders of batches up to ``up_to`` into that of ``up_to``; run between batches.

    The folded rows are written aside and moved in place; were a folder left over by a crash, reading it again changes nothing.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in system.listStatus(hadoop(path)) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) <= up_to]
    if len(old) < 2:
        return
    _newest(spark.read.parquet(*[p.toString() for p in old])).write.mode("overwrite").parquet(f"{path}/_folded")
    target = hadoop(f"{path}/batch={up_to}")
    last = [p for p in old if p.getName() == target.getName()]
    for p in last:
        system.rename(p, hadoop(f"{path}/_replaced"))
    system.rename(hadoop(f"{path}/_folded"), target)
    for p in [*(p for p in old if p.getName() != target.getName()), hadoop(f"{path}/_replaced")]:
        system.delete(p, True)
