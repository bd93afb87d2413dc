"""Flow policies as streams give what they give over the whole table."""

import random

import pytest
from loomtext.operators import turns
from loomtext.streaming import flow, policies
from loomtext.streaming.turns import assemble_stream, compact, upsert_into, upserted
from pyspark.sql import functions as F


def in_files(df, folder, order, files):
    """The table as a folder of files that a stream reads one after the other."""
    n = df.count()
    rows = df.orderBy(order).collect()
    for k in range(files):
        part = rows[k * n // files : (k + 1) * n // files]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def drained(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(100) and query.exception() is None
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


FOLDS = {
    "refused": (policies.refused_events(3), "drain long, seq long"),
    "played": (policies.played(1.0), "drain long, seq long"),
    "sent": (policies.newest_sent(2), "drain long, seq long"),
    "cues": (policies.cues_of_updates(2), "seq long, preserved int, start int, reset boolean"),
    "spoken": (policies.spoken_cues(1.5), "seq long, place long, spoken double"),
    "items": (policies.items_of_turns(), "seq long, turn_id string, n int, items string"),
}


@pytest.mark.parametrize("name", list(FOLDS))
def test_folds_over_a_stream_equal_the_table(spark, tmp_path, name):
    rng = random.Random(name)
    rows = []
    for k in range(3):
        text = ""
        for seq in range(24):
            text = text + rng.choice([" more", " and so on"]) if rng.random() < 0.7 else rng.choice(["", "new text"])
            rows.append((k, seq, seq // 6, 0.25 * rng.randint(1, 3) if seq % 4 else None, 0.5 if seq % 5 == 4 else None, text, rng.choice("abc"), rng.choice(["turn", "full", "delta", "delta"]), f"i{seq}"))
    schema = "k long, seq long, drain long, duration double, elapsed double, text string, turn_id string, view string, item string"
    df = spark.createDataFrame([r[:3] + ((r[3] or 0.25) if name == "played" else r[3],) + r[4:] for r in rows], schema)
    fold, out = FOLDS[name]
    want = sorted(map(tuple, policies.folded(df, ("k",), ("seq",), fold, out).collect()))
    stream = policies.fold_stream(in_files(df, str(tmp_path / "in"), "seq", 3), ("k",), ("seq",), fold, out)
    assert drained(stream, f"fold_{name}", tmp_path) == want and want


def test_folds_equal_the_window_forms(spark):
    rows = spark.createDataFrame([(k, i // 9, i, 0.5) for k in range(4) for i in range(40 + k)], "k long, drain long, seq long, duration double")
    pairs = lambda df: sorted((r.k, r.drain, r.seq) for r in df.collect())
    one = "drain long, seq long"
    assert pairs(policies.folded(rows, ("k",), ("seq",), policies.refused_events(5), one)) == pairs(flow.bounded_events(rows, "k", "seq", 5))
    assert pairs(policies.folded(rows, ("k",), ("seq",), policies.played(2.0), one)) == pairs(flow.playback_accepted(rows, "k", "seq"))
    last = rows.groupBy("k").agg(F.max("drain").alias("last"))
    want = flow.newest_kept(rows, "k", "seq", 4).join(last, "k").where("drain < last")  # the last drain is not over
    assert pairs(policies.folded(rows, ("k",), ("seq",), policies.newest_sent(4), one)) == pairs(want)


def test_items_wait_for_their_turn():
    fold = policies.items_of_turns()
    rows = [dict(seq=i, turn_id=t, view=v, item=x) for i, (t, v, x) in enumerate([("a", "delta", "1"), ("b", "delta", "2"), ("a", "turn", None), ("a", "delta", "3"), ("a", "full", "4"), ("b", "turn", None)])]
    held, first = fold(None, rows[:2])
    assert first == []
    assert fold(held, rows[2:])[1] == [(2, "a", 1, "1"), (3, "a", 2, "1,3"), (4, "a", 1, "4"), (5, "b", 1, "2")]


def test_debounce_and_coalescing_over_a_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(2)
    at, rows = 0.0, []
    for i in range(120):
        at += rng.choice([0.2, 0.4, 2.5])
        rows.append((rng.randrange(4), 1_700_000_000_000 + int(at * 1000), i))
    rows.append((9, 1_700_000_900_000, 998))  # a later event, so that the bursts before it are over
    df = spark.createDataFrame(rows, "user_id long, ms long, event_id long").select("user_id", F.timestamp_millis("ms").alias("ts"), "event_id")
    want = sorted((r.user_id, r.event_id) for r in flow.debounced(df, "user_id").collect() if r.user_id != 9)
    got = drained(policies.debounced_stream(in_files(df, str(tmp_path / "a"), "ts", 4), "user_id"), "debounced", tmp_path)
    assert [g for g in got if g[0] != 9] == want
    want = sorted(map(tuple, flow.coalesced_writes(df, "user_id", millis=500).select("user_id", "slot", "event_id", "changes").collect()))
    got = drained(policies.coalesced_stream(in_files(df, str(tmp_path / "b"), "ts", 4), "user_id", millis=500), "coalesced", tmp_path)
    assert set(got) <= set(want) and {w for w in want if w[0] != 9} <= set(got)


def test_upserts_keep_the_newest_state(spark, tmp_path):
    rows = [(c, "other", s, 0, tag, text) for c in range(3) for s, (tag, text) in enumerate([("inputTranscript", "One two. Three"), ("outputTranscript", "Eins."), ("inputTranscript", "One two. Three four."), ("turnComplete", None), ("inputTranscript", f"Next {c}."), ("turnComplete", None)])]
    events = spark.createDataFrame(rows, "conv_id long, speaker string, seq long, ordinal int, tag string, text string")
    path = str(tmp_path / "messages")
    stream = assemble_stream(in_files(events, str(tmp_path / "in"), "seq", 3))
    query = stream.writeStream.foreachBatch(upsert_into(path)).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    want = sorted(map(tuple, turns.latest_messages(turns.assemble(events)).select("conv_id", "speaker", "id", "seq", "original", "translated").collect()), key=repr)
    assert sorted(map(tuple, upserted(spark, path).collect()), key=repr) == want and len(want) >= 6
    compact(spark, path, 1)
    assert sorted(map(tuple, upserted(spark, path).collect()), key=repr) == want
