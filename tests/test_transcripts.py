import pytest
from pyspark.sql import functions as F

from loomtext.functions import merging
from loomtext.operators import turns
from loomtext.operators.sentences import split_sentences
from loomtext.operators.turns import ORIGINAL, TRANSLATION, TurnAssembler
from loomtext.streaming import flow
from loomtext.streaming.turns import assemble_stream


@pytest.mark.parametrize(
    ("text", "done", "rest"),
    [
        ("확인했습니다. 다음에 얘기해요... 아직", ["확인했습니다.", "다음에 얘기해요..."], "아직"),
        ("확인했습니다 좋은 생각이네요 내일 뵙지요 진행 중", ["확인했습니다", "좋은 생각이네요", "내일 뵙지요"], "진행 중"),
        ("좋아", [], "좋아"),
        ("알았어 다음", ["알았어"], "다음"),
        ("We need version 4.0 today. Next", ["We need version 4.0 today."], "Next"),
        ("버전 4.0입니다 다음", ["버전 4.0입니다"], "다음"),
        ("그는 게임 아이템을 샀다", [], "그는 게임 아이템을 샀다"),
        ("오늘 휴무임", ["오늘 휴무임"], ""),
        ('그가 "확인했습니다" 다음', ['그가 "확인했습니다"'], "다음"),
        ("Mr. Smith arrived. Next", ["Mr. Smith arrived."], "Next"),
        ("가" * 50_000, [], "가" * 50_000),
    ],
)
def test_sentences(text, done, rest):
    assert split_sentences(text) == (done, rest)


def test_translation_before_original():
    a = TurnAssembler()
    assert a.update(TRANSLATION, "Hello.") == []
    assert a.update(ORIGINAL, "안녕하세요.") == [("append", 0, "안녕하세요.", "Hello.")]
    assert a.draft == ("", "")


def test_rest_joins_the_last_message():
    a = TurnAssembler()
    assert a.update(ORIGINAL, "안녕하세요. 잘 가요.") == []
    assert a.update(TRANSLATION, "Hello and goodbye.") == [("append", 0, "안녕하세요.", "Hello and goodbye.")]
    assert a.draft[0] == "잘 가요."
    assert a.finish() == [("update", 0, "안녕하세요. 잘 가요.", "Hello and goodbye.")]


def test_draft_of_unpaired_translation():
    a = TurnAssembler()
    a.update(TRANSLATION, "Hello. Goodbye.")
    assert a.update(ORIGINAL, "안녕하세요 그리고 잘 가요.") == [("append", 0, "안녕하세요 그리고 잘 가요.", "Hello.")]
    assert a.draft[1] == "Goodbye."


def test_orphan_translation_is_dropped_and_interrupt_forgets():
    a = TurnAssembler()
    a.update(TRANSLATION, "Only a translation.")
    assert a.finish() == []
    a.update(ORIGINAL, "Half a")
    assert a.apply("interrupted", None) == [] and a.draft == ("", "")


def test_merging():
    assert merging.merge("hello wor", "world peace") == "hello world peace"
    assert merging.merge("I think we should go", "I think we could go") == "I think we could go"
    assert merging.merge("abc", "xyz") == "abc xyz" and merging.merge("abc", "abc") == "abc" and merging.merge("", "b") == "b"
    assert merging.overlap("a" * 300, "a" * 300) == 256


def test_batch_is_stream(spark, tmp_path):
    rows = []
    for conv in range(4):
        for seq, (tag, text) in enumerate([("inputTranscript", "One two. Three"), ("outputTranscript", "Eins zwei."), ("inputTranscript", "One two. Three four. Five."), ("turnComplete", None), ("outputTranscript", "Late."), ("inputTranscript", f"Number {conv}."), ("turnComplete", None)]):
            rows.append((conv, "me" if conv % 2 else "other", seq, 0, tag, text))
    schema = "conv_id long, speaker string, seq long, ordinal int, tag string, text string"
    events = spark.createDataFrame(rows, schema)
    for k in range(2):  # two files: the state is carried from one batch to the next
        events.where(F.col("seq") < 3 if k == 0 else F.col("seq") >= 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, turns.assemble(events).collect()))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = assemble_stream(stream).writeStream.format("memory").queryName("turns").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("turns").collect())) == want and len(want) >= 8


def test_cues():
    assert flow.cue_plan("Hello", "Hello there", 3) == {"preserved": 3, "tracked": "Hello there", "cue": {"start": 5, "text": " there"}, "reset": False}
    assert flow.cue_plan("Hello there", "Hello you", 8) == {"preserved": 6, "tracked": "Hello you", "cue": {"start": 6, "text": "you"}, "reset": True}
    assert flow.cue_plan("x", "", 1) == {"preserved": 0, "tracked": "", "cue": None, "reset": True}
    assert flow.advance([1.0, 2.0], 2.5) == ([1.0, 1.5], 0.0) and flow.advance([1.0], 20.0) == ([1.0], 8.0)


def test_flow_limits(spark):
    rows = spark.createDataFrame([(1, 0, i, 0.5) for i in range(12)], "k int, drain int, seq int, duration double")
    assert flow.bounded_events(rows, "k", "seq", 10).count() == 2
    assert sorted(r.seq for r in flow.newest_kept(rows, "k", "seq").collect()) == list(range(2, 12))
    assert flow.playback_accepted(rows, "k", "seq").count() == 4
