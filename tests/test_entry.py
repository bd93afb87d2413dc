import importlib.util
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows_and_a_stable_schema(spark):
    out = entry.entry(spark)
    assert out.limit(1).count() == 1
    assert out.columns == ["doc_id", "chunk", "id", "segments", "first_segment", "character_count", "estimated_token_count"]


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "loomtext").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "loomtext").parts:
            assert "loomtext.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


def test_flagship_needs_no_shuffle(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_chunk_scan_reads_two_columns(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_guard_sees_whether_the_operators_are_there():
    assert entry._HAS_LLM == (importlib.util.find_spec("loomtext.llm") is not None and (ROOT / "corpus_pipeline.py").is_file())
