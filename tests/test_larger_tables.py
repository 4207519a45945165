"""Tables larger than the test tables, or with keys beyond theirs."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsift.operators import chunking, skew
from quillsift.plans.queries import ORACLES, QUERIES
from quillsift.sources import documents
from tests.oracle import same


def test_colours_of_large_keys(spark, tmp_path):
    """Keys of a 1 GB copy: a key times 7919 passes an int's range."""
    keys = [0, 1, 271_176, 271_177, 542_352, 1_199_999, 600_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    same(spark, str(tmp_path), QUERIES["color_luminance"], ORACLES["color_luminance"])


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_task_numbers_of_many_rows(spark, tmp_path, uncoalesced):
    """More rows than range bounds are drawn from: numbers come from the same ranges that are counted."""
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 501).alias("user_id"), F.concat(F.lit("e"), F.col("id") % 5).alias("event_type"))
    rows.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    same(spark, str(tmp_path), QUERIES["task_enqueue"], ORACLES["task_enqueue"])


def test_large_batches_give_few_documents_at_a_time():
    """A batch of 10,000 rows is answered in pieces, so a task doesn't hold what all its rows give."""
    texts = pd.Series([f"Text {k}. " * (k % 4) for k in range(1000)])
    chunks = list(chunking.chunk_batches([(texts, pd.Series([None] * 1000))]))
    assert max(map(len, chunks)) <= chunking.HELD and [x for part in chunks for x in part] == [chunking.chunk_text(t, None) for t in texts]
    kinds = pd.Series([documents.TEXT, documents.PDF] * 500)
    pages = list(documents.read_batches([(kinds, texts.map(str.encode))], None))
    assert max(map(len, pages)) <= documents.HELD
    assert pd.concat(pages)["error"].tolist() == [None, "unsupported_media_type"] * 500
    assert [p[0] for part in pages for p in part["texts"] if p is not None] == texts[::2].tolist()


@pytest.mark.parametrize("name", ["rubric_content_hash", "score_aggregate", "score_capped_rank", "weight_normalize"])
def test_rubrics_are_dealt_to_tasks_by_their_rows(spark, data, monkeypatch, name):
    """Tasks grow in number with the line items, not in size, and the result is the same."""
    monkeypatch.setattr(skew, "TASK_ROWS", 500)
    df = QUERIES[name](spark, data)
    assert "hashpartitioning(l_orderkey" in (plan := df._jdf.queryExecution().executedPlan().toString()) and plan.count("hashpartitioning(") == 1 and ", 12)" in plan
    same(spark, data, lambda *_: df, ORACLES[name])


@pytest.mark.parametrize(("name", "tasks"), [("job_answers", 8), ("judge_answers", 60)])
def test_answers_are_dealt_to_tasks_by_their_rows(spark, data, monkeypatch, name, tasks):
    """A small file's rows are parsed by several tasks."""
    monkeypatch.setattr(skew, "ANSWER_ROWS", 20)
    df = QUERIES[name](spark, data)
    assert f"{tasks}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    same(spark, data, lambda *_: df, ORACLES[name])
