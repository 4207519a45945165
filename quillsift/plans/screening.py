"""A screening run as one plan: recall, judge, verify evidence, aggregate, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import verbatim
from quillsift.operators import agents, scoring


def screen(evidence: DataFrame, requirements: DataFrame, rubrics: DataFrame, provider: Callable[[str], str] = agents.stub_judge) -> DataFrame:
    """Ranked candidates of each rubric.

    ``evidence`` has rubric_id, candidate_id and an array ``chunks`` (chunk_id,
    section, page_from, page_to, content); ``requirements`` rubric_id,
    requirement_id, ordinal, text, category, is_must_have, weight, min_years,
    min_seniority; ``rubrics`` rubric_id, title, cap.  A candidate with a
    failed batch has no score.
    """
    batched = agents.judge_batches(requirements, "rubric_id")
    line = agents.requirement_line(*[F.col(c) for c in ("index", "category", "text", "is_must_have", "min_years", "min_seniority")])
    lines = batched.groupBy("rubric_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    asked = evidence.join(lines, "rubric_id").join(rubrics.select("rubric_id", "title"), "rubric_id")
    prompts = asked.select("rubric_id", "candidate_id", "batch", F.size("lines").alias("n"), agents.judge_prompt(F.col("title"), F.col("lines"), F.col("chunks")).alias("prompt"))
    answered = agents.call(prompts, provider, lambda a: agents.parse_judge(a, F.col("n"))["violation"])
    # One pass over the answers: a candidate's batches are few (a rubric has 200 requirements at most), and a provider is asked once.
    found = F.struct("batch", agents.parse_judge(F.col("answer"), F.col("n"))["verdicts"].alias("v"))
    whole = answered.groupBy("rubric_id", "candidate_id").agg(F.min((F.col("status") == "ok").cast("int")).alias("ok"), F.collect_list(found).alias("batches")).filter("ok = 1")
    verdicts = whole.select("rubric_id", "candidate_id", F.explode("batches").alias("b")).select("rubric_id", "candidate_id", "b.batch", F.inline("b.v"))
    judged = verdicts.withColumnRenamed("requirement_index", "index").join(batched, ["rubric_id", "batch", "index"]).join(rubrics.select("rubric_id", "cap"), "rubric_id")
    scores = scoring.aggregate(judged, ["rubric_id", "candidate_id"], F.col("cap"))
    return scoring.ranked(scores, ["rubric_id"], "candidate_id")


def verified(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``quotes`` (document_id, quote, start_char, end_char) with ``result``: whether each stands in the text where it says."""
    both = quotes.join(texts.select("document_id", F.col("text").alias("_text")), "document_id", "left")
    return both.withColumn("result", F.when(F.col("_text").isNull(), "no_document").otherwise(verbatim(F.col("_text"), F.col("quote"), F.col("start_char"), F.col("end_char")))).drop("_text")
