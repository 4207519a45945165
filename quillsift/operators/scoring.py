"""Scores from verdicts: weighted decimal points, must-have caps, ranks.

All rubrics or candidates are scored at once: ``unit`` columns name what one
score is for (a candidate under a rubric, say).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.schemas import FORMULA_VERSIONS, POINTS, VERDICTS

TOLERANCE = "0.0001"


def credit(verdict: Column) -> Column:
    """The share of a requirement's weight that a verdict earns."""
    return F.when(verdict == "met", F.lit("1.0")).when(verdict == "partial", F.lit("0.5")).when(verdict.isin("missing", "unclear"), F.lit("0.0")).cast("decimal(2,1)")


def points(weight: Column, verdict: Column) -> Column:
    """Points on a scale of 100, rounded half up to 0.01 for each requirement."""
    return F.round(weight.cast("decimal(5,4)") * credit(verdict) * F.lit(100).cast("decimal(3,0)"), 2).cast(POINTS)


def verdict_violations(requirements: DataFrame, verdicts: DataFrame, unit: Sequence[str]) -> DataFrame:
    """What keeps verdicts and requirements (``unit``, ``requirement_id``) from matching one to one: ``unit, requirement_id, violation``."""
    key = [*unit, "requirement_id"]
    counted = verdicts.groupBy(*key).agg(F.count("*").alias("_n"), F.max((~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).cast("int")).alias("_odd"))
    known = requirements.select(*key).distinct().withColumn("_known", F.lit(True))
    both = counted.join(known, key, "full_outer")
    found = F.array_compact(
        F.array(
            F.when(F.col("_odd") == 1, "unknown_label"),
            F.when(F.col("_known").isNull(), "unknown_requirement"),
            F.when(F.col("_n") > 1, "duplicate_verdict"),
            F.when(F.col("_n").isNull(), "unjudged_requirement"),
        )
    )
    return both.select(*key, F.explode(found).alias("violation"))


def rubric_violations(rubrics: DataFrame, requirements: DataFrame) -> DataFrame:
    """``id, violation`` of rubric versions that can't be scored."""
    sums = requirements.groupBy(F.col("rubric_version_id").alias("id")).agg(F.sum("weight").alias("_sum"), F.count("*").alias("_n"))
    both = rubrics.join(sums, "id", "left")
    rule = (
        F.when(F.col("status") != "approved", "not_approved")
        .when(~F.col("aggregation_formula_version").isin(*FORMULA_VERSIONS), "unknown_formula")
        .when(F.coalesce("_n", F.lit(0)) == 0, "no_requirements")
        .when(F.abs(F.col("_sum") - 1) > F.lit(TOLERANCE).cast("decimal(5,4)"), "weights_do_not_sum_to_one")
    )
    return both.select("id", rule.alias("violation")).filter("violation is not null")


def aggregate(judged: DataFrame, unit: Sequence[str], cap: Column, contributions: bool = False) -> DataFrame:
    """Scores of ``judged`` rows (unit, requirement_id, ordinal, weight, is_must_have, verdict).

    Returns per unit: ``raw_score, must_have_failed, cap_applied, score,
    failed_must_have_ids`` (in order of ordinal and id) and, if wanted,
    ``contributions``.  Only a verdict of met satisfies a must-have; the cap
    never lifts a score.  Weights are decimals that add up to 1.
    """
    scored = judged.withColumn("points", points(F.col("weight"), F.col("verdict")))
    failed = F.col("is_must_have") & (F.col("verdict") != "met")
    aggregates = [
        F.sum("points").cast(POINTS).alias("raw_score"),
        F.max(failed).alias("must_have_failed"),
        F.max(cap).cast(POINTS).alias("_cap"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("ordinal", F.col("requirement_id").cast("string").alias("id"))))).alias("_failed"),
    ]
    if contributions:
        aggregates.append(F.array_sort(F.collect_list(F.struct("ordinal", F.col("requirement_id").cast("string").alias("requirement_id"), "weight", "is_must_have", "verdict", "points"))).alias("contributions"))
    out = scored.groupBy(*unit).agg(*aggregates)
    out = out.withColumn("cap_applied", F.col("must_have_failed") & (F.col("raw_score") > F.col("_cap")))
    out = out.withColumn("score", F.when(F.col("cap_applied"), F.col("_cap")).otherwise(F.col("raw_score")).cast(POINTS))
    out = out.withColumn("failed_must_have_ids", F.transform("_failed", lambda x: x["id"]))
    columns = [*unit, "score", "raw_score", "must_have_failed", "cap_applied", "failed_must_have_ids"]
    return out.select(*columns, *["contributions"] * contributions)


def ranked(scores: DataFrame, within: Sequence[str], unit: str) -> DataFrame:
    """``scores`` with ``rank`` from 1, the highest score first, ties by id."""
    order = Window.partitionBy(*within).orderBy(F.col("score").desc(), F.col(unit))
    return scores.withColumn("rank", F.row_number().over(order))


def top_ranked(scores: DataFrame, unit: str, most: int) -> DataFrame:
    """The ``most`` highest scores over all rows with their ``rank``: only the top rows of each partition are compared."""
    best = scores.orderBy(F.col("score").desc(), F.col(unit)).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(unit))).cast("int"))


def gap_severity(must_have: Column, verdict: Column) -> Column:
    return F.when(verdict == "missing", F.when(must_have, "critical").otherwise("medium")).when(verdict == "partial", F.when(must_have, "high").otherwise("low"))
