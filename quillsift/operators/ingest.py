"""Content-addressed ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.numbers import bound
from quillsift.operators.skew import meet


def dedup(arrivals: DataFrame, stored: DataFrame | None = None, digest: str = "sha256", order: str = "arrival") -> DataFrame:
    """``arrivals`` with ``document_id, is_new``: the first arrival of a tenant's content is new, others get its id.

    Content that ``stored`` (tenant_id, sha256, id) has already keeps the
    stored id.  Groups are reduced before they meet the rows again, and a file
    that arrives very often is broadcast to its rows, so it costs no large
    group.  Arrivals are counted here.
    """
    first = arrivals.groupBy("tenant_id", digest).agg(F.min(F.struct(F.col(order).alias("o"), F.col("id").alias("id"))).alias("_first"), F.count("*").alias("_n"))
    if stored is not None:
        known = stored.groupBy("tenant_id", F.col("sha256").alias(digest)).agg(F.min("id").alias("_stored"))
        first = first.join(known, ["tenant_id", digest], "left")
    else:
        first = first.withColumn("_stored", F.lit(None).cast(arrivals.schema["id"].dataType))
    both = meet(arrivals, first, ["tenant_id", digest], "_n")
    new = F.col("_stored").isNull() & (F.col("id") == F.col("_first.id"))
    return both.withColumn("document_id", F.coalesce("_stored", "_first.id")).withColumn("is_new", new).drop("_first", "_stored", "_n")


def ats_report(text: Column, keywords: Column, tables: Column, columns: Column, headings: Column, contact: Column) -> Column:
    """Keyword coverage, format flags and compliance of a résumé's text."""
    # The text is lowered once, and each keyword looked for once.
    looked = bound(F.lower(text), lambda low: F.transform(keywords, lambda k: F.struct(k.alias("k"), F.contains(low, F.lower(k)).alias("hit"))))
    return bound(looked, lambda found: _report(found, tables, columns, headings, contact))


def _report(found: Column, tables: Column, columns: Column, headings: Column, contact: Column) -> Column:
    named = lambda hit: F.transform(F.filter(found, lambda x: x["hit"] == F.lit(hit)), lambda x: x["k"])
    matched, missing = named(True), named(False)
    coverage = F.when(F.size(found) > 0, F.size(matched) / F.size(found)).otherwise(0.0)
    error = ~headings | ~contact
    flags = F.array_compact(
        F.array(
            F.when(tables, F.struct(F.lit("tables_detected").alias("issue"), F.lit("warning").alias("severity"))),
            F.when(columns, F.struct(F.lit("multi_column_layout").alias("issue"), F.lit("warning").alias("severity"))),
            F.when(~headings, F.struct(F.lit("missing_standard_headings").alias("issue"), F.lit("error").alias("severity"))),
            F.when(~contact, F.struct(F.lit("missing_contact_block").alias("issue"), F.lit("error").alias("severity"))),
        )
    )
    return F.struct(
        coverage.alias("keyword_coverage"),
        matched.alias("matched_keywords"),
        missing.alias("missing_keywords"),
        flags.alias("format_flags"),
        F.bround(coverage * 0.6 + F.when(error, 0.0).otherwise(0.4), 2).alias("compliance_score"),
        ((coverage >= 0.70) & ~error).alias("is_ats_safe"),
    )
