"""Hidden text, instruction-like phrases, and the risk they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.numbers import hidden_kind
from quillsift.functions.text import collapse_blank_lines, excerpt, instruction_matches, strip, without_all
from quillsift.schemas import FINDING

HIDDEN_WEIGHT = 0.35
METADATA_WEIGHT = 0.25
PATTERN_WEIGHT = 0.20
QUARANTINE = 0.5


def _finding(kind: Column, detail: Column, text: Column, page: Column, removed: bool) -> Column:
    return F.struct(kind.alias("kind"), detail.alias("detail"), excerpt(text).alias("excerpt"), page.cast("int").alias("page"), F.lit(removed).alias("removed"))


def sanitize(parsed: DataFrame, text: str = "text", spans: str = "spans", metadata: str = "metadata") -> DataFrame:
    """``parsed`` with ``clean_text, findings, injection_risk_score, quarantined``.

    Hidden spans are removed from the text wherever their words stand;
    instruction-like metadata and visible phrases are only reported.  Each
    kind of hidden text counts 0.35, metadata 0.25 once, each phrase pattern
    0.20; the risk is 1 at most, and 0.5 puts a document in quarantine.
    """
    none = F.lit(None).cast("int")
    hidden = F.filter(F.coalesce(F.col(spans), F.array()), lambda s: hidden_kind(s).isNotNull() & (strip(s["text"]) != ""))
    step = parsed.withColumn("_hidden", hidden)
    step = step.withColumn("_text", without_all(F.coalesce(F.col(text), F.lit("")), F.transform("_hidden", lambda s: strip(s["text"]))))
    step = step.withColumn("_fields", F.filter(F.map_entries(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))), lambda e: F.size(instruction_matches(e["value"])) > 0))
    step = step.withColumn("_phrases", instruction_matches(F.col("_text")))
    findings = F.concat(
        F.transform("_hidden", lambda s: _finding(hidden_kind(s), F.lit("hidden span"), s["text"], s["page"], True)),
        F.transform("_fields", lambda e: _finding(F.lit("metadata"), F.concat(F.lit("metadata field "), e["key"]), e["value"], none, False)),
        F.transform("_phrases", lambda m: _finding(F.lit("instruction_pattern"), F.concat(F.lit("pattern "), m["name"]), m["matched"], none, False)),
    ).cast(f"array<{FINDING}>")
    kinds = F.size(F.array_distinct(F.transform("_hidden", hidden_kind)))
    risk = F.least(F.lit(1.0), kinds * F.lit(HIDDEN_WEIGHT) + F.when(F.size("_fields") > 0, METADATA_WEIGHT).otherwise(0.0) + F.size("_phrases") * F.lit(PATTERN_WEIGHT))
    out = step.withColumn("clean_text", collapse_blank_lines(F.col("_text"))).withColumn("findings", findings).withColumn("injection_risk_score", risk)
    # A sum such as 0.35 + 0.15 may fall short of its decimal value by the last bit.
    return out.withColumn("quarantined", F.round("injection_risk_score", 9) >= QUARANTINE).drop("_hidden", "_text", "_fields", "_phrases")


def report_json(findings: Column, risk: Column) -> Column:
    return F.to_json(F.struct(F.round(risk, 4).alias("injection_risk_score"), findings.alias("findings")), {"ignoreNullFields": "false"})


def shown_text(text: Column, quarantined: Column) -> Column:
    """What readers see: nothing of a document in quarantine."""
    return F.when(quarantined, "").otherwise(text)
