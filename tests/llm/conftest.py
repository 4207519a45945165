from __future__ import annotations

import pytest

#: Rows for every operator: nulls, empty and long texts, ties, repeated rows.
LONG = "\n".join(f"line {k} of a long text, number {k % 7}." for k in range(4000))
HARD = [
    (1, "Some plain text.\nWith two lines.\nAnd a third one.", "en", "a"),
    (1, "Some plain text.\nWith two lines.\nAnd a third one.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "Some plain text.\nWith two lines.\nAnd a third one.", "fr", "b"),
    (None, None, None, None),
    (4, LONG, "en", "b"),
    (5, LONG, "de", "b"),
    (6, " \t\n\x0b\x0c\r ", "en", "c"),
    (7, "ünï çødé 日本語 🙂 <|endoftext|>  a\x00b", "x", "🙂"),
    (8, "Some plain text.\nWith two lines.\nAnd a third one.", "en", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with more columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("size", "print", "key", "bits", "rows", "score", "rank", "node", "copies", "kept", "stratum", "shard", "bare", "m", "norm")}
    return spark.createDataFrame(HARD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
