"""Removal of repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import fresh, frozen, meet, word_count

SPAN = 3
SPACES = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _key(id_col: str, text_col: str) -> Column:
    """What tells documents apart: the id, and the text where ids repeat."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))


def windows(docs: DataFrame, id_col: str, text_col: str, passage: int | None = None) -> DataFrame:
    """``key, at, h1, h2, span`` for each window of three consecutive lines that has a word (128 hash bits of the lines, trimmed).

    With ``passage``, windows of one and two lines with more words than that
    besides; ``span`` is the number of a window's lines.
    """
    bare = F.transform(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(SPACES)))
    named = docs.select(_key(id_col, text_col).alias("key"), bare.alias("bare"))

    def hashed(at: Column, span: int) -> Column:
        lines = [F.get("bare", at + k) for k in range(span)]
        if span == SPAN:
            wanted = F.length(F.concat(*lines)) > 0
        else:
            wanted = reduce(add, [F.get("counts", at + k) for k in range(span)]) > passage
        parts = [at.alias("at"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1 + SPAN - span), *reversed(lines)).alias("h2"), F.lit(span).alias("span")]
        return F.when(wanted, F.struct(*parts))

    def found(span: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size("bare") - span), lambda at: hashed(at, span))
        return F.when(F.size("bare") >= span, some).otherwise(F.array())

    if passage is None:
        every = found(SPAN)
    else:
        named = named.withColumn("counts", F.transform("bare", word_count))
        every = F.concat(*map(found, range(1, SPAN + 1)))
    return named.select("key", F.explode(every).alias("w")).filter("w is not null").select("key", "w.*")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """``key, removed``: for each document with later occurrences of windows, the sorted positions of the lines that these cover.

    Jobs run here: windows are hashed once and kept.  A window that very many
    documents share is reduced to its first occurrence by every task before
    the shuffle, and its occurrences meet that by a broadcast.
    """
    seen = frozen(windows(docs, id_col, text_col, passage))
    counted = seen.groupBy("h1", "h2").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n"))
    firsts = frozen(counted.filter("n > 1"))
    later = meet(seen, firsts, ["h1", "h2"], "n", seen.count(), 0).filter(F.struct("key", "at") > F.col("first"))
    covered = later.select("key", F.explode(F.sequence("at", F.col("at") + F.col("span") - 1)).alias("line"))
    return covered.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def without(lines: Column, removed: Column) -> Column:
    """The lines but those at the (sorted, distinct) positions, in one pass over both.

    The positions become a string of marks, a character for each line.
    """
    before = F.concat(F.array(F.lit(-1)), F.slice(removed, 1, F.size(removed) - 1))
    upto = F.array_join(F.zip_with(removed, before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1"))), "")
    marks = F.split(F.concat(upto, F.repeat(F.lit("0"), F.size(lines) - F.get(removed, F.size(removed) - 1) - 1)), "")
    return F.filter(F.zip_with(lines, marks, lambda line, mark: F.when(mark == "0", line)), lambda line: line.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """``docs`` without the lines of repeated three-line windows, and ``removed_lines``, their positions (from 0).

    The first occurrence of a window, by id and position in the text, stays;
    the lines that later ones cover are removed, overlapping windows together.
    Lines are what newlines separate, compared without the white space around
    them, by 128 hash bits (two different windows of a corpus of 10**12 are
    taken for one with a probability under 10**-14); windows of blank lines
    only are never repeats.
    With ``passage``, one or two lines of more words than that together are
    windows too; without it, such repeats stay where no window of three lines
    around them is repeated, and in texts of under three lines.  Texts without
    removed lines are unchanged (null stays null); one that loses all lines is
    empty.  Rows that repeat id and text count as one document and lose the
    same lines; null ids come first.  Other columns pass through, whatever
    their names; one called ``removed_lines`` is replaced.  Time grows with
    the length of a text in proportion.
    """
    key, removed = fresh(docs, "key", "removed")
    gone = repeated(docs, id_col, text_col, passage).select(F.col("key").alias(key), F.col("removed").alias(removed))
    marked = docs.join(gone, _key(id_col, text_col).eqNullSafe(F.col(key)), "left")
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(without(_lines(F.col(text_col)), F.col(removed)), "\n"))
    positions = F.coalesce(F.col(removed), F.array().cast("array<int>"))
    return marked.withColumn(text_col, text).withColumn("removed_lines", positions).drop(key, removed)


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, text, string_split(COALESCE(text, ''), chr(10)) AS l FROM documents
), bare AS (
    SELECT doc_id, text, l, list_transform(l, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS b FROM lines
), places AS (
    SELECT doc_id, b, unnest(range(0, len(b) - 2)) AS pos FROM bare WHERE len(b) >= 3
), windows AS (
    SELECT doc_id, pos, b[pos + 1] || chr(10) || b[pos + 2] || chr(10) || b[pos + 3] AS w FROM places
    WHERE length(b[pos + 1] || b[pos + 2] || b[pos + 3]) > 0
), ranked AS (
    SELECT doc_id, pos, ROW_NUMBER() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows
), gone AS (
    SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM ranked WHERE n > 1 GROUP BY doc_id
)
SELECT lines.doc_id,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text,
       CAST(COALESCE(len(gone), 0) AS BIGINT) AS n_removed
FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id
"""
