"""Sections, and parent and child chunks of documents.

Packing sentences into chunks carries state from one to the next, so it is a
fold over a document's words: one pandas UDF per document, rows to rows, no
shuffle.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import HEADING_CHARS, HEADINGS
from quillsift.schemas import MAX_CHILDREN

CHILD_WORDS = 180
PARENT_WORDS = 700
TOKENS_PER_WORD = 1.33
#: Documents whose chunks a task holds at once.
HELD = 128
CHUNK = "struct<chunk_index:int,parent_index:int,section:string,content:string,page_from:int,page_to:int,start_char:int,end_char:int,token_count:int,is_parent:boolean>"

_PATTERNS = [(label, re.compile(pattern, re.IGNORECASE)) for label, pattern in HEADINGS]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def heading(line: str) -> str | None:
    bare = line.strip()
    if 0 < len(bare) <= HEADING_CHARS:
        return next((label for label, pattern in _PATTERNS if pattern.match(bare)), None)
    return None


def sections(text: str) -> list[tuple[str, str, int]]:
    """(label, text, start) of a document's sections.

    A heading only ends a section that has lines already (after a heading, the
    next line belongs to the body whatever it says).  Starts point at the
    heading, texts don't hold it; blank sections are left out.
    """
    lines = text.split("\n")
    starts = [0, *itertools.accumulate(len(line) + 1 for line in lines)]
    cuts: list[tuple[int, str]] = []
    for k, line in enumerate(lines[1:], 1):
        if (not cuts or cuts[-1][0] < k - 1) and (label := heading(line)):
            cuts.append((k, label))
    names, ends = ["summary", *(label for _, label in cuts)], [*(starts[k] - 1 for k, _ in cuts), len(text)]
    bodies, begins = [0, *(starts[k + 1] for k, _ in cuts)], [0, *(starts[k] for k, _ in cuts)]
    found = [(name, text[body:end].strip(), begin) for name, body, end, begin in zip(names, bodies, ends, begins, strict=True)]
    return [x for x in found if x[1]] or [("other", text.strip(), 0)]


def section_documents(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``key, label, body, start`` for each section of each document; blank and null texts have one without a body, which is left out."""

    @F.pandas_udf("array<struct<label:string,body:string,start:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("label", "body", "start"), s, strict=True)) for s in sections(t or "") if s[1]] for t in batch], dtype=object)

    return docs.select(key, F.inline(found(F.col(text))))


def pack_words(text: str, most: int, start: int) -> list[tuple[str, int, int]]:
    """(content, start, end): whole sentences packed to ``most`` words; a longer sentence stays whole.

    Words are joined by single spaces and a chunk starts one character after
    the end of the last, so positions are those of the joined text.
    """
    bare = text.strip()
    if not bare:
        return []
    if len(bare.split()) <= most:
        return [(bare, start, start + len(bare))]
    groups: list[list[str]] = [[]]
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        if groups[-1] and len(groups[-1]) + len(words) > most:
            groups.append(words)
        else:
            groups[-1].extend(words)
    out = []
    for words in filter(None, groups):
        content = " ".join(words)
        out.append((content, start, start + len(content)))
        start += len(content) + 1
    return out


def chunk_text(text: str | None, pages: list | None, child_words: int = CHILD_WORDS, parent_words: int = PARENT_WORDS) -> list[dict]:
    """Parents and, after each, its children; a small parent is its own child."""
    if not text or not text.strip():
        return []
    starts = [(int(p["start_char"]), int(p["page"])) for p in (pages if pages is not None else [])]
    ordered = all(a[0] <= b[0] for a, b in zip(starts, starts[1:], strict=False))

    def page(offset: int) -> int:
        if ordered:
            k = bisect_right(starts, (offset, 1 << 62))
            return starts[k - 1][1] if k else 0
        return next((p for s, p in reversed(starts) if s <= offset), 0)

    out: list[dict] = []

    def add(section: str, content: str, start: int, end: int, parent: int | None) -> None:
        tokens = max(1, round(len(content.split()) * TOKENS_PER_WORD))
        out.append({"chunk_index": len(out), "parent_index": parent, "section": section, "content": content, "page_from": page(start), "page_to": page(end), "start_char": start, "end_char": end, "token_count": tokens, "is_parent": parent is None})

    for section, body, at in sections(text):
        for content, start, end in pack_words(body, parent_words, at):
            parent = len(out)
            add(section, content, start, end, None)
            children = pack_words(content, child_words, start)
            for child in children if len(children) > 1 else [(content, start, end)]:
                add(section, *child, parent)
    return out


def chunk_batches(batches: Iterable[tuple[pd.Series, pd.Series]], child_words: int = CHILD_WORDS, parent_words: int = PARENT_WORDS) -> Iterator[pd.Series]:
    """Chunks of the texts of each batch (texts, pages), HELD documents at a time."""
    for texts, pages in batches:
        for at in range(0, len(texts), HELD):
            yield pd.Series([chunk_text(t, p, child_words, parent_words) for t, p in zip(texts[at : at + HELD], pages[at : at + HELD], strict=True)], dtype=object)


def chunk_documents(versions: DataFrame, child_words: int = CHILD_WORDS, parent_words: int = PARENT_WORDS) -> DataFrame:
    """Chunks of ``versions`` (id, tenant_id, document_id, extracted_text, page_offsets), a row each.

    Ids are derived from the version and the position, so a rerun gives the
    same ones.  Blank and null texts have no chunks.
    """

    @F.pandas_udf(f"array<{CHUNK}>")
    def chunked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from chunk_batches(batches, child_words, parent_words)

    offsets = F.col("page_offsets") if "page_offsets" in versions.columns else F.lit(None).cast("array<struct<page:int,start_char:int,end_char:int>>")
    rows = versions.select(F.col("id").alias("resume_version_id"), "tenant_id", "document_id", F.explode(chunked("extracted_text", offsets)).alias("c"))
    of = lambda index: F.sha2(F.concat_ws(":", F.col("resume_version_id").cast("string"), index.cast("string")), 256)
    fields = ["chunk_index", "section", "content", "page_from", "page_to", "start_char", "end_char", "token_count", "is_parent"]
    return rows.select(
        of(F.col("c.chunk_index")).alias("chunk_id"),
        F.when(F.col("c.parent_index").isNotNull(), of(F.col("c.parent_index"))).alias("parent_chunk_id"),
        "resume_version_id",
        "tenant_id",
        "document_id",
        *[F.col(f"c.{f}").alias(f) for f in fields],
    )


def cap_children(chunks: DataFrame, most: int = MAX_CHILDREN) -> DataFrame:
    """All parents and the first ``most`` children of each document."""
    order = Window.partitionBy("resume_version_id", "is_parent").orderBy("chunk_index")
    return chunks.withColumn("_n", F.row_number().over(order)).filter(F.col("is_parent") | (F.col("_n") <= most)).drop("_n")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``resume_version_id, parents, children, sections``."""
    return chunks.groupBy("resume_version_id").agg(
        F.count_if("is_parent").alias("parents"), F.count_if(~F.col("is_parent")).alias("children"), F.count_distinct("section").alias("sections")
    )


def clean_offsets(raw: Column) -> Column:
    """Page offsets as integers from an array of maps of text; malformed entries are dropped."""
    number = lambda e, k: F.coalesce(e[k], F.lit("0")).try_cast("int")
    parts = F.transform(raw, lambda e: F.struct(number(e, "page").alias("page"), number(e, "start_char").alias("start_char"), number(e, "end_char").alias("end_char")))
    return F.filter(parts, lambda p: p["page"].isNotNull() & p["start_char"].isNotNull() & p["end_char"].isNotNull())
