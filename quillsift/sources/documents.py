"""Documents as bytes: what they are, whether they are taken, and their text.

A DOCX is read with the standard library; PDF pages need a reader function,
as none is bundled.  Reading is the one step in Python; everything else is
column expressions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from quillsift.schemas import CHARS_PER_PAGE, MAX_CHARS, MAX_PAGES, MAX_UPLOAD_BYTES, SPAN

PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT = "text/plain"
SEPARATOR = "\n\n"
_MAIN = "word/document.xml"
#: What reading a damaged file raises; other errors are bugs and fail the job.
UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, UnicodeDecodeError, KeyError, ValueError, EOFError, OSError)
#: Files whose texts a task holds at once beside their contents.
HELD = 128
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content, length`` of files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


@F.pandas_udf(T.BooleanType())
def _holds_word_document(content: pd.Series) -> pd.Series:
    def holds(data: bytes | None) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return _MAIN in archive.namelist()
        except (zipfile.BadZipFile, OSError, TypeError):
            return False

    return content.map(holds).astype(bool)


def media_type(content: Column) -> Column:
    """The type that the bytes show; null if it is none that is known.  Only ZIP containers are opened."""
    zipped = F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04"))
    return F.when(F.substring(content, 1, 5) == F.lit(bytearray(b"%PDF-")), PDF).when(_holds_word_document(F.when(zipped, content)), DOCX)


def upload_violation(content: Column, kind: Column, allowed: tuple[str, ...] = (PDF, DOCX), limit: int = MAX_UPLOAD_BYTES) -> Column:
    """Why an upload is refused, null if it isn't; size counts before type."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "empty_document")
        .when(size > limit, "payload_too_large")
        .when(kind.isNull() | ~kind.isin(*allowed), "unsupported_media_type")
    )


def docx_paragraphs(data: bytes) -> str:
    """Paragraphs of a DOCX's body, one per line."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read(_MAIN)).find(f"{_WORD}body")
    lines = []
    for paragraph in body.findall(f"{_WORD}p") if body is not None else []:
        parts = {f"{_WORD}t": lambda x: x.text or "", f"{_WORD}tab": lambda x: "\t", f"{_WORD}br": lambda x: "\n", f"{_WORD}cr": lambda x: "\n"}
        lines.append("".join(parts[x.tag](x) for x in paragraph.iter() if x.tag in parts))
    return "\n".join(lines)


def assemble(pages: Column) -> Column:
    """``text, pages (page, text, start_char, end_char), page_count, needs_ocr, parse_status`` of an array of page texts."""
    pages = F.coalesce(pages, F.array().cast("array<string>"))
    before = F.transform(
        pages,
        lambda p, i: F.aggregate(F.slice(pages, 1, i), F.lit(0), lambda total, q: total + F.length(q) + len(SEPARATOR)),
    )
    placed = F.transform(
        F.arrays_zip(pages.alias("p"), before.alias("b")),
        lambda x, i: F.struct((i + 1).alias("page"), x["p"].alias("text"), x["b"].alias("start_char"), (x["b"] + F.length(x["p"])).alias("end_char")),
    )
    chars = F.aggregate(pages, F.lit(0), lambda total, p: total + F.length(p))
    thin = chars < CHARS_PER_PAGE * F.greatest(F.size(pages), F.lit(1))
    return F.struct(
        F.array_join(pages, SEPARATOR).alias("text"),
        placed.alias("pages"),
        F.size(pages).alias("page_count"),
        thin.alias("needs_ocr"),
        F.when(thin, "low_yield").otherwise("ok").alias("parse_status"),
    )


def read_pages(kind: str | None, data: bytes, read_pdf: Callable[[bytes], list[str]] | None) -> tuple[list[str] | None, str | None]:
    """The texts of a file's pages, or an error."""
    try:
        if kind == DOCX:
            pages = [docx_paragraphs(data)]
        elif kind == PDF and read_pdf is not None:
            pages = list(read_pdf(data))
        elif kind == TEXT:
            pages = [data.decode("utf-8")]
        else:
            return None, "unsupported_media_type"
    except UNREADABLE:
        return None, "document_parse_error"
    if len(pages) > MAX_PAGES:
        return None, "too_many_pages"
    return (None, "too_many_characters") if sum(map(len, pages)) > MAX_CHARS else (pages, None)


def read_batches(batches: Iterable[tuple[pd.Series, pd.Series]], read_pdf: Callable[[bytes], list[str]] | None) -> Iterator[pd.DataFrame]:
    """``texts, error`` of the files of each batch (media types, contents), HELD files at a time."""
    for kinds, contents in batches:
        for at in range(0, len(kinds), HELD):
            rows = [read_pages(kind, data, read_pdf) for kind, data in zip(kinds[at : at + HELD], contents[at : at + HELD], strict=True)]
            yield pd.DataFrame(rows, columns=["texts", "error"])


def parse(files: DataFrame, read_pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``files`` (with ``content``) and ``media_type``, and ``parsed``: text, pages and offsets, or an ``error``.

    Documents of over MAX_PAGES pages or MAX_CHARS characters, ones that can't
    be opened (a reader raises one of UNREADABLE), and types without a reader
    have an error and no text.
    """

    @F.pandas_udf("struct<texts:array<string>,error:string>")
    def pages_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from read_batches(batches, read_pdf)

    typed = files if "media_type" in files.columns else files.withColumn("media_type", media_type(F.col("content")))
    read = typed.withColumn("_read", pages_of("media_type", "content"))
    made = assemble(F.col("_read.texts"))
    failed = F.col("_read.error").isNotNull()
    return read.withColumn("parsed", F.when(~failed, made)).withColumn("error", F.col("_read.error")).drop("_read")


def styled_spans(files: DataFrame, read_spans: Callable[[bytes], list[dict]]) -> DataFrame:
    """``files`` with ``spans`` (schemas.SPAN): what a given reader finds, without the blank ones; null where a file can't be read."""

    @F.pandas_udf(f"array<{SPAN}>")
    def found(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def of(data: bytes | None) -> list[dict] | None:
            try:
                return None if data is None else [s for s in read_spans(data) if s["text"].strip()]
            except UNREADABLE:
                return None

        for batch in contents:
            yield pd.Series([of(x) for x in batch], dtype=object)

    return files.withColumn("spans", found("content"))


def cv_parse(parsed: DataFrame) -> DataFrame:
    """The CV parser's result of parsed files: ``cv`` with text, page_count, status and warning; a thin text asks for OCR, an error fails."""
    text, pages = F.col("parsed.text"), F.col("parsed.page_count")
    thin = needs_ocr(text, pages)
    status = F.when(F.col("error").isNotNull(), "failed").when(thin, "degraded").otherwise("ok")
    warning = F.when(F.col("error").isNotNull(), F.col("error")).when(thin, "needs_ocr")
    return parsed.withColumn("cv", F.struct(text.alias("text"), pages.alias("page_count"), F.coalesce(thin, F.lit(False)).alias("needs_ocr"), status.alias("status"), warning.alias("warning")))


def needs_ocr(text: Column, page_count: Column) -> Column:
    """The other parser's rule: pages, but under 100 characters of text."""
    return (page_count > 0) & (F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < 100)


def ocr(files: DataFrame, recognise: Callable[[bytes], tuple[str, list[float]]]) -> DataFrame:
    """``files`` with ``ocr``: text, mean of the positive word confidences (2 digits) and status, by a given recogniser."""

    @F.pandas_udf("struct<text:string,confidences:array<double>>")
    def words(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            yield pd.DataFrame([recognise(x) for x in batch], columns=["text", "confidences"])

    mean = mean_confidence(F.col("_ocr.confidences"))
    done = files.withColumn("_ocr", words("content"))
    return done.withColumn("ocr", F.struct(F.trim("_ocr.text").alias("text"), F.round(mean, 2).alias("confidence"), ocr_status(mean).alias("status"))).drop("_ocr")


def mean_confidence(confidences: Column) -> Column:
    positive = F.filter(confidences, lambda c: c > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(positive) > 0, total / F.size(positive)).otherwise(0.0)


def ocr_status(mean: Column) -> Column:
    return F.when(mean >= 0.6, "ok").otherwise("low_confidence")
