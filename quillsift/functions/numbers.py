"""Numeric and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGIBLE_POINTS = 4.0
VISIBLE_LUMINANCE = 0.92
CANVAS_TOLERANCE = 2.0


def luminance(color: Column) -> Column:
    """Relative luminance of a packed 0xRRGGBB colour."""
    channel = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(0xFF)) / F.lit(255.0)
    return channel(16) * 0.2126 + channel(8) * 0.7152 + channel(0) * 0.0722


def off_canvas(bbox: Column, page: Column, tolerance: float = CANVAS_TOLERANCE) -> Column:
    """Whether a box (x0, y0, x1, y1) lies outside the page; false if either is unknown."""
    outside = (bbox[2] < page[0] - tolerance) | (bbox[3] < page[1] - tolerance) | (bbox[0] > page[2] + tolerance) | (bbox[1] > page[3] + tolerance)
    return F.coalesce(outside, F.lit(False))


def hidden_kind(span: Column) -> Column:
    """Why a styled span can't be seen; null if it can."""
    return (
        F.when((span["size"] > 0) & (span["size"] <= LEGIBLE_POINTS), "tiny_font")
        .when(off_canvas(span["bbox"], span["page_rect"]), "off_canvas")
        .when(luminance(span["color"]) >= VISIBLE_LUMINANCE, "invisible_text")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    return bound(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero or the widths differ."""
    same = F.size(a) == F.size(b)
    return bound(norm(a) * norm(b), lambda n: F.when(same & (n > 0), dot(a, b) / n).otherwise(0.0))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set; zeros if none is."""
    width = F.size(tokens[0])
    count = F.aggregate(mask, F.lit(0.0), lambda total, m: total + m)
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["t"], lambda x, y: x + y.cast("double") * p["m"]))
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(1e-9)))


def mock_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic unit vector from the text's SHA-256: bytes repeated to the width, (b - 128) / 128."""
    byte = lambda digest, k: F.conv(F.substring(digest, (k % 32) * 2 + 1, 2), 16, 10).cast("int")
    raw = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (byte(digest, k) - 128) / F.lit(128.0))
    return bound(bound(F.sha2(text.cast("binary"), 256), raw), unit)
