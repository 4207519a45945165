"""Text functions as column expressions.

White space is Unicode's, as ``(?U)\\s``; positions count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"

#: Section headings: label and pattern (fixed values); all alternatives are matched at the start of a line.
HEADINGS = (
    ("experience", r"(?i)^\s*(work\s+)?experience|employment|career|professional\s+history"),
    ("education", r"(?i)^\s*education|academic|qualifications|degrees?"),
    ("skills", r"(?i)^\s*(technical\s+)?skills|competenc|technologies|proficienc"),
    ("summary", r"(?i)^\s*(professional\s+)?(summary|profile|objective|about\s+me|overview)"),
    ("certifications", r"(?i)^\s*certifications?|licens|credentials?"),
    ("projects", r"(?i)^\s*projects?|portfolio"),
    ("languages", r"(?i)^\s*languages?"),
    ("awards", r"(?i)^\s*awards?|honors?|achievements?"),
    ("publications", r"(?i)^\s*publications?|papers?|research"),
    ("references", r"(?i)^\s*references?"),
)
HEADING_CHARS = 80

#: Phrases that only make sense as instructions to a language model (fixed values).
INSTRUCTIONS = (
    ("override-previous-instructions", r"\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}?\b(?:previous|prior|above|earlier|all)\b[^.\n]{0,20}?\b(?:instruction|prompt|direction|rule|context)s?\b"),
    ("disregard-and-emit", r"\b(?:disregard|ignore)\b[^.\n]{0,40}?\b(?:and|then)\b[^.\n]{0,20}?\b(?:output|print|say|respond|reply|return)\b"),
    ("role-reassignment", r"\byou\s+are\s+(?:now\s+)?(?:a|an|the)\b[^.\n]{0,60}?\b(?:assistant|model|ai|bot|system)\b"),
    ("impersonated-system-turn", r"(?:^|\n)\s*(?:system|assistant|user)\s*:\s*\S"),
    ("chat-template-delimiter", r"<\|(?:im_start|im_end|system|endoftext|eot_id|start_header_id)\|>|\[/?INST\]|<<SYS>>"),
    ("scoring-directive", r"\b(?:rate|score|rank|grade)\b[^.\n]{0,40}?\b(?:100|10/10|maximum|highest|perfect|exceptional\s+fit|top\s+candidate)\b"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def words(text: Column) -> Column:
    """The words between white space; none for a blank text."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def section_heading(line: Column) -> Column:
    """The section that a line is a heading of; null for any other line, blank and long ones among them."""
    bare = strip(line)
    found = F.lit(None).cast("string")
    for label, pattern in reversed(HEADINGS):
        found = F.when(bare.rlike(f"(?iU)^(?:{pattern})"), label).otherwise(found)
    return F.when((bare != "") & (F.length(bare) <= HEADING_CHARS), found)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def token_estimate(text: Column) -> Column:
    """1.33 tokens a word, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.size(words(text)) * F.lit(1.33)).cast("int"))


def excerpt(text: Column, most: int = 120) -> Column:
    """On one line; of over ``most`` characters, all but the last and three dots."""
    flat = F.array_join(words(text), " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("..."))).otherwise(flat)


def collapse_blank_lines(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def without_all(text: Column, parts: Column) -> Column:
    """The text without every occurrence of each of the parts, one after the other."""
    return F.aggregate(parts, text, lambda t, part: F.replace(t, part, F.lit("")))


def instruction_matches(text: Column) -> Column:
    """``name, matched`` for each instruction pattern that the text has."""
    found = [F.struct(F.lit(name).alias("name"), F.regexp_extract(text, f"(?i){pattern}", 0).alias("matched")) for name, pattern in INSTRUCTIONS]
    hits = [F.when(text.rlike(f"(?i){pattern}"), s) for (_, pattern), s in zip(INSTRUCTIONS, found, strict=True)]
    return F.array_compact(F.array(*hits))


def instruction_risk(text: Column) -> Column:
    """A fifth for each distinct pattern, 1 at most."""
    n = sum(F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)).cast("int") for _, pattern in INSTRUCTIONS)
    return F.least(F.lit(1.0), n * F.lit(0.20))


@F.pandas_udf(T.StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def safe_filename(name: Column, most: int = 120) -> Column:
    """The last path part in ASCII, from an allow-list of characters; ``unnamed`` if nothing is left.

    Only names that aren't ASCII already are decomposed in Python.
    """
    tail = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"[^/]*$", 0)
    plain = F.when(tail.rlike(r"^\p{ASCII}*$"), tail).otherwise(_ascii(F.when(~tail.rlike(r"^\p{ASCII}*$"), tail)))
    clean = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._-]", "_"), r"\.{2,}", ".")
    clean = F.regexp_replace(clean, r"^[. _]+|[. _]+$", "")
    return F.when(clean == "", "unnamed").otherwise(F.substring(clean, 1, most))


def neutral(text: Column, tag: str) -> Column:
    """The text with the closing tag written as an entity, so that it can't end its block."""
    return F.replace(text, F.lit(f"</{tag}>"), F.lit(f"&lt;/{tag}&gt;"))


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def joined_key(separator: str, *parts: Column) -> Column:
    """SHA-256 of the parts joined; a null or blank part fails the query."""
    checked = [F.when(F.coalesce(p, F.lit("")) != "", p).otherwise(F.raise_error(F.lit("cache key component missing"))) for p in parts]
    return sha256(F.concat_ws(separator, *checked))


def verdict_key(resume_version: Column, requirement: Column, content_hash: Column, prompt_version: Column, model: Column, effort: Column, retrieval_hash: Column) -> Column:
    """Identity of one judged requirement; parts are set apart by a record separator, so none can run into the next."""
    return joined_key("\u001e", resume_version, requirement, content_hash, prompt_version, model, effort, retrieval_hash)


def batch_key(resume_version: Column, requirement_ids: Column, content_hash: Column, prompt_version: Column, model: Column, retrieval_hash: Column) -> Column:
    """Identity of a judged batch, whatever the order of its requirements."""
    ids = F.array_join(F.array_sort(requirement_ids), ",")
    return sha256(F.concat_ws("|", resume_version, ids, content_hash, prompt_version, model, retrieval_hash))


def extraction_key(text_hash: Column, prompt_version: Column, model: Column) -> Column:
    return sha256(F.concat_ws("|", text_hash, prompt_version, model))


def config_hash(settings: Column) -> Column:
    """SHA-256 of a map's JSON with sorted keys; a null value is written, an absent one isn't."""
    entries = F.array_sort(F.map_entries(settings))
    json = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))
    return sha256(json)


def verbatim(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """``ok`` if the quote stands at exactly these positions, else why not; the text isn't echoed."""
    return (
        F.when(quote.isNull() | (quote == ""), "empty_quote")
        .when(start < 0, "negative_offset")
        .when(end <= start, "inverted_range")
        .when(end > F.length(text), "out_of_range")
        .when(F.substring(text, start + 1, end - start) == quote, "ok")
        .otherwise("mismatch")
    )
