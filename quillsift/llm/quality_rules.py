"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a measure of its text is at or over a cutoff.
On one part of the labelled documents, each stratum (language) tunes a cutoff
per rule.  From these, a path of LEVELS cutoff sets leads from rejecting
nothing to the tuned ones.  On the other part, an exact binomial test per
level, from the mildest on, asks whether the set rejects more than a fixed
share of the stratum's good documents that pass the base rules; the last level
that holds before the first that fails is used.  A fixed order needs no
correction over levels; strata are corrected for by Bonferroni's method.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import ASCII_SPACE, as_bytes, frozen

#: Fixed values of the base rules.
MIN_WORDS = 20
REPEAT_PERCENT = 30
SPAN = 8
SYMBOLS = b"#*$%&|<>"
#: Share of good documents passing the base rules that a stratum's cutoffs may reject together, and the probability of being wrong about any stratum.
RISK = 0.05
ERROR = 0.05
#: Of so many labelled documents, one tunes and the others certify: certifying needs the more.
PARTS = 3
#: Steps of a measure, and levels of the path to the tuned cutoffs.
STEPS = 64
LEVELS = 8
#: Strata whose cutoffs are broadcast; more of them meet the documents by a shuffle.
FEW = 10_000
#: A cutoff is only used if it rejects so many bad documents for each good one, on the tuning half.
GAIN = 4.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures of the rules, each from 0 to 1, the higher the worse.
RULES = ("symbol_share", "capital_share", "repeat_share", "dup_line_share", "sameness", "mark_runs", "bare_share", "redundancy", "evenness")
MEASURES = "struct<" + ",".join(f"{c}:bigint" for c in BASE) + "," + ",".join(f"{c}:double" for c in RULES) + ">"

_CONTINUATION = bytes(range(0x80, 0xC0))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MARK_RUNS = re.compile(b"[" + re.escape(_MARKS) + b"]{2,}").findall
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], suspects: bool = True) -> int:
    """Words inside windows of SPAN words that are found twice or more, exactly."""
    if not suspects or len(words) <= SPAN:
        return 0
    spans = [tuple(words[k : k + SPAN]) for k in range(len(words) - SPAN + 1)]
    count = Counter(spans)
    total, upto = 0, 0
    for k, span in enumerate(spans):
        if count[span] > 1:
            total += k + SPAN - max(k, upto)
            upto = k + SPAN
    return total


def _may_repeat(words: list[bytes]) -> bool:
    """False only if no window of SPAN words comes twice (windows are compared by a hash)."""
    if len(words) <= SPAN:
        return False
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SPAN + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SPAN):
        mixed = mixed * _ODD + h[k : k + n]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _entropy(text: bytes) -> float:
    """Bits per byte by the frequencies of bytes."""
    count = np.bincount(np.frombuffer(text, np.uint8))
    share = count[count > 0] / len(text)
    return float(-(share * np.log2(share)).sum())


def measure(text: bytes) -> tuple:
    """BASE counts and RULES measures of a whole text.

    The measures are shares of characters that are symbols, of letters that
    are capitals, of words in repeated windows, of lines that repeat, of words
    that equal the one before; runs of punctuation for a word; words without
    letters or digits; what compression saves; and how far bytes are from
    evenly used.
    """
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, ASCII_SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words, _may_repeat(words))
    if not n:
        return (0,) * len(BASE) + (0.0,) * len(RULES)
    capitals, small = len(text) - len(text.translate(None, _CAPITALS)), len(text) - len(text.translate(None, _SMALL))
    same = sum(map(bytes.__eq__, words[1:], words))
    rules = (
        min(1.0, symbols / chars),
        capitals / max(1, capitals + small),
        repeats / n,
        dup_lines / max(1, len(lines)),
        same / n,
        min(1.0, len(_MARK_RUNS(text)) / n),
        (n - len(text.translate(None, _MARKS).split())) / n,
        max(0.0, 1.0 - len(zlib.compress(text, 1)) / len(text)),
        1.0 - _entropy(text) / 8,
    )
    return (n, chars, symbols, dup_lines, repeats, *rules)


def with_measures(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measure(t) for t in batch], columns=[*BASE, *RULES])

    return docs.withColumn(name, measured(as_bytes(F.col(text_col))))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for a binomial X, exactly summed."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    logs = math.lgamma(n + 1) - lgamma(i + 1.0).astype(float) - lgamma(n - i + 1.0).astype(float) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = float(logs.max())
    return top + math.log(float(np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share of which k in n were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid < 1 and log_binomial_tail(k, n, mid) > math.log(error):
            low = mid
        else:
            high = mid
    return high


def tune(good: np.ndarray, bad: np.ndarray) -> int:
    """The step to cut at by counts of documents per step (0 .. STEPS): where the bad ones rejected outweigh GAIN times the good ones most; STEPS + 1 if nowhere."""
    gain = np.cumsum((bad - GAIN * good)[::-1])[::-1][1:]
    return int(np.flatnonzero(gain == gain.max())[-1]) + 1 if gain.max() > 0 else STEPS + 1


def certify(rejected: np.ndarray, good: int, limit: float, error: float) -> tuple[int, float, str]:
    """The strictest level that holds, the bound of its share of good documents rejected, and why it isn't stricter.

    ``rejected[t]`` counts the certifying part's good documents rejected at
    level t (0 the tuned cutoffs, LEVELS rejects nothing).
    """
    level = LEVELS
    while level > 0 and good and log_binomial_tail(int(rejected[level - 1]), good, limit) <= math.log(error):
        level -= 1
    if level < LEVELS:
        return level, upper_bound(int(rejected[level]), good, error), "certified"
    return level, 0.0, "too few labels" if good * math.log1p(-limit) > math.log(error) else "no cutoffs within the limit"


def _cut(tuned, level):
    """The step that a rule cuts at on a level of the path; no step at level LEVELS."""
    return F.ceil(tuned + (F.lit(STEPS + 1) - tuned) * level / LEVELS)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, name: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row per stratum with labels: ``stratum, cuts`` (rule -> step), ``level, rejected_good, good, bound, reason, base_rejected``.

    All labelled documents are counted, each once: repeated labels that agree
    are one, documents with contrary labels are left out, and of rows that
    repeat an id the least (by stratum and measures) counts.  One in PARTS, by
    a hash of the id, tunes; the others certify.  Both are of documents that
    pass the base rules, which have their say before: ``bound`` is a bound of
    the share of these that the cutoffs reject, and ``base_rejected`` counts
    the certifying part's good documents that the base rules reject, outside
    of it.  The groups that decide hold counts only.
    """
    step = lambda rule: F.ceil(F.col(name)[rule] * STEPS).cast("int")
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_quality"), F.max("quality").cast("int").alias("_other"))
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), step(r).alias("step")) for r in RULES])
    own = measured.select(F.col(id_col).alias("_own"), F.struct(F.col(stratum_col).alias("stratum"), base_failed(F.col(name)).alias("failed"), steps.alias("steps")).alias("d"))
    once = own.join(known.filter("_quality = _other").drop("_other"), F.col("_own") == F.col("_id")).groupBy("_id", "_quality").agg(F.min("d").alias("d"))
    rows = frozen(once.select("d.*", "_quality", (F.pmod(F.xxhash64(F.col("_id")), F.lit(PARTS)) != 0).alias("certifies")))
    counts = rows.filter("not certifies and not failed").select("stratum", "_quality", F.explode("steps").alias("s")).groupBy("stratum", "s.rule", "s.step", "_quality").agg(F.count("*").alias("n"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        def of(rule: str, quality: int) -> np.ndarray:
            out = np.zeros(STEPS + 1)
            part = group[(group["rule"] == rule) & (group["_quality"] == quality)]
            np.add.at(out, part["step"].to_numpy(int), part["n"].to_numpy(float))
            return out

        return pd.DataFrame([{"_stratum": group["stratum"].iloc[0]} | {r: tune(of(r, 1), of(r, 0)) for r in RULES}])

    tuned = frozen(counts.groupBy("stratum").applyInPandas(choose, "_stratum string, " + ", ".join(f"{r} int" for r in RULES)))
    over = [F.when(~F.col("failed") & reduce(or_, [F.col("steps")[k]["step"] >= _cut(F.col(r), F.lit(t)) for k, r in enumerate(RULES)]), 1).otherwise(0) for t in range(LEVELS)]
    good = rows.filter("certifies and _quality = 1").join(tuned, F.col("stratum").eqNullSafe(F.col("_stratum")))
    tested = good.groupBy("_stratum").agg(F.count_if(~F.col("failed")).alias("good"), F.count_if("failed").alias("base"), F.array(*[F.sum(x) for x in over], F.lit(0).cast("long")).alias("rejected"))
    each = error / max(1, tuned.count())

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [certify(np.asarray(r), int(n), risk, each) for r, n in zip(batch["rejected"], batch["good"], strict=True)]
            columns = {"of": batch["_stratum"], "level": [x[0] for x in found], "rejected_good": [int(r[x[0]]) for r, x in zip(batch["rejected"], found, strict=True)]}
            yield pd.DataFrame(columns | {"good": batch["good"], "base": batch["base"], "bound": [x[1] for x in found], "reason": [x[2] for x in found]})

    decided = tested.mapInPandas(decide, "of string, level int, rejected_good long, good long, base long, bound double, reason string")
    cuts = F.create_map(*[x for r in RULES for x in (F.lit(r), _cut(F.col(r), F.col("level")).cast("int"))])
    both = tuned.join(decided, F.col("_stratum").eqNullSafe(F.col("of")), "left")
    both = both.withColumns({"level": F.coalesce("level", F.lit(LEVELS)), "reason": F.coalesce("reason", F.lit("too few labels"))})
    return both.select(F.col("_stratum").alias("stratum"), cuts.alias("cuts"), "level", "rejected_good", "good", "bound", "reason", F.col("base").alias("base_rejected"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Judge every document by the base rules and by the certified rules of its stratum.

    Returns one row per document: the id as ``doc_id``, the BASE counts,
    ``base_failed`` (under MIN_WORDS words, or over REPEAT_PERCENT percent of
    them in repeated windows), ``kept``, ``failed_rules`` and ``certificate``:
    why the rules of its stratum are as strict as they are ("no labels", or
    the ``reason`` of ``thresholds``).  Documents without certified cutoffs in
    their stratum are kept unless the base rules fail; null is a stratum of
    its own.  Null texts count as empty and fail; repeated rows are judged
    alike; an empty table gives no rows; labels other than 0 and 1 are
    ignored, as are further columns.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    measured = frozen(with_measures(source, "text", "m").select("doc_id", "stratum", "m"))
    found = frozen(thresholds(measured, labels, "doc_id", "stratum", "m").select(F.col("stratum").alias("_stratum"), "cuts", "reason"))
    judged = measured.join(F.broadcast(found) if found.count() <= FEW else found, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.ceil(F.col("m")[r] * STEPS) >= F.coalesce(F.col("cuts")[r], F.lit(STEPS + 1)), F.lit(r)) for r in RULES]))
    counts = [F.col("m")[c].alias(c) for c in BASE]
    out = judged.select("doc_id", *counts, base_failed(F.col("m")).alias("base_failed"), failed.alias("failed_rules"), F.coalesce("reason", F.lit("no labels")).alias("certificate"))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules", "certificate")
