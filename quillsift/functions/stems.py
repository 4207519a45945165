"""English stems and stop words, as expressions over a table of distinct terms.

The stemmer is the published English (Porter 2) suffix stripper: what a suffix
may do depends on the regions R1 and R2, which are fixed by the word's start,
so a step is one search for the longest suffix and one choice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop words, and the stemmer's suffixes and exceptions.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE_EARLY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

#: The start of a word up to its first consonant after a vowel; three starts are taken whole.
REGION = "^(.*?[aeiouy][^aeiouy])"
FIRST_REGION = "^(gener|commun|arsen|.*?[aeiouy][^aeiouy])"
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _choose(key: Column, values: dict[str, Column], other: Column) -> Column:
    return reduce(lambda rest, kv: F.when(key == kv[0], kv[1]).otherwise(rest), reversed(values.items()), other)


def _ending(word: Column, suffixes: list[str], body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the longest suffix that the word ends in (empty if none) and of what is before it."""
    longest = F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)
    return _let(longest, lambda end: _let(_without(word, F.length(end)), lambda base: body(end, base)))


def _without(word: Column, count: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - count)


def _region(text: Column, pattern: str) -> Column:
    return _let(F.length(F.regexp_extract(text, pattern, 1)), lambda found: F.when(found > 0, found).otherwise(F.length(text)))


def _plurals(w: Column) -> Column:
    def body(end: Column, base: Column) -> Column:
        ie = F.when(F.length(base) > 1, F.concat(base, F.lit("i"))).otherwise(F.concat(base, F.lit("ie")))
        return _choose(end, {"sses": F.concat(base, F.lit("ss")), "ied": ie, "ies": ie, "s": F.when(w.rlike("[aeiouy].+s$"), base).otherwise(w)}, w)

    return _ending(w, ["sses", "ied", "ies", "us", "ss", "s"], body)


def _past(w: Column, r1: Column) -> Column:
    """Past and progressive forms; what is left of them may get an e, or lose a doubled letter.  A last y may become i."""

    def body(end: Column, base: Column) -> Column:
        mended = (
            F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
            .when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(base, F.lit(1)))
            .when((F.length(base) == r1) & base.rlike(SHORT_END), F.concat(base, F.lit("e")))
            .otherwise(base)
        )
        eed = F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w)
        return F.when(end.isin("eed", "eedly"), eed).when((end != "") & base.rlike("[aeiouy]"), mended).otherwise(w)

    return F.regexp_replace(_ending(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"], body), "(?<=.[^aeiouy])[yY]$", "i")


def _replaced(w: Column, region: Column, table: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Column:
    """The word with its suffix replaced by the table, if the suffix lies in a region and is allowed after what is before it."""

    def body(end: Column, base: Column) -> Column:
        new = _choose(end, {k: F.lit(v) for k, v in table.items()}, F.lit(""))
        return F.when((end != "") & (F.length(base) >= region) & allowed(end, base), F.concat(base, new)).otherwise(w)

    return _ending(w, list(table), body)


def _last_letter(w: Column, r1: Column, r2: Column) -> Column:
    def body(end: Column, base: Column) -> Column:
        e = (F.length(base) >= r2) | ((F.length(base) >= r1) & ~base.rlike(SHORT_END))
        gone = F.when(end == "e", e).otherwise((end == "l") & (F.length(base) >= r2) & base.endswith("l"))
        return F.when(gone, base).otherwise(w)

    return _ending(w, ["e", "l"], body)


def _regular(w: Column, r1: Column, r2: Column) -> Column:
    step_2 = lambda x: _replaced(x, r1, STEP_2, lambda end, base: F.when(end == "ogi", base.endswith("l")).when(end == "li", base.rlike("[cdeghkmnrt]$")).otherwise(F.lit(True)))
    step_3 = lambda x: _replaced(x, r1, STEP_3, lambda end, base: (end != "ative") | (F.length(base) >= r2))
    step_4 = lambda x: _replaced(x, r2, dict.fromkeys(STEP_4, ""), lambda end, base: (end != "ion") | base.rlike("[st]$"))
    rest = lambda x: _let(_past(x, r1), lambda a: _let(step_2(a), lambda b: _let(step_3(b), lambda c: _let(step_4(c), lambda d: F.regexp_replace(_last_letter(d, r1, r2), "Y", "y")))))
    return _let(_plurals(w), lambda x: F.when(x.isin(DONE_EARLY), x).otherwise(rest(x)))


def stem(term: Column) -> Column:
    """The stem of a lower-case term; terms of one or two characters are their own.

    Each step is named once and used often, so the expression grows with the
    number of steps only; it is best used over distinct terms.
    """
    marked = F.regexp_replace(F.regexp_replace(term, "^y", "Y"), "([aeiouy])y", "$1Y")
    regular = _let(marked, lambda w: _let(_region(w, FIRST_REGION), lambda r1: _let(r1 + _region(F.substring(w, r1 + 1, F.length(w)), REGION), lambda r2: _regular(w, r1, r2))))
    return F.when(F.length(term) <= 2, term).otherwise(_choose(term, {k: F.lit(v) for k, v in WHOLE_WORDS.items()}, regular))
