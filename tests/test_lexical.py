"""Stems and the stored lexical index against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift.functions import stems
from quillsift.operators import lexical, retrieval

# --- stems ----------------------------------------------------------------------------------------

VOWELS = "aeiouy"


def brute_stem(word):
    """The stemmer letter by letter, with positions instead of patterns."""
    if len(word) <= 2:
        return word
    if word in stems.WHOLE_WORDS:
        return stems.WHOLE_WORDS[word]
    s = list(word)
    for i, c in enumerate(s):
        if c == "y" and (i == 0 or s[i - 1] in VOWELS):
            s[i] = "Y"
    w = "".join(s)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    r2 = region(r1)
    vowel = lambda x: any(c in VOWELS for c in x)

    def short(x):
        if len(x) == 2:
            return x[0] in VOWELS and x[1] not in VOWELS
        return len(x) > 2 and x[-1] not in VOWELS and x[-1] not in "wxY" and x[-2] in VOWELS and x[-3] not in VOWELS

    def ending(options):
        return max((e for e in options if w.endswith(e)), key=len, default="")

    end = ending(["sses", "ied", "ies", "us", "ss", "s"])
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and vowel(w[:-2]):
        w = w[:-1]
    if w in stems.DONE_EARLY:
        return w
    end = ending(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end.startswith("eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w[-2:] in ("at", "bl", "iz"):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif len(w) == r1 and short(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = ending(stems.STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + stems.STEP_2[end]
    end = ending(stems.STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + stems.STEP_3[end]
    end = ending(stems.STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Published pairs of the stemmer's description, and common words.
KNOWN = dict(
    p.split(":")
    for p in """consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist
    consistently:consist consolation:consol consolations:consol consolatory:consolatori console:consol knack:knack knackeries:knackeri knavish:knavish kneaded:knead
    kneel:kneel kneeling:kneel knees:knee knell:knell knightly:knight knitting:knit knives:knive knocked:knock knotted:knot hoping:hope hopping:hop running:run
    generously:generous generate:generat communism:communism relational:relat skies:sky dying:die proceed:proceed happy:happi ties:tie cries:cri cry:cri by:by say:say
    gas:gas this:this gaps:gap kiwis:kiwi luxuriated:luxuri using:use national:nation rational:ration hopeful:hope goodness:good adjustment:adjust
    replacement:replac controlling:control rolled:roll engineering:engin engineers:engin databases:databas""".split()
)


def test_stems_of_known_words(spark):
    df = spark.createDataFrame([(k,) for k in KNOWN], "term string")
    got = {r.term: r.stem for r in df.withColumn("stem", stems.stem(F.col("term"))).collect()}
    assert got == KNOWN
    assert {k: brute_stem(k) for k in KNOWN} == KNOWN


def test_stems_equal_brute_force(spark, data):
    rng = random.Random(5)
    heads = ["gener", "commun", "arsen", "hop", "lov", "y", "ab", "str", "ee", "oy", "syz", "pl", "con", "tr", "b", "fulfil"]
    tails = ["", "e", "s", "ed", "ing", "ly", "ied", "ies", "eed", "eedly", "ss", "y", "ll", *stems.STEP_2, *stems.STEP_3, *stems.STEP_4]
    words = {"".join(rng.choice(x) for x in (heads, ["", "a", "ay", "is", "tion", "iv", "at"], tails, ["", "s", "ed", "ly"])) for _ in range(6000)}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        words |= {t for t in re.split(r"[\W_]+", (r.text or "").lower()) if t}
    words |= {"日本語", "é", "école", "123s", "ûs", *stems.STOP_WORDS, *stems.WHOLE_WORDS, *stems.DONE_EARLY}
    got = {r.term: r.stem for r in spark.createDataFrame([(w,) for w in sorted(words)], "term string").repartition(4).withColumn("stem", stems.stem(F.col("term"))).collect()}
    assert {w for w in words if got[w] != brute_stem(w)} == set()


# --- index ----------------------------------------------------------------------------------------


def brute_terms(text, english):
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    if not english:
        return list(enumerate(words))
    return [(k, brute_stem(w)) for k, w in enumerate(words) if w not in stems.STOP_WORDS]


def brute_density(entries, n):
    """Shortest stretches with all terms, by trying all; entries: (position, term, weight)."""
    entries, total = sorted(entries), 0.0
    spans = [(i, j) for i in range(len(entries)) for j in range(i, len(entries)) if len({t for _, t, _ in entries[i : j + 1]}) == n]
    for i, j in spans:
        if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans):
            size = j - i + 1
            total += size / sum(1 / w for _, _, w in entries[i : j + 1]) / (1 + entries[j][0] - entries[i][0] - (size - 1))
    return round(total, 6)


def brute_search(queries, chunks, k, english):
    """``chunks``: id -> (tenant, fields: list of (text, weight))."""
    out = {}
    for q, (tenant, text) in queries.items():
        wanted, found = {t for _, t in brute_terms(text, english)}, []
        for c, (owner, fields) in chunks.items():
            if owner != tenant or not wanted:
                continue
            entries, start = [], 0
            for body, weight in fields:
                entries += [(start + at, t, weight) for at, t in brute_terms(body, english) if t in wanted]
                start += len(brute_terms(body, False))
            if {t for _, t, _ in entries} == wanted:
                found.append((-brute_density(entries, len(wanted)), c))
        for rank, (score, c) in enumerate(sorted(found)[:k], 1):
            out[q, rank] = (c, -score)
    return out


WORDS = ["engine", "engines", "running", "runs", "the", "of", "data", "database", "databases", "team", "lead", "leading", "payment", "payments"]


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 4, 12, 30]))) for _ in range(n)]


@pytest.mark.parametrize(("english", "zone", "first"), [(False, 8, 1), (True, 8, 2), (True, 3, 1), (True, 1024, 4)])
def test_index_equals_brute_force(spark, tmp_path, monkeypatch, english, zone, first):
    monkeypatch.setattr(lexical, "ZONE", zone)
    monkeypatch.setattr(lexical, "FIRST", first)
    rng = random.Random(zone)
    bodies = texts(rng, 150) + [None, "", "The of THE", "Data. " * 400]
    chunks = {k: ("t" if k % 4 else "u", [(b, 0.1)]) for k, b in enumerate(bodies)}
    df = spark.createDataFrame([(k, t, k % 9, f[0][0]) for k, (t, f) in chunks.items()], "chunk_id int, tenant_id string, document_id int, content string")
    queries = {f"q{n}": ("t" if n % 3 else "u", text) for n, text in enumerate(["engine", "running data", "the of", "Leads the team", "", "payment databases engine", "data", "absent word"])}
    asked = spark.createDataFrame([(q, t, x) for q, (t, x) in queries.items()], "query_id string, tenant_id string, query string")
    index = lexical.build(df.repartition(3), str(tmp_path / "index"))
    index = lexical.with_stems(index, str(tmp_path / "stems")) if english else lexical.open_index(spark, str(tmp_path / "index"))
    hits, reads = lexical.search(index, asked, 6)
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in hits.collect()} == brute_search(queries, chunks, 6, english)
    every = {(r.query_id, r.chunk_id) for r in lexical.matches(index, asked).collect()}
    assert every == {(q, c) for (q, _), (c, _) in brute_search(queries, chunks, 999, english).items()}
    counts = {r.query_id: r for r in reads.collect()}
    assert all(0 < r.read <= r.zones for r in counts.values())


def test_zones_that_cannot_reach_the_top_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "ZONE", 8)
    bodies = ["data team " * (9 + k % 3) for k in range(40)] + ["some data of a team"] * 400
    df = spark.createDataFrame([(k, "t", k, b) for k, b in enumerate(bodies)], "chunk_id int, tenant_id string, document_id int, content string")
    asked = spark.createDataFrame([("one", "t", "data"), ("two", "t", "teams data")], "query_id string, tenant_id string, query string")
    hits, reads = lexical.search(lexical.with_stems(lexical.build(df, str(tmp_path / "index")), str(tmp_path / "stems")), asked, 5)
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in hits.collect()} == brute_search({"one": ("t", "data"), "two": ("t", "teams data")}, {k: ("t", [(b, 0.1)]) for k, b in enumerate(bodies)}, 5, True)
    for r in reads.collect():
        assert r.zones >= 50 and r.read <= 10


def test_labels_weigh(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "t", k, a, b) for k, (a, b) in enumerate(zip(texts(rng, 40), texts(rng, 40), strict=True))]
    df = spark.createDataFrame(rows, "chunk_id int, tenant_id string, document_id int, title string, content string")
    index = lexical.with_stems(lexical.build(df, str(tmp_path / "index"), {"title": "A", "content": "D"}), str(tmp_path / "stems"))
    queries = {"q": ("t", "data engines"), "r": ("t", "team")}
    asked = spark.createDataFrame([(q, t, x) for q, (t, x) in queries.items()], "query_id string, tenant_id string, query string")
    chunks = {k: ("t", [(a, 1.0), (b, 0.1)]) for k, _, _, a, b in rows}
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in lexical.top(index, asked, 7).collect()} == brute_search(queries, chunks, 7, True)


def test_plain_index_equals_postings(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.col("source").alias("document_id"), F.col("text").alias("content"))
    asked = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.lit("t").alias("tenant_id"), F.col("text").alias("query"))
    short = asked.withColumn("query", F.substring_index("query", " ", 2)).unionByName(asked.withColumn("query_id", F.col("query_id") + 1000))
    index = lexical.build(docs, str(tmp_path / "index"))
    ours = sorted(lexical.top(index, short, 20).select("query_id", "chunk_id", "score", "rank").collect())
    assert ours and ours == sorted(retrieval.lexical_top(short, retrieval.postings(docs), 20).select("query_id", "chunk_id", "score", "rank").collect())


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "chunk_id int, tenant_id string, document_id int, content string")
    index = lexical.with_stems(lexical.build(df, str(tmp_path / "index")), str(tmp_path / "stems"))
    asked = spark.createDataFrame([("q", "t", "engine")], "query_id string, tenant_id string, query string")
    assert lexical.top(index, asked, 3).collect() == []


def shuffled(spark, run):
    """Bytes that ``run`` shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_postings_are_shuffled_once_for_all_queries(spark, tmp_path, monkeypatch):
    """Twenty queries with the same terms shuffle little more than two, and find the same; so they do in groups of three queries."""
    rng = random.Random(8)
    df = spark.createDataFrame([(k, "t", k % 9, " ".join(rng.choices(WORDS, k=30))) for k in range(3000)], "chunk_id int, tenant_id string, document_id int, content string")
    index = lexical.build(df.repartition(3), str(tmp_path / "index"))
    rows = [(k, "t", "engine runs data team lead payment database") for k in range(20)]
    asked = lambda n: spark.createDataFrame(rows[:n], "query_id int, tenant_id string, query string")
    found = {}
    sizes = {n: shuffled(spark, lambda n=n: found.update({n: lexical.matches(index, asked(n)).collect()})) for n in (2, 20)}
    assert sizes[20] < 2 * sizes[2]
    each = {k: sorted(r.chunk_id for r in found[20] if r.query_id == k) for k in range(20)}
    assert each[0] and all(x == each[0] for x in each.values()) and each[0] == sorted(r.chunk_id for r in found[2] if r.query_id == 0)
    monkeypatch.setattr(lexical, "QUERIES", 3)
    assert sorted(lexical.matches(index, asked(20)).collect()) == sorted(found[20])
