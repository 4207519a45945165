from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillsift.llm import license_scan, mixing, packing, quality_classifier, quality_rules, token_counts
from quillsift.llm.queries import BYTE_BPE
from tests.llm.conftest import HARD


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


# --- packing --------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers(tokenizer):
    ids, rng = packing.token_ids(BYTE_BPE), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "don", "12", "³", "é", "|", "<|endoftext|>", " ", "\xa0", "!!", "中", "\r", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_added_tokens_have_their_ids(spark):
    """At the default setting of ``tokenizers``, the literal of an added token is that token."""
    default = Tokenizer.from_file(BYTE_BPE)
    ids, rng = packing.default_ids(BYTE_BPE), random.Random(4)
    parts = [" ", "  ", "\n", "a", "Bc", "'s", "12", "é", "|", "<|", "<|endoftext|>", "\xa0", "中"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000))]
    wanted = {k: np.array(default.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for k, t in enumerate(texts)}
    assert all(ids(t) == wanted[k] for k, t in enumerate(texts))
    got = packing.pack(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id bigint, text string"), BYTE_BPE, 256).collect()
    unpack(got, {k: wanted[k] + bytes(4) for k in range(50)}, 256)


def unpack(rows, ids, capacity):
    """Check pieces and places; returns the ids of each document."""
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, pieces in docs.items():
        start = 0
        for n, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (n, start)
            assert p.ids_crc32 == zlib.crc32(ids[doc][4 * start : 4 * (start + p.length)])
            start += p.length
        assert 4 * start == len(ids[doc])
    return bins


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(1)
    rows = [(k, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 30, 90, 400])))) for k in range(300)]
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for k, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20), BYTE_BPE, 256).collect()
    bins = unpack(got, ids, 256)
    assert {r.doc_id for r in got} == set(ids)
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 4 / 256) * 1.03 + 1


def test_the_shorter_piece_comes_first(spark, tokenizer):
    rows = [(k, " ".join(["word"] * n)) for k, n in enumerate([1, 254, 255, 256, 511, 600, 1023])]
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for k, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTE_BPE, 256).collect()
    unpack(got, ids, 256)
    for k in ids:
        lengths = [r.length for r in sorted(got, key=lambda r: r.piece) if r.doc_id == k]
        assert lengths[1:] == [256] * (math.ceil(len(ids[k]) / 4 / 256) - 1)


def test_bins_handed_on_are_all_that_can_be_used(spark, tokenizer, monkeypatch):
    """Limiting what a node gets to what it could use changes nothing: as few sequences as if all bins went up, near the bound."""
    rng = random.Random(5)
    words = [rng.choice([1, 2, 3, 50, 55, 60, 65, 70, 75, 80, 90, 110, 140]) for _ in range(3000)]
    rows = [(f"d{k}", " ".join(["word"] * n)) for k, n in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(13).cache()
    monkeypatch.setattr(packing, "LEAF_PIECES", 60)
    found = {}
    for levels in (packing.LEVELS, 10**6):
        monkeypatch.setattr(packing, "LEVELS", levels)
        got = packing.pack(docs, BYTE_BPE, 128, fan_in=3).collect()
        bins = unpack(got, {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for k, t in rows}, 128)
        found[levels] = len(bins)
        assert {r.doc_id for r in got} == {k for k, _ in rows}
    assert len(set(found.values())) == 1
    fills = [sum(n for _, n in places) for places in bins.values()]
    assert sum(f <= 64 for f in fills) <= 1


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(24)
    total, sequences = packing.pack(docs, BYTE_BPE).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert math.ceil(total / 2048) <= sequences <= math.ceil(total / 2048) * 1.02


def test_best_fit():
    bins = packing.best_fit([(6, ["a"]), (5, ["b"]), (5, ["c"]), (4, ["d"]), (10, ["e"])], 10)
    assert sorted(sorted(m) for _, m in bins) == [["a", "d"], ["b", "c"], ["e"]]


def test_packing_hard_rows(hard, empty):
    got = packing.pack(hard, BYTE_BPE, 2048).collect()
    assert sum(r.piece == 0 for r in got) == len(HARD) and [r.length for r in got if r.doc_id == 2] == [1]
    assert packing.pack(empty, BYTE_BPE).count() == 0


# --- token counts, licenses -----------------------------------------------------------------------


def greedy(word: bytes, pieces: set) -> int:
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(800):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        automaton = token_counts.Automaton(pieces)
        for _ in range(10):
            word = bytes(rng.choices(b"abcd", k=rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark, data, hard, empty):
    byte_of = packing.byte_alphabet()
    vocab = json.load(open(BYTE_BPE, encoding="utf-8"))["model"]["vocab"]
    pieces = {bytes(map(byte_of.__getitem__, t)) for t in vocab if all(c in byte_of for c in t)}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in token_counts.count_tokens(docs, BYTE_BPE).collect():
        words = r.text.encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, pieces) for w in words))
    got = token_counts.count_tokens(hard, BYTE_BPE)
    assert got.count() == len(HARD) and got.filter("doc_id in (2, 3, 6)").agg(F.sum("n_tokens")).first()[0] == 0
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def brute_share(h: np.ndarray, wanted: np.ndarray) -> float:
    span = len(wanted) + len(wanted) // 4
    return max((len(np.intersect1d(h[s : s + span], wanted)) / len(wanted) for s in range(len(h))), default=0)


def brute_licenses(text: bytes) -> dict:
    out = {}
    for name, template in license_scan.TEMPLATES.items():
        size = min(5, len(re.findall(r"[0-9a-z]+", template.lower())))
        words = license_scan._word_hashes(text)
        h = license_scan._runs(words, size) if len(words) >= size else np.empty(0, np.uint64)
        share = brute_share(h, np.unique(license_scan.shingles(template.encode())))
        if share >= license_scan.CONTAINMENT:
            out[name] = share
    return out


def test_licenses_equal_brute_force(spark, hard, empty):
    rng = random.Random(6)
    names = sorted(license_scan.TEMPLATES)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(150))]
        for name in rng.sample(names, rng.randrange(3)):
            notice = license_scan.TEMPLATES[name].split()
            if len(notice) > 25 and rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.1 else w for w in notice]
        rows.append((k, " ".join(words)))
    got = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    expected = {k: found for k, t in rows if (found := brute_licenses(t.encode()))}
    assert got == expected and len(expected) > 20
    assert license_scan.scan_licenses(hard).count() == 0 and license_scan.scan_licenses(empty).count() == 0


def test_short_notices_are_found_inside_texts(spark):
    rows = [(1, "Copyright 2020 Acme. ALL RIGHTS reserved. Write to us."), (2, "All rights are reserved."), (3, "All rights reserved.")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), license_scan.TEMPLATES).collect()
    assert sorted((r.doc_id, r.license, r.first_word, r.containment) for r in got) == [(1, "all-rights-reserved", 3, 1.0), (3, "all-rights-reserved", 0, 1.0)]


def test_license_windows_are_twice_their_template():
    """The bound on misses holds for windows of 2 m shingles that have the whole notice."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, wanted in zip(scanner.names, scanner.sets, strict=True):
        for before in range(0, 150, 7):
            words = [f"a{k}" for k in range(before)] + license_scan.TEMPLATES[name].split() + [f"b{k}" for k in range(150)]
            text = " ".join(words).encode()
            mine = [(s, e) for t, s, e in scanner.candidates(license_scan.shingles(text)) if scanner.names[t] == name]
            assert len(wanted) == 1 or any(s <= before and before + len(wanted) <= e for s, e in mine), (name, before)
            assert all(e - s <= 2 * len(wanted) for s, e in mine)
            assert (name, before, 1.0) in scanner.scan(text)


def test_license_bands_find_what_is_contained():
    """The bound on misses is computed from what a window has at least; damaged texts are found at every place of long texts."""
    assert (1 - license_scan.resemblance(license_scan.CONTAINMENT)) ** license_scan.BANDS <= license_scan.MISS
    scanner, rng = license_scan.Scanner(license_scan.TEMPLATES), random.Random(7)
    for name, wanted in zip(scanner.names, scanner.sets, strict=True):
        if len(wanted) < 30:
            continue
        words = license_scan.TEMPLATES[name].split()
        for at in (license_scan.BLOCK - len(wanted) // 2, license_scan.BLOCK - 1, license_scan.BLOCK, 3):
            damaged = list(words)
            for k in rng.sample(range(len(words)), len(wanted) // 40):
                damaged[k] = "changed"
            text = " ".join([f"a{k}" for k in range(at)] + damaged + [f"b{k}" for k in range(900)]).encode()
            expected = brute_share(license_scan.shingles(text)[max(0, at - 30) : at + 3 * len(wanted)], wanted)
            assert expected >= license_scan.CONTAINMENT and {n: c for n, _, c in scanner.scan(text)}[name] == expected


def test_license_bands_are_what_retrieves(monkeypatch):
    """Texts searched many at once give what each gives alone; without a common band nothing is found, whatever shingles there are."""
    monkeypatch.setattr(license_scan, "BLOCK", 300)
    scanner, rng = license_scan.Scanner(license_scan.TEMPLATES), random.Random(11)
    texts = [b"", b"one", b"MIT"]
    for _ in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(700))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = license_scan.TEMPLATES[rng.choice(scanner.names)].split()
        texts.append(" ".join(words).encode())
    alone = [scanner.scan(t) for t in texts]
    assert scanner.scan_all(texts) == alone and sum(map(bool, alone)) >= 55
    assert alone == [[(n, w, c) for n, w, c in found] for found in license_scan.Scanner(license_scan.TEMPLATES).scan_all(texts)]
    monkeypatch.setattr(license_scan.Bands, "agreeing", lambda self, keys: set())
    single = {n for n, s in zip(scanner.names, scanner.sets, strict=True) if len(s) == 1}
    assert all(n in single for found in scanner.scan_all(texts) for n, *_ in found)


# --- quality rules --------------------------------------------------------------------------------


def brute_measure(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(spans)
    covered = {k + i for k, s in enumerate(spans) if count[s] > 1 for i in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_measures_equal_brute_force():
    rng = random.Random(9)
    texts = ["", " ", "a", "é" * 30, *(t for _, t, *_ in HARD if t)]
    for _ in range(300):
        vocabulary = rng.choice([["a"], ["a", "b"], [f"w{k}" for k in range(30)], ["é#", "<x>", "日本", "|", "b\x0b", "c\r"]])
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", " \n"]) for _ in range(rng.randrange(60))))
    for text in texts:
        assert quality_rules.measure(text.encode())[:5] == brute_measure(text), repr(text)


def test_binomial_bounds():
    exact = sum(math.comb(30, k) * 0.1**k * 0.9 ** (30 - k) for k in range(3))
    assert quality_rules.log_binomial_tail(2, 30, 0.1) == pytest.approx(math.log(exact))
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)
    bound = quality_rules.upper_bound(3, 50, 0.05)
    assert sum(math.comb(50, k) * bound**k * (1 - bound) ** (50 - k) for k in range(4)) == pytest.approx(0.05)


def test_certified_level_holds_its_risk():
    """Of many draws, few certify a level that rejects more than the limit in truth."""
    rng, wrong = np.random.default_rng(3), 0
    truth = np.linspace(0.12, 0.0, quality_rules.LEVELS + 1)
    for _ in range(400):
        rejected = np.sort(rng.binomial(300, truth))[::-1]
        level, bound, reason = quality_rules.certify(rejected, 300, 0.05, 0.05)
        wrong += truth[level] > 0.05
        assert bound <= 0.05 + 1e-9 and (reason == "certified") == (level < quality_rules.LEVELS)
    assert wrong <= 400 * 0.05 + 12


def test_rules(spark, hard, empty):
    rng = random.Random(2)

    def text(bad):
        words = [f"word{rng.randrange(5000)}" for _ in range(60)]
        return " ".join(w + "$$$" for w in words) if bad else " ".join(words)

    rows = [(k, text(k % 5 == 0), "en" if k % 3 else "fr", "s") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = docs.filter("doc_id < 1200").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert len(got) == 1500 and not any(r.base_failed or (r.kept and k % 5 == 0) for k, r in got.items())
    assert sum(r.kept for r in got.values()) >= 0.95 * 1200
    # Too few labels certify nothing.
    few = quality_rules.apply_rules(docs, labels.limit(10)).filter("not base_failed")
    assert few.filter("not kept").count() == 0
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id bigint, quality int"))
    out = quality_rules.apply_rules(hard, odd).collect()
    assert len(out) == len(HARD) and all(r.base_failed and not r.kept for r in out if r.n_words < 20)
    assert quality_rules.apply_rules(empty, labels.limit(0)).count() == 0


def brute_rules(docs: list, labels: dict) -> dict:
    """{id: (base_failed, kept)} from the measures, document by document."""
    q = quality_rules
    tunes = dict(docs_hash)
    found = {k: (lang, q.measure((t or "").encode())) for k, t, lang in docs}
    failed = {k: m[0] < 20 or 100 * m[4] > 30 * m[0] for k, (_, m) in found.items()}
    step = {k: [math.ceil(x * q.STEPS) for x in m[5:]] for k, (_, m) in found.items()}
    strata = sorted({lang for lang, _ in found.values()})
    tuned = {}
    for s in strata:
        ids = [k for k in labels if k in found and found[k][0] == s and tunes[k] == 0 and not failed[k]]
        if ids:
            tuned[s] = [max((c for c in range(q.STEPS + 2)), key=lambda c, r=r: (sum((1 if labels[k] == 0 else -q.GAIN) for k in ids if step[k][r] >= c) if 0 < c <= q.STEPS else 0, c)) for r in range(len(q.RULES))]
    out = {}
    for s in strata:
        cuts = None
        if s in tuned:
            good = [k for k in labels if k in found and found[k][0] == s and tunes[k] != 0 and labels[k] == 1 and not failed[k]]
            cut = lambda level, s=s: [math.ceil(c + (q.STEPS + 1 - c) * level / q.LEVELS) for c in tuned[s]]
            level = q.LEVELS
            while level > 0 and good:
                rejected = sum(any(x >= c for x, c in zip(step[k], cut(level - 1), strict=True)) for k in good)
                tail = sum(math.comb(len(good), i) * q.RISK**i * (1 - q.RISK) ** (len(good) - i) for i in range(rejected + 1))
                if tail > q.ERROR / len(tuned):
                    break
                level -= 1
            cuts = cut(level)
        for k in found:
            if found[k][0] == s:
                out[k] = (failed[k], not failed[k] and not (cuts and any(x >= c for x, c in zip(step[k], cuts, strict=True))))
    return out


docs_hash: dict = {}


def test_rules_equal_brute_force(spark):
    """The whole judgement, tuning and certificate included, on one small table."""
    rng = random.Random(12)
    rows = []
    for k in range(2400):
        bad = rng.random() < 0.2
        words = [f"word{rng.randrange(400)}" + ("!!" if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(10, 60))]
        if bad and rng.random() < 0.5:
            words = words[:8] * 5
        if rng.random() < 0.03:
            words = [w.upper() + " #$" for w in words]
        rows.append((k, " ".join(words), rng.choice(["en", "en", "de", "xx"]), int(not bad)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = [(k, q) for k, _, lang, q in rows if lang != "xx" or k % 40 == 0]
    given = spark.createDataFrame(labels + labels[:300] + [(labels[500][0], 1 - labels[500][1])], "doc_id bigint, quality int")
    known = dict(labels)
    del known[labels[500][0]]
    docs_hash.update((r.doc_id, r.h) for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.PARTS)).alias("h")).collect())
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, given).collect()}
    expected = brute_rules([r[:3] for r in rows], known)
    assert {k: (r.base_failed, r.kept) for k, r in got.items()} == expected
    assert {r.certificate for r in got.values()} == {"certified", "too few labels"}
    assert sum(not kept and not base for base, kept in expected.values()) > 50


# --- classifier -----------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, hard, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rule = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 3 != 1"
    scored = quality_classifier.score(docs, labels, rule)
    assert scored.columns == [*docs.columns, "score"]
    held = scored.join(labels, "doc_id").filter(f"not ({rule})").select("score", "quality").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in held) / len(held)
    assert len(held) > 100 and right > 0.95 and all(0 <= r.score <= 1 for r in held)
    out = quality_classifier.score(hard, labels.limit(0), rule)
    assert out.count() == len(HARD) and quality_classifier.score(empty, labels, rule).count() == 0


def test_context_vectors_equal_brute_force(spark):
    """Sums of the neighbours' index vectors over all documents, and a document's pooled vector, word by word."""
    q, rng = quality_classifier, random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "Cd", "!!", "e", "e", "f2"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, ""]
    table = q.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text")
    place, sign = q._index_vectors()
    expected = np.zeros((q.WORDS, q.DIM))
    for t in texts:
        b = q.word_buckets((t or "").encode()).tolist()
        for i, center in enumerate(b):
            for j, near in enumerate(b):
                if 0 < abs(i - j) <= q.NEAR:
                    for k in range(q.NONZERO):
                        expected[center, place[near, k]] += sign[near, k]
    norm = np.linalg.norm(expected, axis=1, keepdims=True)
    expected = expected / np.where(norm > 0, norm, 1)
    assert np.allclose(table, expected, atol=1e-5) and np.abs(expected).sum() > 0
    for t in texts[:10]:
        b = q.word_buckets(t.encode())
        rows = expected[b]
        got = q.pooled(t.encode(), table)
        if len(b):
            assert np.allclose(got[: q.DIM], rows.mean(axis=0), atol=1e-5) and np.allclose(got[q.DIM : 2 * q.DIM], rows.std(axis=0), atol=1e-3)
        else:
            assert not got.any()


def test_training_rows_are_bounded(spark, monkeypatch):
    """Repeated rows and labels count once, and contrary labels not at all."""
    seen = []
    monkeypatch.setattr(quality_classifier, "TRAINING_ROWS", 20)
    monkeypatch.setattr(quality_classifier, "train", lambda x, y: seen.append((len(x), y.tolist())) or quality_classifier.Network(np.zeros(131), np.ones(131), np.zeros((131, 2)), np.zeros(2), np.zeros(2), 0.0))
    docs = spark.createDataFrame([(k % 30, f"text {k % 30}") for k in range(900)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k % 30, k % 2) for k in range(60)] + [(0, 1)], "doc_id bigint, quality int")
    assert quality_classifier.score(docs, labels, "true").count() == 900 and seen[0][0] == 20
    few = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1)], "doc_id bigint, quality int")
    assert quality_classifier.score(docs, few, "true").count() == 900 and seen[1] == (1, [1.0])


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 6))
    y = (x[:, 0] + rng.normal(scale=1.5, size=1200) > 0).astype(float)
    net = quality_classifier.train(x, y)
    raw = np.clip(net.logit(x), -60, 60)
    loss = lambda z: np.mean(np.logaddexp(0, z) - y * z)
    assert loss(raw / net.temperature) <= loss(raw) + 0.01 and loss(raw) < 0.68
    one = quality_classifier.train(x, np.ones(1200))
    assert np.allclose(one.score(x), 1201 / 1202)


# --- mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Shares by weight, none above three times its source, by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(spark, hard, empty):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * int(rng.lognormvariate(4, 1))), rng.choice(["b", "a", "ü", "z", None, "tiny"] if k < 30 else ["a", "b", "ü", "z", None])) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == 6000
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    expected = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and mine[0].target == pytest.approx(expected[s])
        assert abs(sum(r.taken for r in mine) - expected[s]) <= 20 and all(r.taken <= 3 * r.size for r in mine)
        ratio, n = expected[s] / sizes[s], len(mine)
        if n > 100:  # documents are balanced as well as words
            assert abs(sum(r.copies for r in mine) - ratio * n) <= 10
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert sum(len(r.text.split()) for r in mixing.apply_mix(docs).collect()) == sum(again.values())
    out = mixing.mix(hard)
    assert out.count() == len(HARD) and out.filter("taken > 3 * size").count() == 0
    assert mixing.apply_mix(hard).columns == hard.columns
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_mixing_many_sources(spark, monkeypatch):
    """A source for each document, and one with a third of all: targets are met without a table of sources in one place."""
    monkeypatch.setattr(mixing, "FEW", 50)
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 9)), "hot" if k % 3 == 0 else f"s{k}") for k in range(1500)] + [(9999, "same row twice", "hot")] * 700
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)).collect()
    assert len(got) == len(rows) and len({r.copies for r in got if r.doc_id == 9999}) == 1
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    expected = brute_targets(sizes)
    assert all(r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source] for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(7)
    size, p = np.sort(rng.integers(1, 900, 400))[::-1].astype(float), np.full(400, 0.37)
    moved = mixing.flight(p, size, iter(rng.random, None))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(p.sum(), abs=1e-5) and (moved * size).sum() == pytest.approx((p * size).sum(), abs=1e-2)


def test_flight_inclusion_is_fair():
    rng = np.random.default_rng(4)
    size = np.array([9, 7, 5, 4, 3, 2, 1, 1], float)
    mean = np.mean([mixing.flight(np.full(8, 0.4), size, iter(rng.random, None)) for _ in range(3000)], axis=0)
    assert np.allclose(mean, 0.4, atol=0.05)
