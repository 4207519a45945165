"""Whitening, packing of several lengths and repair of conversations against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillsift.llm import multi_length, queries, repair, whitening
from quillsift.llm.queries import WORD_BPE

# --- whitening ------------------------------------------------------------------------------------


def brute_whitening(vectors, top=4):
    """By the eigenvalues of the covariance matrix of the distinct vectors."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=float)
    n, s = len(fit), [sum(int(v) for v in c) for c in zip(*sorted(set(x)), strict=True)]
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x], ((np.array(x) - np.array(s) / n) @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :top], (e / e.sum())[:top]


def check_whitening(rows, vectors, top=4):
    n, deviation, whitened, explained = brute_whitening(vectors, top)
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert len(rows) == len(vectors) * whitened.shape[1]
    for k in range(len(vectors)):
        assert all(r.n == n and r.deviation == deviation[k] and r.identity_error <= 1e-9 for r in got[k].values())
    for c in range(whitened.shape[1]):
        ours = np.array([got[k][c + 1].whitened for k in range(len(vectors))])
        assert min(np.abs(ours - whitened[:, c]).max(), np.abs(ours + whitened[:, c]).max()) < 1e-7
        assert abs(got[0][c + 1].explained / explained[c] - 1) < 1e-9


def test_whitening_equals_brute_force(spark, data):
    rows = queries.op11_embedding_whitening(spark, data).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    assert sorted(table) == list(range(len(table)))
    check_whitening(rows, [table[k] for k in range(len(table))])


def test_whitening_counts_copies_once(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5]).tolist()
    vectors += [vectors[0]] * 200
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(7)
    check_whitening(whitening.whiten(df).collect(), vectors)


def test_small_deviations_beside_large_ones(spark):
    """Columns of sizes 1e9 to 1: eigenvalues of a covariance matrix would lose the small ones."""
    rng = np.random.default_rng(2)
    whole = np.floor(rng.normal(size=(400, 3)) * [1e9, 1e4, 1e1])
    model = whitening.fit_whitening(spark.createDataFrame([(r,) for r in whole.astype(int).tolist()], "x array<long>"), 3)
    centred = whole - whole.mean(axis=0)
    wanted = np.linalg.svd(centred / [1e9, 1e4, 1e1], compute_uv=False)
    assert np.isclose(np.prod(model.e), np.prod((wanted * [1e9, 1e4, 1e1]) ** 2 / 400), rtol=1e-9) and model.error < 1e-9


def test_rotations_make_columns_orthogonal():
    rng = np.random.default_rng(3)
    for rows, dims in ((5, 5), (3, 7), (40, 12), (1, 1), (9, 2)):
        r = rng.normal(size=(rows, dims)) @ np.diag(10.0 ** -np.arange(dims))
        lengths, v = whitening.jacobi(np.linalg.qr(r, mode="r"))
        assert np.allclose(v.T @ v, np.eye(dims), atol=1e-13)
        k = min(rows, dims)
        assert np.allclose(lengths[:k], np.linalg.svd(r, compute_uv=False), rtol=1e-9, atol=1e-14) and np.allclose(lengths[k:], 0, atol=1e-12)


def test_whitening_of_hard_rows(spark):
    """Nulls, odd lengths, infinities, repeated rows, extra columns; a lone vector; huge entries; an empty table."""
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0]), (8, [1.0, 0.0]), (9, [0.5, 7.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "n", "part", "data", "component")})
    rows = whitening.whiten(df).collect()
    assert len(rows) == 2 * 7 and {r.vec_id for r in rows} == {1, None, 6, 7, 8, 9} and {r.n for r in rows} == {5}
    by = {(r.vec_id, r.component): r.whitened for r in rows}
    assert by[7, 1] == by[8, 1] and by[7, 2] == by[8, 2]
    lone = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert len(lone) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in lone)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], "vec_id int, embedding array<double>")).collect()
    assert len(huge) == 3 and {r.deviation for r in huge} <= {None, 1, 9} and max(abs(r.whitened) for r in huge) < 2
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id int, embedding array<double>")).collect() == []
    none = whitening.whiten(df.limit(0))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.collect() == []


# --- packing of several lengths -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def test_stretches_give_the_tokenizers_ids(tokenizer):
    ids, rng = multi_length.stretch_ids(WORD_BPE), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'S", "'s", "don", "12", "³", "É", "é", "́", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", " ", "!!", ".", "?,", "Don'T.", "中", "İ", "ΑΣ", "Σ", "🙂", "\x00", "\x0b", "\x85"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def check_multi(rows, texts, tokenizer, largest=4096, smallest=512, step_tokens=65_536):
    """Each id in one piece, places gapless, windows full; texts by doc_id (unique ids)."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    assert set(docs) == set(texts)
    encoded = {k: e.ids + [2] for k, e in zip(texts, tokenizer.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    for k, ids in encoded.items():
        at = 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids), (r, sorted(docs[k]), len((texts[k] or "").split()))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    tiers, steps = defaultdict(int), defaultdict(set)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.tier for r in pieces} == {at} and at & (at - 1) == 0 and at <= largest and len({r.step for r in pieces}) == 1
        tiers[at] += 1
        steps[pieces[0].step].add((pieces[0].sequence_id, at))
    assert all(tiers[t] <= 1 for t in tiers if t < smallest)
    sizes = defaultdict(list)
    for group in steps.values():
        assert len({t for _, t in group}) == 1
        sizes[min(group)[1]].append(sum(t for _, t in group))
    for t, found in sizes.items():
        assert max(found) <= max(step_tokens, t) and sum(x < step_tokens for x in found) <= 1
    return tiers


def test_windows_of_several_lengths(spark, data, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op12_multi_length_packing(spark, data).collect()
    check_multi(rows, texts, tokenizer)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_rests_of_many_tasks_meet(spark, tokenizer, parts, monkeypatch):
    rng = random.Random(parts)
    texts = {k: " ".join(rng.choices(["tree", "of", "windows", "rests", "packing"], k=rng.choice([0, 3, 20, 90, 300, 700]))) for k in range(240)} | {-1: None, -2: "", -3: "word " * 9000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(parts)
    rows = multi_length.pack_multi(df, WORD_BPE, 256, 32, 1024, fan_in=3).collect()
    tiers = check_multi(rows, texts, tokenizer, 256, 32, 1024)
    assert len([t for t in tiers if t >= 32]) >= 3
    # Few documents are cut that need not be, even of six in a task.
    assert len(rows) - sum(math.ceil(max(1, len(tokenizer.encode(t or "").ids) + 1) / 256) for t in texts.values()) < 0.5 * len(texts)


def test_multi_packing_of_hard_rows(spark, hard, empty, tokenizer):
    rows = multi_length.pack_multi(hard, WORD_BPE).collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 for n in lengths.values())
    assert sum(lengths.values()) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in hard.collect())
    assert multi_length.pack_multi(empty, WORD_BPE).collect() == []


def test_groups_are_alike_in_cost():
    rng = random.Random(1)
    windows = [(rng.randrange(1000, 9000), k) for k in range(103)]
    groups, left = multi_length.step_groups(windows, 10)
    cost = dict((n, c) for c, n in windows)
    sums = [sum(cost[n] for n in g) for g in groups]
    assert [len(g) for g in groups] == [10] * 10 and len(left) == 3 and max(sums) < 1.15 * min(sums)


# --- repair of conversations ----------------------------------------------------------------------


def brute_repair(rows):
    """Damage and repair of (conv_id, turn, role, text), by all edits of least cost."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: brute_one(turns) for conv, turns in found.items()}


def brute_one(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).hexdigest()))
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults = set(), []
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    # All ways, turn by turn: initials, cost, audit, lines; the cheapest of each (state, then audit) stays.
    ways = {"": (0, "", ())}
    legal = re.compile(r"(s?(ua)*u?)?")

    def best(options):
        out = {}
        for initials, way in options:
            if legal.fullmatch(initials):
                key = initials if initials in ("", "s") else "ua" if initials[-1] == "a" else "u"
                if key not in out or way[:2] < out[key][:2]:
                    out[key] = way
        return out

    def inserted(ways):
        for _ in range(3):
            ways = best([*ways.items(), *((k + i, (c + 5, a + "I", lines + (role + ":",))) for k, (c, a, lines) in ways.items() for i, role in (("u", "user"), ("a", "assistant")))])
        return ways

    for (_, role, text), fault in zip(turns, faults, strict=True):
        options = []
        for k, (c, a, lines) in inserted(ways).items():
            options.append((k, (c + 2, a + "D", lines)))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role:
                    options.append((k + role[0], (c + more, a + "K", lines + (f"{role}:{text}",))))
                options += [(k + r[0], (c + 1 + more, a + "R", lines + (f"{r}:{text}",))) for r in ("user", "assistant")]
        ways = best(options)
    cost, audit, lines = min((w for k, w in inserted(ways).items() if k in ("", "ua")), key=lambda w: w[:2])
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check_repair(got, rows):
    wanted = brute_repair(rows)
    assert len(got) == len(wanted)
    for r in got:
        assert tuple(r)[1:] == wanted[r.conv_id], r


def test_repair_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows
    check_repair(queries.op13_conversation_repair(spark, data).collect(), rows)


def invented(rng, conv, turns):
    texts = ["Yes.", "No", "What?", "", " \t", "Well, well!", "Ünï。", None, "Why not. "]
    return [(conv, t if rng.random() > 0.03 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]), rng.choice(texts)) for t in range(turns)]


@pytest.mark.parametrize("limits", [(512, 1 << 16, 512, 1 << 14), (4, 100, 3, 40), (1, 10, 1, 10)])
def test_long_conversations_equal_brute_force(spark, monkeypatch, limits):
    """Short limits send most conversations through leaves and trees."""
    for name, value in zip(("TURNS", "BYTES", "LEAF_TURNS", "LEAF_BYTES"), limits, strict=True):
        monkeypatch.setattr(repair, name, value)
    rng = random.Random(sum(limits))
    rows = [r for conv in [*range(25), None] for r in invented(rng, conv, rng.choice([1, 2, 3, 5, 8, 13, 90]))]
    rows += [(99, 5, "user", "Again and again.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("key", "kind", "part", "mark", "at")})
    check_repair(repair.repair_damaged(df.repartition(5)).collect(), rows)


def test_a_hot_conversation(spark):
    """One conversation of nearly all turns goes by many leaves."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"Turn {t}.", "Well!"])) for t in range(6000)] + [(8, 0, "user", "x" * 200_000), (8, 1, "assistant", "y" * 100_000 + ".")]
    check_repair(repair.repair_damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), rows)


def test_products_are_associative():
    rng = random.Random(5)
    for _ in range(200):
        a, b, c = (repair.turn_matrix(rng.choice([b"s", b"u", b"a", b"x"]), rng.random() < 0.3, rng.random() < 0.3) for _ in range(3))
        assert repair.times(repair.times(a, b), c) == repair.times(a, repair.times(b, c))


def test_conversations_without_rows(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, t, "user", "Hello.") for c, t in gone], "conv_id int, turn int, role string, text string")
    for r in repair.repair_damaged(df).collect():
        assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_damaged(df.limit(0)).collect() == []
    alone = repair.repair_damaged(spark.createDataFrame([(None, None, None, None)], "conv_id string, turn long, role string, text string")).collect()
    assert len(alone) == 1 and (alone[0].gaps, alone[0].blank, alone[0].audit) in ((0, 1, "D"), (0, 0, ""), (0, 2, "DD"))


def test_plain_text_is_not_put_to_the_whole_tokenizer(tokenizer):
    """Only the model is asked, once for each pre-token; normalizing and cutting cost more than it does."""

    class Whole:
        def encode(self, text, add_special_tokens):
            raise AssertionError(text)

    ids = multi_length.Stretches(WORD_BPE)
    ids.tokenizer = Whole()
    for text in ("", "The.\nthe, THE***%%% x86 2024", "Ésta ñandú\n\n  straße ÞÅ$$$ (a-b_c) [d]", "zqxj" * 16 + "~"):
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
