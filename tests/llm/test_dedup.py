from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsift.llm import components, exact_dedup, extendible, line_dedup, mixing, near_copies, packing, quality_classifier, sharding, simhash_trie, token_counts
from quillsift.llm.queries import BYTE_BPE
from tests.llm.conftest import HARD
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_print(text, size):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, near):
    """{item: smallest item reachable} by comparing all pairs."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))] for _ in range(40)]
    rows = []
    for k in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"W{rng.randrange(300)}"
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r for r in simhash_trie.group_near(docs, words=3, budget=3).collect()}
    prints = {k: brute_print(t, 3) for k, t in rows}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    expected = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {k: r.component_id for k, r in got.items()} == expected
    assert len(set(expected.values())) < 240


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_join_finds_all_links(budget):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for _ in range(400)], np.uint64)
    prints = np.unique(np.concatenate((base, base[rng.integers(0, 60, 400)] ^ noise, np.array([0, 2**64 - 1, 1], np.uint64))))
    trie = simhash_trie.Trie(prints)
    found = {(min(i, j), max(i, j)) for x, y in simhash_trie.join_tries(trie, trie, budget, True) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    wanted = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= budget}
    assert found == wanted and (budget == 0 or wanted)
    a, b = simhash_trie.Trie(prints[::2]), simhash_trie.Trie(prints[1::2])
    found = {(i, j) for x, y in simhash_trie.join_tries(a, b, budget, False) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i in range(len(a.prints)) for j in range(len(b.prints)) if int(a.prints[i] ^ b.prints[j]).bit_count() <= budget}


def test_trie_join_splits_large_frontiers(monkeypatch):
    monkeypatch.setattr(simhash_trie, "FRONTIER", 8)
    test_trie_join_finds_all_links(3)


def test_large_group_gives_few_links(spark):
    prints = spark.range(64).select(F.expr(f"{7 << 40}L ^ shiftleft(1L, cast(id as int))").alias("print"))
    n = prints.count()
    out = components.connected(simhash_trie.links(prints, 3))
    assert out.select("root").distinct().count() == 1 and out.count() == n
    assert simhash_trie.links(prints, 3).count() < 40 * n


def test_heavy_subtrees_are_split(spark, monkeypatch):
    """Fingerprints that share a long beginning are split bit by bit, and no link is lost."""
    monkeypatch.setattr(simhash_trie, "SUBTREE", 8)
    monkeypatch.setattr(simhash_trie, "FEW", 20)
    monkeypatch.setattr(components, "FEW", 20)
    rng = np.random.default_rng(2)
    low = rng.integers(0, 1 << 14, 300)
    prints = sorted({int(x) for x in np.concatenate((low | (5 << 50), low[:60] | (7 << 50), rng.integers(-(1 << 62), 1 << 62, 200)))})
    table = spark.createDataFrame([(x,) for x in prints], "print bigint")
    dealt = simhash_trie.dealt(table, 3)
    sizes = dealt.filter("own").groupBy("depth", "task").count().collect()
    assert sum(r["count"] for r in sizes) == len(prints) and len({r.depth for r in sizes}) > 2
    assert max(r["count"] for r in sizes) <= 16
    got = {r.node: r.root for r in components.connected(simhash_trie.links(table, 3)).collect()}
    wanted = brute_components(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    groups = lambda of: sorted(sorted(x for x in prints if of.get(x, x) == r) for r in {of.get(x, x) for x in prints})
    assert groups(got) == groups(wanted)


def test_neighbours_meet_in_several_tasks(spark, monkeypatch):
    """All pairs within the budget, though a task gets two neighbouring subtrees only."""
    monkeypatch.setattr(simhash_trie, "NEIGHBOURS", 2)
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63 - 1, 40).tolist()
    prints = sorted({x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for x in base for _ in range(5)})
    found = {(r.u, r.v) for r in simhash_trie.links(spark.createDataFrame([(x,) for x in prints], "print bigint"), 3).collect()}
    near = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 3
    joined = brute_components(prints, lambda x, y: (x, y) in found or (y, x) in found)
    assert joined == brute_components(prints, near) and len(set(joined.values())) < len(prints)


def test_trie_join_holds_no_levels(monkeypatch):
    """What a traversal holds doesn't grow with the tries: a subtree with twenty neighbours of its size."""
    monkeypatch.setattr(simhash_trie, "FRONTIER", 1 << 12)
    rng, peaks = np.random.default_rng(3), []
    flips = np.array(simhash_trie.near_paths(6, 3)[1:21], np.uint64)
    for n in (2000, 8000):
        own = np.unique(rng.integers(0, 2**58, n, dtype=np.uint64))
        # Near copies keep some nodes from ending high up.
        near = own[: n // 4] ^ (np.uint64(1) << rng.integers(0, 58, n // 4).astype(np.uint64))
        a = simhash_trie.Trie(np.unique(np.concatenate((own, near))))
        b = simhash_trie.Trie(np.unique(np.concatenate([rng.integers(0, 2**58, n, dtype=np.uint64) | (f << np.uint64(58)) for f in flips])))
        tracemalloc.start()
        found = sum(len(i) for i, _ in simhash_trie.join_tries(a, a, 3, True)) + sum(len(i) for i, _ in simhash_trie.join_tries(a, b, 3, False))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found >= len(near)
    assert max(peaks) < 12e6 and peaks[1] < 2 * peaks[0]


def test_near_groups_keep_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "some words here"), ("a", "some  words here"), (None, "")], "name string, body string")
    got = {r.doc_id: r.component_id for r in simhash_trie.group_near(docs, 3, 3, "name", "body").collect()}
    assert got == {"a": "a", "b": "a", None: None}


def test_components(spark):
    rng = random.Random(1)
    for pairs in ([(k, k + 1) for k in range(200)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(0, k) for k in range(1, 100)], [(5, 5)], []):
        df = spark.createDataFrame(pairs, "u long, v long")
        got = {r.node: r.root for r in components.connected(df).collect()}
        nodes = {x for p in pairs if p[0] != p[1] for x in p}
        links = {frozenset(p) for p in pairs}
        assert got == brute_components(sorted(nodes), lambda a, b: frozenset((a, b)) in links)


@pytest.mark.parametrize("few", [50, 200_000])
def test_few_links_need_no_rounds(spark, monkeypatch, few):
    """Up to FEW links cost a few stages; over it there are rounds until so few are left; both give the same."""
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(90), 100 + rng.randrange(90)) for _ in range(70)]
    context, before = spark.sparkContext, len(spark.sparkContext.statusTracker().getJobIdsForGroup("links"))
    context.setJobGroup("links", "components")
    try:
        got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("links")) - before
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    links = {frozenset(p) for p in pairs}
    assert got == brute_components(sorted({x for p in pairs if p[0] != p[1] for x in p}), lambda a, b: frozenset((a, b)) in links)
    assert few < len(links) or jobs <= 12


def test_workers_remember_for_one_operator():
    """A worker that has tokenized and then judges texts holds the judge's words only."""
    ids = packing.token_ids(BYTE_BPE)
    ids("some words to remember")
    assert len(ids) and ids is packing.token_ids(BYTE_BPE) and len(ids)
    quality_classifier.remember_words()
    quality_classifier.word_buckets(b"other words")
    assert not ids and quality_classifier._buckets
    packing.token_ids(BYTE_BPE)
    assert not quality_classifier._buckets


def test_simhash_hard_rows(hard, empty):
    got = simhash_trie.group_near(hard, 3, 3).collect()
    assert len(got) == len(HARD) and {r.component_id for r in got if int(r.fingerprint, 16) == 0} == {2}
    assert {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
    assert simhash_trie.group_near(empty).count() == 0


def test_near_copies(spark, hard, empty):
    """Copies at 0.85 and over go, texts without a partner at 0.6 stay."""
    rng = random.Random(11)
    rows, base = [], []
    for k in range(160):
        if k % 4 == 0:
            base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(120, 300))]
            words = base
        else:
            words = list(base)
            for _ in range(k % 4 if k % 8 < 4 else 40):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
        rows.append((k, " ".join(words)))
    shingles = {k: set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for k, t in rows}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    root = {r.doc_id: r.root for r in got}
    pairs = [(a, b) for a in root for b in root if a < b]
    close = [p for p in pairs if like(*p) >= 0.85]
    assert len(close) > 40 and sum(root[a] == root[b] for a, b in close) >= 0.97 * len(close)
    assert all(root[a] != root[b] for a, b in pairs if a // 4 != b // 4)
    assert all(root[a] != root[b] for a, b in pairs if max((like(a, c) for c in root if c != a), default=0) < 0.6)
    kept = near_copies.keep_one(hard)
    assert kept.columns == hard.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7]
    assert near_copies.keep_one(empty).count() == 0


def altered(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"y{rng.randrange(10**6)}"
    return out


def exact_groups(rows):
    sets = {k: set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for k, t in rows}
    return brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("group", [512, 8])
def test_near_copies_are_linked_by_exact_similarity(spark, monkeypatch, group):
    """Texts at 0.65 to 0.8 stay apart although their sketches are near; copies at 0.8 and over go, in groups of many blocks too."""
    monkeypatch.setattr(near_copies, "GROUP", group)
    rng, texts = random.Random(12), []
    for _ in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts += [base, altered(rng, base, rng.choice([6, 7, 8]))]
    star = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts += [star, *(altered(rng, star, 4) for _ in range(40)), *(altered(rng, star, 7) for _ in range(20))]
    chain = [f"w{rng.randrange(4000)}" for _ in range(200)]
    for _ in range(30):
        chain = altered(rng, chain, 3)
        texts.append(chain)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    root = {r.doc_id: r.root for r in near_copies.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    expected = exact_groups(rows)
    smallest = {}
    for k in sorted(root):
        smallest.setdefault(root[k], k)
    assert {k: smallest[r] for k, r in root.items()} == expected
    assert 50 < len(set(expected.values())) < len(rows) - 50


def test_repeated_rows_are_compared_once(spark):
    """Rows that repeat id and text are one text to compare; a very frequent text meets its root by broadcast."""
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])
    rows = [(1, text)] * 3000 + [(None, text)] * 200 + [(2, near), (3, other), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    source = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    assert near_copies.each_once(source, source.select("doc_id", "hash")).count() == 6
    got = near_copies.groups(docs).collect()
    assert len(got) == len(rows)
    roots = {k: {r.root for r in got if r.doc_id == k} for k in (None, 1, 2, 3, 4, 5)}
    assert all(len(x) == 1 for x in roots.values())
    assert roots[None] == roots[1] == roots[2] != roots[3] and roots[4] == roots[5] != roots[1]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 3, 4]


def test_near_copies_check_all_pairs_in_blocks(monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    starts, counts = np.array([0, 3, 4]), np.array([3, 1, 5])
    blocks = list(near_copies._pairs_of([(np.array([0, 2]), np.array([2, 1]))], starts, counts))
    found = [(i, j) for x, y in blocks for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert sorted(found) == sorted([(i, j) for i in range(3) for j in range(4, 9)] + [(i, 3) for i in range(4, 9)])


def test_plan_grows_with_the_corpus():
    bits = [near_copies.plan(n, 0.8)[0] for n in (10, 10**5, 10**8)]
    assert bits == sorted(bits) and near_copies.plan(10**5, 0.9)[2] < near_copies.plan(10**5, 0.8)[2]


def test_exact_dedup(hard, empty):
    got = exact_dedup.dedup(hard, capacity=2).collect()
    assert len(got) == len(HARD)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    plain = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in plain} == {1} and sorted(str(r.doc_id) for r in plain if r.kept) == ["1", "1"]
    assert {r.keep_id for r in got if r.doc_id in (2, 3)} == {2} and {r.kept for r in got if r.doc_id == 5} == {False}
    assert len(by) == len(HARD) - 1 and exact_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("digest_bits", [4, 8, 256])
def test_exact_dedup_equals_brute_force(spark, digest_bits):
    """With few bits of the digest, many different texts collide; chains keep them apart."""
    rng = random.Random(6)
    texts = ["hot text"] * 260 + [rng.choice(["a", "b  c", "b c", " b\tc", "", None, f"x{rng.randrange(60)}"]) for _ in range(240)]
    rows = [(None if k % 50 == 7 else k // 2, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), capacity=5, digest_bits=digest_bits)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    expected = []
    for k, t in rows:
        group = groups[norm(t)]
        keep = min((x for x in group if x is not None), default=None)
        expected.append((k, keep, len(group), k == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    order = lambda x: tuple((v is None, v or 0) if i < 2 else (False, v) for i, v in enumerate(x))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected, key=order)


def test_index_pages(spark):
    """Buckets are within the limit and whole in one file, pages are in order of the keys."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3500).alias("text")).repartition(6)
    # Small shuffles would become one task, so one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = exact_dedup.index(docs, capacity=300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.pages.count() == 4000 and found.linked is None
    pages = found.pages.withColumn("file", F.input_file_name())
    buckets = pages.groupBy("start").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.countDistinct("owner").alias("owners")).collect()
    assert len(buckets) > 13 and all(r.n <= 300 and r.files == 1 and r.owners == 1 for r in buckets)
    assert pages.select("file").distinct().count() > 1
    assert {r.group_size for r in found.pages.collect()} == {1, 2}
    for file in found.pages.inputFiles():
        bits = [r.bits for r in spark.read.parquet(file).collect()]
        assert bits == sorted(bits)


def test_hot_digests_have_several_owners(spark):
    """A text with more rows than a bucket may have is dealt out; chains of its parts are merged."""
    docs = spark.range(900).select((900 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("hot")).alias("text"))
    found = exact_dedup.index(docs.repartition(5), capacity=50)
    hot = found.pages.filter("group_size = 600")
    parts = hot.groupBy("part").count().collect()
    assert len(parts) == 12 and max(r["count"] for r in parts) < 100 and {r.keep_id for r in hot.collect()} == {1}
    assert found.pages.filter("group_size = 1").count() == 300 and found.pages.count() == 900


def test_white_space_is_one_space(spark):
    df = spark.createDataFrame([(2, "a b"), (1, "a \n\tb"), (3, "a  b "), (4, "a\x0bb"), (5, "a b")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(df).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 4: (1, 3), 3: (3, 1), 5: (5, 1)}


def brute_lines(rows):
    """Rows (id, text) without the lines of repeated windows, one window after another."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines = (text or "").split("\n")
        bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(bare[k : k + 3])
            if not any(window):
                continue
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[key] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, sorted(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice(["a", "b", " a", "", "c d", f"x{rng.randrange(40)}"]) for _ in range(rng.randrange(12)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs).collect()}
    expected = brute_lines(rows)
    assert got == expected and sum(bool(x[1]) for x in expected.values()) > 30


def test_very_long_texts_and_common_windows(spark):
    """Time grows with the length of a text, and windows that all documents share meet their first occurrence by broadcast."""
    lines = [f"line {k} number {k % 97}" for k in range(80_000)]
    rows = [(k, "\n".join(lines)) for k in (1, 2)] + [(k, "x\na\nb\nc\n" + f"own {k}") for k in range(3, 400)] + [(500, "a\nb\nc\nd"), (501, "b\nc\nd")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    began = time.monotonic()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert time.monotonic() - began < 60
    assert got[1] == rows[0][1] and got[2] == "" and got[3] == rows[2][1]
    assert all(got[k] == f"own {k}" for k in range(4, 400)) and got[500] == "d" and got[501] == ""


def test_columns_of_any_name_pass_through(spark):
    names = ["_key", "_removed", "_id", "_hash", "_text_hash", "_here", "_sketch", "_source", "_size", "_copies", "_copy", "_rows", "_none", "none", "name", "no_id", "id", "unit", "_counts", "_units"]
    rows = [(1, "a b\nc\nd", "s"), (2, "a b\nc\nd", "s"), (3, "e", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for operator in (near_copies.keep_one, mixing.apply_mix, lambda d: token_counts.count_tokens(d, BYTE_BPE).drop("n_words", "n_tokens"), lambda d: line_dedup.dedup_lines(d).drop("removed_lines")):
        out = operator(docs)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_long_passages_of_one_or_two_lines(spark):
    long, half = " ".join(f"w{k}" for k in range(60)), [" ".join(f"{c}{k}" for k in range(30)) for c in "ab"]
    rows = [(1, f"x\n{long}\ny"), (2, long), (3, f"p\n {long} \nq\nr"), (4, "\n".join(half)), (5, "\n".join(["s", *half])), (6, half[0]), (7, "short\nlines"), (8, "short\nlines"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs, passage=50).collect()}
    gone = {2: ("", [0]), 3: ("p\nq\nr", [1]), 5: ("s", [1, 2])}
    assert got == {k: gone.get(k, (t, [])) for k, t in rows}


def test_line_dedup_hard_rows(hard, empty):
    out = line_dedup.dedup_lines(hard)
    assert out.columns == [*hard.columns, "removed_lines"] and out.count() == len(HARD)
    got = {(r.doc_id, r.source): r for r in out.collect()}
    # Null ids come first, so the copy without an id stays whole.
    assert got[None, "b"].removed_lines == [] and got[8, None].text == "" and got[2, None].text is None
    assert [r.text for r in out.filter("doc_id = 1").collect()] == ["", ""] and got[5, "b"].text == ""
    assert line_dedup.dedup_lines(empty).count() == 0


def test_shards_fit(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, "x" * rng.randrange(200)) for k in range(800)] + [(9999, "y" * 5000)], "doc_id bigint, text string")
    got = sharding.shard(docs, 2000)
    sizes = got.groupBy("shard", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert len(sizes) > 40 and all(r.b <= 2000 or r.n == 1 for r in sizes)
    names = {r.shard for r in sizes}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    # Only oversized buckets are split: a shard's parent is over the limit.
    rows = got.collect()
    for name in names:
        assert sum(r.n_bytes for r in rows if r.shard.startswith(name[:-1])) > 2000


def test_shards_equal_their_sql_where_they_split(spark, data):
    same(spark, data, lambda s, d: sharding.shard(s.read.parquet(f"{d}/documents.parquet"), 20_000), sharding.oracle(20_000))


def test_repeated_ids_go_to_pages(spark):
    docs = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("z" * 100).alias("text")).repartition(6)
    sizes = sharding.shard(docs, 1000).groupBy("shard", "page").agg(F.sum("n_bytes").alias("b")).collect()
    assert len(sizes) == 30 and all(r.b == 1000 for r in sizes)


def test_sharding_hard_rows(hard, empty):
    assert sharding.shard(hard, 50).count() == len(HARD) and sharding.shard(empty, 50).count() == 0
    assert {r.shard for r in sharding.shard(hard, 1 << 30).collect()} == {""}


def test_directory_doubles_only_where_needed(spark):
    rows = [(k, 1) for k in range(40)] + [((1 << 31) + (k << 20), 1) for k in range(8)]
    entries = spark.createDataFrame(rows, "bits bigint, w int")
    directory = extendible.build(entries, 10, "w")
    got = directory.route(entries).groupBy("depth", "prefix").count().collect()
    assert sum(r["count"] for r in got) == 48 and all(r["count"] <= 10 for r in got) and len(directory.tiers) > 1
    assert {(r.depth, r["count"]) for r in got if r.prefix == 1 and r.depth == 1} == {(1, 8)}
