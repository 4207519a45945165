from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.operators import retrieval
from quillsift.plans import queries, search

HIT = "query_id string, chunk_id string, document_id string, score double, rank int"


def hits(spark, rows):
    return spark.createDataFrame([("q", c, d, float(s), k + 1) for k, (c, d, s) in enumerate(rows)], HIT)


def fused(spark, lists):
    return {r.chunk_id: r for r in retrieval.fuse(lists).collect()}


def test_one_list(spark):
    got = fused(spark, [(hits(spark, [("a", "d", 9), ("b", "d", 1)]), 1.0)])
    assert got["a"].score == pytest.approx(1 / 61) and got["b"].score == pytest.approx(1 / 62)


def test_both_lists_win(spark):
    got = fused(spark, [(hits(spark, [("a", "d", 1), ("x", "d", 1)]), 0.6), (hits(spark, [("b", "d", 1), ("x", "d", 5)]), 0.4)])
    assert len(got) == 3 and got["x"].rank == 1 and got["x"].best_score == 5


@pytest.mark.parametrize(("weights", "winner"), [((3.0, 1.0), "a"), ((1.0, 3.0), "b")])
def test_weights_flip(spark, weights, winner):
    one, two = hits(spark, [("a", "d", 1)]), hits(spark, [("b", "d", 1)])
    assert fused(spark, list(zip((one, two), weights, strict=True)))[winner].rank == 1


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("a", "A", 5), ("b", "A", 3)], [("A", 8.0)]),
        ([(f"c{k}", "A", 1) for k in range(10)], [("A", 3.0)]),
        ([("a", "A", 2), ("b", "B", 10), ("c", "B", 8)], [("B", 18.0), ("A", 2.0)]),
    ],
)
def test_grouping(spark, rows, expected):
    got = retrieval.group_by_document(hits(spark, rows), spans=3).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in got] == expected
    assert all([s.score for s in r.spans] == sorted((s.score for s in r.spans), reverse=True) for r in got)


def test_rerank(spark):
    h = hits(spark, [("a", "d", 9), ("b", "d", 5), ("c", "d", 1)])
    assert [(r.chunk_id, r.score) for r in retrieval.keep_order(h, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.5)]
    scores = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9), ("q", "c", 0.5)], "query_id string, chunk_id string, model_score double")
    assert [r.chunk_id for r in retrieval.rerank(h, scores, 2).orderBy("rank").collect()] == ["b", "c"]
    broken = scores.filter("chunk_id != 'b'")
    assert [(r.chunk_id, r.score) for r in retrieval.rerank(h, broken, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.5)]


def test_dense_is_scoped_to_the_tenant(spark):
    chunks = spark.createDataFrame([(1, "t", 1, [1.0, 0.0]), (2, "t", 2, [0.0, 0.0]), (3, "other", 3, [1.0, 0.0])], "chunk_id int, tenant_id string, document_id int, embedding array<float>")
    q = spark.createDataFrame([("q", "t", [2.0, 0.0])], "query_id string, tenant_id string, embedding array<float>")
    got = {r.chunk_id: r.score for r in retrieval.dense_top(q, chunks, 5).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}


def test_lexical_needs_all_terms(spark):
    """One term: a tenth for each place.  Two: covers "red car" of the first text; "car, red" and "red ... car" of the third, with a word between."""
    chunks = spark.createDataFrame([(1, "t", 1, "red red car"), (2, "t", 2, "red"), (3, "t", 3, "Car, RED! a car")], "chunk_id int, tenant_id string, document_id int, content string")
    q = spark.createDataFrame([("q", "t", "red car"), ("r", "t", "red")], "query_id string, tenant_id string, query string")
    got = [(r.query_id, r.chunk_id, r.score) for r in retrieval.lexical_top(q, retrieval.postings(chunks), 5).orderBy("query_id", "rank").collect()]
    assert got == [("q", 3, 0.15), ("q", 1, 0.1), ("r", 1, 0.2), ("r", 2, 0.1), ("r", 3, 0.1)]


def test_cover_density_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = rng.integers(0, 5, rng.integers(1, 14)).tolist()
        n = int(rng.integers(1, 4))
        places = [[k for k, w in enumerate(words) if w == t] for t in range(n)]
        spans = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(range(n)) <= set(words[i : j + 1])]
        shortest = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
        expected = sum(0.1 / (1 + sum(w >= n for w in words[i : j + 1])) for i, j in shortest)
        assert retrieval.cover_density(places) == pytest.approx(expected)


def test_pages(spark):
    pages = "array(named_struct('page', 1, 'start_char', 0), named_struct('page', 2, 'start_char', 10))"
    row = spark.sql(f"select {pages} p, array(named_struct('page', 1, 'start_char', 5)) late")
    got = row.select(*[retrieval.page_at(F.lit(x), F.col("p")) for x in (0, 9, 10, 99)], retrieval.page_at(F.lit(2), F.col("late"))).first()
    assert list(got) == [1, 1, 2, 2, 0]


def test_search_modes(spark):
    chunks = spark.createDataFrame(
        [(k, "t", k % 3, f"word{k} common", [float(k), 1.0], False, "skills" if k % 2 else "other") for k in range(12)],
        "chunk_id int, tenant_id string, document_id int, content string, embedding array<float>, is_parent boolean, section string",
    )
    q = spark.createDataFrame([("q", "t", "common", [5.0, 1.0])], "query_id string, tenant_id string, query string, embedding array<float>")
    for mode in ("hybrid", "semantic", "lexical"):
        got = search.candidates(q, chunks, mode).orderBy("rank").collect()
        assert len(got) == 3 and sum(r.score for r in got) == pytest.approx(sum(1 / k for k in range(1, 11)))
    assert all(s.chunk_id % 2 for r in search.candidates(q, chunks, sections=["skills"]).collect() for s in r.spans)
    with pytest.raises(ValueError):
        search.candidates(q, chunks, "other")


def test_similar_documents_asks_for_each_twentieth_id(spark, data, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.search, "similar", lambda sources, chunks: asked.append(sources) or spark.createDataFrame([], "query_id long, document_id long, score double, rank int"))
    queries.similar_documents(spark, data)
    ids = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.document_id for r in asked[0].collect()) == sorted(k for k in ids if k % 20 == 0)


def test_hybrid_takes_whole_texts_and_all_vectors(spark, data):
    asked, chunks = queries._hybrid(spark, data)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert {r.query_id: r["query"] for r in asked.collect()} == texts
    docs, vectors = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("documents", "embeddings"))
    assert chunks.count() == docs and chunks.select("_v").distinct().count() == min(docs, vectors)


def test_dense_top_in_blocks(spark, monkeypatch):
    """Many blocks of one tenant, ties, zero vectors, other widths and nulls."""
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(90)] + [[0.0] * 4, [1.0, 2.0], None]
    chunks = spark.createDataFrame([(k, "t" if k % 5 else "u", k % 9, v) for k, v in enumerate(vectors)], "chunk_id int, tenant_id string, document_id int, embedding array<double>")
    asked = {f"q{k}": ("t" if k % 3 else "u", vectors[k]) for k in range(10)}
    q = spark.createDataFrame([(k, t, v) for k, (t, v) in asked.items()], "query_id string, tenant_id string, embedding array<double>")
    got = {}
    for r in retrieval.dense_top(q, chunks, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, round(r.score, 9))

    def cosine(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9) + 0.0

    for k, (tenant, v) in asked.items():
        best = sorted(((-cosine(v, w), c) for c, w in enumerate(vectors) if w is not None and (tenant == "t") == bool(c % 5)))[:6]
        assert got[k] == {n + 1: (c, -s + 0.0) for n, (s, c) in enumerate(best)}


def test_rerank_port_keeps_order_on_errors(spark):
    h = hits(spark, [("a", "d", 9), ("b", "d", 5), ("c", "d", 1)])
    q = spark.createDataFrame([("q", "find")], "query_id string, query string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "yyy"), ("c", "yy")], "chunk_id string, content string")
    run = lambda f: [(r.chunk_id, r.score, r.degraded) for r in retrieval.rerank_with(h, q, chunks, f, 2).orderBy("rank").collect()]
    assert run(lambda _, texts: [len(t) for t in texts]) == [("b", 3.0, False), ("c", 2.0, False)]
    kept = [("a", 1.0, True), ("b", 0.5, True)]
    assert run(lambda _, texts: [1.0]) == kept and run(lambda _, texts: 1 / 0) == kept


def test_balls_skip_blocks_and_lose_nothing(spark, monkeypatch):
    """Clusters: most blocks are skipped, and the hits are those of all pairs; so are those of vectors without clusters, ties and zeros."""
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 16)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 12)) * 4
    vectors = [(centres[k % 25] + rng.normal(size=12) * 0.1).round(3).tolist() for k in range(2000)]
    vectors += [vectors[3]] * 70 + [[0.0] * 12] * 5 + [[1.0, 2.0]]
    chunks = spark.createDataFrame([(k, "t" if k % 11 else "u", k % 9, v) for k, v in enumerate(vectors)], "chunk_id int, tenant_id string, document_id int, embedding array<double>")
    asked = {k: ("t" if k % 3 else "u", vectors[k]) for k in [*range(0, 2000, 50), 3, 2072]}
    q = spark.createDataFrame([(k, t, v) for k, (t, v) in asked.items()], "query_id int, tenant_id string, embedding array<double>")
    hits, reads = retrieval.dense_search(q, chunks, 7)
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, round(r.score, 9))

    def cosine(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12) + 0.0

    for k, (tenant, v) in asked.items():
        best = sorted(((-cosine(v, w), c) for c, w in enumerate(vectors) if (tenant == "t") == bool(c % 11)))[:7]
        assert got[k] == {n + 1: (c, round(-s, 9) + 0.0) for n, (s, c) in enumerate(best)}
    counts = {r.query_id: r for r in reads.collect()}
    assert set(counts) == set(asked) and all(0 < r.read <= r.blocks for r in counts.values())
    ordinary = [r for k, r in counts.items() if k < 2000 and asked[k][0] == "t"]
    assert sum(r.read for r in ordinary) < 0.4 * sum(r.blocks for r in ordinary)


def test_nearest_equals_all_products_in_double_precision():
    """Many chunks, copies among them, differences below single precision, and scores to reach."""
    rng = np.random.default_rng(9)
    chunks = retrieval.unit_rows(rng.normal(size=(3000, 8)))
    chunks[1000:1200] = chunks[5]
    chunks[2000:2100] = retrieval.unit_rows(chunks[7] + rng.normal(size=(100, 8)) * 1e-9)
    queries = np.concatenate([chunks[[5, 7]], retrieval.unit_rows(rng.normal(size=(20, 8)))])
    reached = np.where(np.arange(22) % 4 == 3, 0.9, -2.0)
    for k in (3, 40):
        for query, least, (at, scores) in zip(queries, reached, retrieval.nearest(queries, chunks, reached, k), strict=True):
            every = np.round((chunks * query).sum(axis=1), 12)
            best = [j for j in np.argsort(-every, kind="stable")[:k] if every[j] >= least]
            assert at[: len(best)].tolist() == best and scores[: len(best)].tolist() == every[best].tolist()


def test_a_block_meets_queries_in_groups(spark, monkeypatch):
    """A task's Python gets one block and a group of its queries, so what it holds doesn't grow with the pairs of blocks."""
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(k, "t", k % 9, rng.normal(size=4).tolist()) for k in range(300)], "chunk_id int, tenant_id string, document_id int, embedding array<double>")
    q = chunks.filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", "embedding")
    expected = sorted(retrieval.dense_top(q, chunks, 5).collect())
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 40)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 16)
    monkeypatch.setattr(retrieval, "GROUP_QUERIES", 30)
    own = retrieval.nearest

    def counted(queries, rows, reached, k):
        assert len(queries) <= 60 and len(rows) <= 120
        return own(queries, rows, reached, k)

    monkeypatch.setattr(retrieval, "nearest", counted)
    assert sorted(retrieval.dense_top(q, chunks, 5).collect()) == expected
