"""Retrieval: vector and lexical top-k, fusion of ranked lists, reranking, grouping.

Everything is for sets of queries.  Ranked lists are tables with ``query_id,
chunk_id, score`` and an explicit ``rank`` from 1; ties go by chunk id.  Ranks
are taken on ids and scores; texts are joined to what is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from quillsift.functions.text import strip
from quillsift.session import frozen

RRF_K = 60
SPANS = 5
#: Parts that a term's postings are dealt to when queries meet them.
PARTS = 16
#: Vectors of a block of queries and of chunks; a large tenant's chunk blocks are larger, so that there are BLOCKS, up to so many values.
QUERY_ROWS = 256
CHUNK_ROWS = 4096
BLOCKS = 64
CHUNK_VALUES = 1 << 22
#: Queries that meet a chunk block in one group.
GROUP_QUERIES = 16_384
#: Pivots that tasks and the driver hold at most, over all tenants.
PIVOTS = 4096
#: Small tables are broadcast up to so many rows.
FEW = 100_000
#: The ball of vectors without a direction (zeros), the largest distance of unit vectors, and what roundings may take.
NO_DIRECTION, DIAMETER, SLACK = -1, 2.0, 1e-6


def ranked(hits: DataFrame, most: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("chunk_id"))
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def searchable(chunks: DataFrame) -> DataFrame:
    """Child chunks that have a vector."""
    return chunks.filter(F.col("embedding").isNotNull() & ~F.col("is_parent"))


def children(chunks: DataFrame) -> DataFrame:
    """Chunks that have a parent."""
    return chunks.filter(F.col("parent_chunk_id").isNotNull())


@dataclass(frozen=True)
class Pivots:
    """Unit vectors around which the vectors of large tenants are dealt, by (tenant, width); PIVOTS at most, so tasks hold them all."""

    of: dict[tuple[object, int], np.ndarray]

    def nearest(self, tenant: object, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball of each vector (NO_DIRECTION of zeros) and its distance from the ball's pivot; DIAMETER where there are no pivots."""
        unit, there = unit_rows(rows), rows.any(axis=1)
        pivots = self.of.get((tenant, rows.shape[1]))
        if pivots is None:
            return np.where(there, 0, NO_DIRECTION), np.full(len(rows), DIAMETER)
        near = unit @ pivots.T
        ball = near.argmax(axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(rows)), ball]))
        return np.where(there, ball, NO_DIRECTION), np.where(there, far, 0.0)

    def bounds(self, tenant: object, query: np.ndarray, blocks: list) -> np.ndarray:
        """For a query, what no cosine in each of the blocks (cn, ball, radius) exceeds.

        Vectors of a ball are within its radius of the pivot, so none is
        nearer to the query than the pivot's distance less the radius.
        """
        out = np.zeros(len(blocks))
        if not query.any():
            return out
        own = np.array([b["cn"] == len(query) and b["ball"] != NO_DIRECTION for b in blocks], dtype=bool)
        pivots = self.of.get((tenant, len(query)))
        if pivots is None:
            return own.astype(float)
        reach = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ unit_rows(query[None])[0])))
        ball, radius = np.array([b["ball"] for b in blocks]), np.array([b["radius"] for b in blocks])
        gap = np.maximum(0, reach[np.maximum(ball, 0)] - radius - SLACK)
        return np.where(own, 1 - gap**2 / 2, 0.0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def matrix(rows: Iterable) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in rows])


def block_rows(total: Column, rows: int) -> Column:
    """Vectors of a chunk block of a tenant with ``total`` vectors of the width ``n``."""
    return F.greatest(F.lit(rows), F.least(F.ceil(total / BLOCKS), F.ceil(F.lit(CHUNK_VALUES) / F.greatest("n", F.lit(1)))))


def flat_matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def pivots_of(vectors: DataFrame, rows: int, key: str) -> Pivots:
    """Pivots for tenants with more than ``rows`` vectors of a width, in proportion to their number: those with the smallest hashes.

    PIVOTS tenants and as many pivots come to the driver at most; other
    tenants have none, and their vectors are dealt by hash alone.
    """
    sizes = vectors.groupBy("tenant_id", "n").agg(F.count("*").alias("_c")).filter(F.col("_c") > rows).orderBy(F.col("_c").desc(), "tenant_id", "n").limit(PIVOTS)
    large = [(r["tenant_id"], r["n"], r["_c"], r["_rows"]) for r in sizes.withColumn("_rows", block_rows(F.col("_c"), rows)).collect()]
    if not large:
        return Pivots({})
    total = sum(c for _, _, c, _ in large)
    wanted = vectors.sparkSession.createDataFrame([(t, n, c, max(1, min(math.ceil(c / each), PIVOTS * c // total))) for t, n, c, each in large], StructType([vectors.schema["tenant_id"], StructField("n", IntegerType()), StructField("_c", LongType()), StructField("_wanted", LongType())]))
    # About four times as many as wanted are looked at, whatever the table's size.
    drawn = vectors.join(F.broadcast(wanted), ["tenant_id", "n"]).withColumn("_h", F.xxhash64(key)).filter(F.pmod(F.col("_h"), F.col("_c")) < 4 * F.col("_wanted"))
    order = Window.partitionBy("tenant_id", "n").orderBy("_h")
    chosen = drawn.filter(F.exists("_v", lambda x: x != 0)).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.col("_wanted"))
    found: dict[tuple[object, int], list] = {}
    for r in chosen.select("tenant_id", "n", "_v").collect():
        found.setdefault((r["tenant_id"], r["n"]), []).append(r["_v"])
    return Pivots({k: unit_rows(matrix(v)) for k, v in found.items()})


def _placed(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """``vectors`` (tenant_id, n, ...) with ``_ball`` and ``_far`` (from its pivot), frozen if there are pivots."""
    if not pivots.of:
        ball = F.when(F.exists("_v", lambda x: x != 0), 0).otherwise(NO_DIRECTION)
        return vectors.withColumns({"_ball": ball, "_far": F.lit(DIAMETER)})

    @F.pandas_udf("struct<ball:int,far:double>")
    def nearest(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for tenant, v in batches:
            out = pd.DataFrame({"ball": np.zeros(len(v), np.int32), "far": np.zeros(len(v))})
            if len(v):
                for (t, _), at in pd.DataFrame({"t": tenant, "n": v.map(len)}).groupby(["t", "n"], dropna=False).indices.items():
                    ball, far = pivots.nearest(t, matrix(v.iloc[at]))
                    out.iloc[at, 0], out.iloc[at, 1] = ball.astype(np.int32), far
            yield out

    return frozen(vectors.withColumn("_b", nearest("tenant_id", "_v"))).withColumns({"_ball": F.col("_b.ball"), "_far": F.col("_b.far")}).drop("_b")


def _dealt(placed: DataFrame, rows: int, key: str, bounded: bool) -> DataFrame:
    """``placed`` vectors with their ``_block``: about ``rows`` of a ball in each, or ``block_rows`` of chunks.

    Only balls over that are looked up.  ``bounded``, of chunks: there are no
    more of them than pivots and large tenants, so they are broadcast.
    """
    sizes = placed.groupBy("tenant_id", "n", "_ball").agg(F.count("*").alias("_c"))
    most = block_rows(F.sum("_c").over(Window.partitionBy("tenant_id", "n")), rows) if bounded else F.lit(rows)
    sizes = sizes.select("tenant_id", "n", "_ball", F.ceil(F.col("_c") / most).alias("_blocks")).filter("_blocks > 1")
    few = F.broadcast(sizes) if bounded or sizes.count() <= FEW else sizes
    part = F.pmod(F.xxhash64(key), F.coalesce("_blocks", F.lit(1)))
    return placed.join(few, ["tenant_id", "n", "_ball"], "left").withColumn("_block", F.shiftleft((F.col("_ball") + 1).cast("long"), 40) + part).drop("_blocks")


def _packed(vectors: DataFrame, ids: list[str]) -> DataFrame:
    """``tenant_id, n, _block, ids, v`` for each block, in order of the ids."""
    rows = F.sort_array(F.collect_list(F.struct(*ids, "_v")))
    blocks = vectors.groupBy("tenant_id", "n", "_block").agg(rows.alias("_rows"))
    return blocks.select("tenant_id", "n", "_block", F.transform("_rows", lambda r: F.struct(*[r[i].alias(i) for i in ids])).alias("ids"), F.transform("_rows", lambda r: r["_v"]).alias("v"))


def dense_top(queries: DataFrame, chunks: DataFrame, k: int, documents: DataFrame | None = None) -> DataFrame:
    """The k chunks nearest to each query by cosine, optionally among ``documents`` (document_id) only; exact.

    Queries (query_id, tenant_id, embedding) meet the chunks (chunk_id,
    tenant_id, document_id, embedding) of their tenant.  See ``dense_search``.
    """
    return dense_search(queries, chunks, k, documents)[0]


def dense_search(queries: DataFrame, chunks: DataFrame, k: int, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``dense_top`` returns, and ``query_id, blocks, read``: the chunk blocks of a query's tenant and those it was compared with.

    Chunks of a tenant with more than CHUNK_ROWS are dealt to balls around
    pivots, balls to blocks of about ``block_rows`` vectors; a block knows its
    radius.  Queries are dealt alike in blocks of QUERY_ROWS.  A query meets
    the blocks with the best bounds first, as many as have k vectors; then
    only blocks whose bound by the triangle inequality reaches its k-th score.
    A block meets all its queries in one group (GROUP_QUERIES at most), and
    only the k best of it per query go on (see ``nearest``).  Vectors have unit length; scores are rounded to
    twelve places, so that equal vectors tie; vectors of other widths than the
    query's score 0.  Jobs run here: pivots are chosen, and where there are
    any, the placed vectors and the first hits are frozen.
    """
    within = chunks if documents is None else chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    vector = [F.col("embedding").alias("_v"), F.size("embedding").alias("n")]
    given = lambda df, *ids: df.filter("embedding is not null").select("tenant_id", *ids, *vector)
    held_rows = given(within, "chunk_id", "document_id")
    pivots = pivots_of(held_rows, CHUNK_ROWS, "chunk_id")
    dealt = _placed(held_rows, pivots)
    dealt = _dealt(dealt, CHUNK_ROWS, "chunk_id", True) if pivots.of else dealt.withColumn("_block", (F.col("_ball") + 1).cast("long"))
    held = dealt.select("tenant_id", F.col("n").alias("cn"), F.col("_block").alias("_at"), "chunk_id", "document_id", "_v")
    blocks = dealt.groupBy("tenant_id", "n", "_block").agg(F.first("_ball").alias("ball"), F.max("_far").alias("radius"), F.count("*").alias("rows"))
    about = blocks.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("cn"), F.col("_block").alias("_at"), "ball", "radius", "rows"))).alias("blocks"))
    asked = _packed(_dealt(_placed(given(queries, "query_id"), pivots), QUERY_ROWS, "query_id", False), ["query_id"])
    asked = asked.select("tenant_id", F.col("n").alias("qn"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    if pivots.of:
        # From files, so that a tenant that is one constant is still a key of the join.
        asked, about = frozen(asked), frozen(about)
    asked = asked.join(about, "tenant_id")
    parts = -(-asked.agg(F.sum(F.size("q_ids"))).first()[0] // GROUP_QUERIES) if pivots.of and not asked.isEmpty() else 1
    first = _meet(_planned(asked, pivots, k, None), held, k, parts)
    total = asked.select(F.explode("q_ids").alias("q"), F.size("blocks").alias("blocks")).select("q.query_id", "blocks")
    if not pivots.of:
        return ranked(first.select("query_id", "chunk_id", "document_id", "score"), k), total.withColumn("read", F.col("blocks"))
    asked, best = frozen(asked), frozen(ranked(first, k))
    reached = best.filter(F.col("rank") == k).select("query_id", "score")
    # What a block's queries have reached, in the order of its queries.
    each = asked.withColumn("_b", F.monotonically_increasing_id()).select("_b", F.posexplode("q_ids").alias("_i", "q")).select("_b", "_i", "q.query_id").join(reached, "query_id", "left")
    scores = each.groupBy("_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("score", F.lit(-2.0)).alias("s")))), lambda x: x["s"]).alias("reached"))
    again = _planned(asked.withColumn("_b", F.monotonically_increasing_id()).join(scores, "_b").drop("_b"), pivots, k, "reached")
    hits = best.drop("rank").unionByName(_meet(again, held, k, parts))
    read = _planned(asked, pivots, k, None).unionByName(again).select(F.explode("q").alias("_i"), "q_ids").groupBy(F.get("q_ids", F.col("_i"))["query_id"].alias("query_id")).agg(F.count("*").alias("read"))
    return ranked(hits.select("query_id", "chunk_id", "document_id", "score"), k), total.join(read, "query_id")


def _planned(asked: DataFrame, pivots: Pivots, k: int, reached: str | None) -> DataFrame:
    """``tenant_id, cn, _at, qn, q_ids, q_v, s, q``: the blocks that query blocks meet, and the places of the queries that do.

    Without ``reached``: for each query the blocks with the best bounds that
    have k vectors together.  With it (the k-th score of each query): the
    other blocks whose bound reaches that.
    """

    @F.pandas_udf("array<struct<b:int,q:array<int>>>")
    def plan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for tenant, q_v, blocks, scores in batches:
            out = []
            for t, v, places, kth in zip(tenant, q_v, blocks, scores, strict=True):
                meets: dict[int, list[int]] = {}
                sizes = np.array([b["rows"] for b in places])
                for i, query in enumerate(matrix(v)):
                    bound = pivots.bounds(t, query, places)
                    order = np.argsort(-bound, kind="stable")
                    most = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1 if pivots.of else len(order)
                    some = order[:most] if not len(kth) else order[most:][bound[order[most:]] + SLACK >= kth[i]]
                    for b in some:
                        meets.setdefault(int(b), []).append(i)
                out.append([{"b": b, "q": q} for b, q in sorted(meets.items())])
            yield pd.Series(out, dtype=object)

    scores = F.col(reached) if reached else F.array().cast("array<double>")
    each = asked.withColumn("_p", F.explode(plan("tenant_id", "q_v", "blocks", scores)))
    return each.select("tenant_id", F.get("blocks", F.col("_p.b")).alias("_to"), "qn", "q_ids", "q_v", scores.alias("s"), F.col("_p.q").alias("q")).select("tenant_id", "_to.cn", "_to._at", "qn", "q_ids", "q_v", "s", "q")


def nearest(queries: np.ndarray, chunks: np.ndarray, reached: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of length 1) the places and scores of the k best chunks, in order, ties by place; none below ``reached``.

    Products in single precision choose: a block's columns are cut into at
    least 4 k runs, and the k-th of their highest products is no more than the
    k-th score.  What is that high, less twice what roundings may take, is
    computed in double precision.
    """
    runs = max(4 * k, 256)
    size, slack = len(chunks) // runs, 4 * (chunks.shape[1] + 2) * 2.0**-24
    q32, c32 = queries.astype(np.float32), np.ascontiguousarray(chunks.astype(np.float32).T)
    for begin in range(0, len(queries), QUERY_ROWS):
        product, floor = q32[begin : begin + QUERY_ROWS] @ c32, reached[begin : begin + QUERY_ROWS]
        if size > 1:
            highest = np.nan_to_num(product[:, : runs * size].reshape(len(product), runs, size).max(axis=2), nan=-np.inf)
            floor = np.maximum(floor, np.partition(highest, runs - k, axis=1)[:, runs - k])
        for i, row in enumerate(product):
            some = np.flatnonzero(row >= np.float32(floor[i] - slack))
            scores = np.round((chunks[some] * queries[begin + i]).sum(axis=1), 12) + 0.0
            order = np.argsort(-scores, kind="stable")[:k]
            yield some[order], scores[order]


def _meet(planned: DataFrame, held: DataFrame, k: int, parts: int) -> DataFrame:
    """``query_id, chunk_id, document_id, score``: the k best of each block for each of its queries.

    A task holds a block and the queries of one of ``parts``, never several blocks.
    """
    keys = ["tenant_id", "cn", "_at", "_part"]
    query = F.transform("q", lambda i: F.struct(F.get("q_ids", i)["query_id"].alias("query_id"), F.get("q_v", i).alias("q_v"), F.coalesce(F.get("s", i), F.lit(-2.0)).alias("s")))
    asks = planned.select("tenant_id", "cn", "_at", "qn", F.explode(query).alias("q")).select(*[F.col(c).alias(f"q{c}") for c in keys[:3]], F.pmod(F.xxhash64("q.query_id"), F.lit(parts)).cast("int").alias("q_part"), "qn", "q.*")
    blocks = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = StructType([asks.schema["query_id"], held.schema["chunk_id"], held.schema["document_id"], StructField("score", DoubleType())])

    def best(chunks: pa.Table, asks: pa.Table) -> pa.Table:
        form = pa.schema([asks.schema.field("query_id"), chunks.schema.field("chunk_id"), chunks.schema.field("document_id"), ("score", pa.float64())])
        if not chunks.num_rows or not asks.num_rows:
            return form.empty_table()
        chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))
        rows, who, found, scores = unit_rows(flat_matrix(chunks["_v"])), [], [], []
        same = pc.equal(asks["qn"], chunks["cn"][0])
        asks, others = asks.filter(same), asks.filter(pc.invert(same))
        reached = lambda t: t["s"].to_numpy()
        if asks.num_rows:
            for i, (at, score) in enumerate(nearest(unit_rows(flat_matrix(asks["q_v"])), rows, reached(asks), k)):
                who.append(np.full(len(at), i))
                found.append(at)
                scores.append(score)
        first = np.arange(min(k, len(rows)))
        for i in np.flatnonzero(reached(others) <= 0):
            who.append(np.full(len(first), asks.num_rows + i))
            found.append(first)
            scores.append(np.zeros(len(first)))
        if not who:
            return form.empty_table()
        at = pa.array(np.concatenate(found))
        ids = pa.concat_tables([asks, others])["query_id"].take(pa.array(np.concatenate(who)))
        return pa.table([ids, chunks["chunk_id"].take(at), chunks["document_id"].take(at), pa.array(np.concatenate(scores))], schema=form)

    return blocks.groupBy(*keys).cogroup(asks.groupBy(*[f"q{c}" for c in keys])).applyInArrow(best, schema)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(chunks: DataFrame, text: str = "content", queries: DataFrame | None = None) -> DataFrame:
    """The inverted index: ``chunk_id, tenant_id, document_id, term, places`` (positions from 0); with ``queries``, of their terms only."""
    words = chunks.select("chunk_id", "tenant_id", "document_id", F.posexplode(terms(F.col(text))).alias("_at", "term"))
    if queries is not None:
        words = words.join(query_terms(queries).select("tenant_id", "term").distinct(), ["tenant_id", "term"], "left_semi")
    return words.groupBy("chunk_id", "tenant_id", "document_id", "term").agg(F.sort_array(F.collect_list("_at")).alias("places"))


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """``query_id, tenant_id, term, n_terms``: distinct terms of each query."""
    asked = queries.select("query_id", "tenant_id", F.array_distinct(terms(F.col(text))).alias("_t"))
    return asked.select("query_id", "tenant_id", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))


def lexical_matches(queries: DataFrame, index: DataFrame, text: str = "query") -> DataFrame:
    """``query_id, chunk_id, document_id, places`` (of each term) for the chunks that have all terms of a query.

    Chunks with a query's rarest term are looked up first, and only their other
    postings are read.  Postings of that term are dealt to PARTS by their
    chunk, so a frequent term of a large tenant isn't one task.
    """
    asked = queries.select("query_id", "tenant_id", F.array_distinct(terms(F.col(text))).alias("_t"))
    frequency = index.groupBy("tenant_id", "term").agg(F.count("*").alias("_df"))
    each = asked.select("query_id", "tenant_id", F.explode("_t").alias("term")).join(frequency, ["tenant_id", "term"], "left")
    rarest = each.groupBy("query_id", "tenant_id").agg(F.min_by("term", F.coalesce("_df", F.lit(0))).alias("term"))
    lead = rarest.join(asked, ["query_id", "tenant_id"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.hash("chunk_id"), F.lit(PARTS)).alias("_part")
    likely = index.select("tenant_id", "term", "chunk_id", part).join(lead, ["tenant_id", "term", "_part"]).select("query_id", "tenant_id", "chunk_id", "_t")
    hits = index.join(likely, ["tenant_id", "chunk_id"]).filter(F.array_contains("_t", F.col("term")))
    full = hits.groupBy("query_id", "chunk_id", "document_id").agg(F.count("*").alias("_n"), F.max(F.size("_t")).alias("_of"), F.collect_list("places").alias("places"))
    return full.filter("_n = _of").drop("_n", "_of")


def cover_density(places: list[list[int]]) -> float:
    """A tenth for each cover (a shortest stretch with all terms), divided by one more than the other words in it."""
    entries = sorted((at, term) for term, some in enumerate(places) for at in some)
    latest, total, before = [-1] * len(places), 0.0, -1
    for k, (at, term) in enumerate(entries):
        latest[term] = k
        begin = min(latest)
        if begin > before:
            total += 0.1 / (1 + at - entries[begin][0] - (k - begin))
            before = begin
    return total


def lexical_top(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k chunks with all terms of each query, ranked by the density of their covers.

    Parent chunks are not left out.  Terms are compared as they are, without
    stems or stop words.
    """

    @F.pandas_udf("double")
    def density(batch: pd.Series) -> pd.Series:
        return batch.map(lambda places: cover_density([list(x) for x in places])).astype(float)

    full = lexical_matches(queries, index)
    return ranked(full.select("query_id", "chunk_id", "document_id", F.round(density("places"), 6).alias("score")), k)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the lists that a chunk is in.

    Scores of the lists don't count; ``best_score`` is the highest of them.
    """
    parts = [df.select("query_id", "chunk_id", "document_id", F.col("score").alias("_raw"), (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("_part")) for df, w in lists]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    fused = both.groupBy("query_id", "chunk_id", "document_id").agg(F.sum("_part").alias("score"), F.max("_raw").alias("best_score"))
    return ranked(fused)


def keep_order(hits: DataFrame, k: int) -> DataFrame:
    """The reranker that keeps the order: the first k, scored 1 / position."""
    return hits.filter(F.col("rank") <= k).withColumn("score", F.lit(1.0) / F.col("rank"))


def rerank(hits: DataFrame, model_scores: DataFrame, k: int) -> DataFrame:
    """The k best by a model's scores (query_id, chunk_id, model_score); a query of which one is missing keeps its order."""
    of_query = Window.partitionBy("query_id")
    both = hits.join(model_scores, ["query_id", "chunk_id"], "left").withColumn("_failed", F.max(F.col("model_score").isNull()).over(of_query))
    score = F.when(F.col("_failed"), F.lit(1.0) / F.col("rank")).otherwise(F.col("model_score"))
    return ranked(both.withColumn("score", score).drop("model_score", "_failed", "rank"), k)


def rerank_with(hits: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Callable[[str, list[str]], list[float]], k: int, most: int = 200) -> DataFrame:
    """The k best of each query's first ``most`` hits by a reranker (query, texts -> scores), the port of an outside model.

    If it raises, or answers with another number of scores, the query keeps
    its order with scores of 1 / position, and ``degraded`` says so.
    """
    asked = hits.filter(F.col("rank") <= most).join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    rows = asked.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document_id", "content"))).alias("_h"))

    @F.pandas_udf("struct<scores:array<double>,degraded:boolean>")
    def scored(asked: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for q, t in zip(asked, texts, strict=True):
            try:
                scores = [float(x) for x in scorer(q, list(t))]
                ok = len(scores) == len(t)
            except Exception:  # whatever an outside model does, the order stays
                ok = False
            out.append((scores, False) if ok else ([1.0 / (n + 1) for n in range(len(t))], True))
        return pd.DataFrame(out, columns=["scores", "degraded"])

    done = rows.withColumn("_s", scored("query", F.transform("_h", lambda h: h["content"])))
    flat = done.select("query_id", F.col("_s.degraded").alias("degraded"), F.explode(F.arrays_zip(F.col("_h").alias("h"), F.col("_s.scores").alias("s"))).alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_was"))
    kept = flat.select("query_id", "x.h.chunk_id", "x.h.document_id", F.col("x.s").alias("score"), "degraded", F.col("x.h.rank").alias("_was"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_was")


def group_by_document(hits: DataFrame, spans: int = SPANS, most: int | None = None) -> DataFrame:
    """``query_id, document_id, score`` (the sum of its best chunks), ``spans`` (those, best first) and ``rank``."""
    best = Window.partitionBy("query_id", "document_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    top = hits.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= spans)
    grouped = top.groupBy("query_id", "document_id").agg(
        F.sum("score").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_n"), "chunk_id", F.col("score").alias("s")))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["s"].alias("score"))).alias("spans"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("document_id"))
    out = grouped.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def parents_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the content of the chunk's parent, looked up by tenant and id."""
    link = chunks.select("chunk_id", "tenant_id", "parent_chunk_id")
    text = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), "tenant_id", F.col("content").alias("parent_content"))
    return hits.join(link, "chunk_id").join(text, ["tenant_id", "parent_chunk_id"], "left")


def page_at(offset: Column, pages: Column) -> Column:
    """The last page that starts at or before an offset; 0 if none does."""
    before = F.filter(pages, lambda p: p["start_char"] <= offset)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.lit(0))


def pages_at(points: DataFrame, pages: DataFrame, document: str = "document_id") -> DataFrame:
    """The same for tables: ``points`` (document, offset) with ``page`` from ``pages`` (document, page, start_char).

    Both sides are merged in order of position, so a point reads the last page
    start before it without a pair for every page.
    """
    p = pages.select(document, F.col("start_char").alias("_at"), F.lit(0).alias("_kind"), F.col("page").alias("_page"), F.lit(None).cast("long").alias("offset"))
    q = points.select(document, F.col("offset").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_page"), F.col("offset").cast("long").alias("offset"))
    upto = Window.partitionBy(document).orderBy("_at", "_kind", "_page").rowsBetween(Window.unboundedPreceding, 0)
    merged = p.unionByName(q).withColumn("page", F.coalesce(F.last("_page", ignorenulls=True).over(upto), F.lit(0)))
    return merged.filter("_kind = 1").select(document, "offset", "page")


def representative_text(chunks: DataFrame, count: int = 5, most: int = 2000) -> DataFrame:
    """``document_id, query``: the first child chunks of each document, joined and cut."""
    order = Window.partitionBy("tenant_id", "document_id").orderBy("chunk_index")
    first = chunks.filter("not is_parent").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count)
    joined = first.groupBy("tenant_id", "document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda x: x["content"]), " ").alias("_t"))
    return joined.select("tenant_id", "document_id", strip(F.substring("_t", 1, most)).alias("query"))
