"""Search and indexing plans, composed of the operators; lazy up to the caller's action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.numbers import mock_embedding
from quillsift.operators import chunking, lexical, retrieval
from quillsift.operators.ingest import dedup
from quillsift.operators.sanitize import sanitize
from quillsift.session import frozen


@dataclass(frozen=True)
class SearchConfig:
    """Recall per list, weights of the lists, chunks reranked, candidates returned."""

    recall: int = 20
    dense_weight: float = 0.6
    lexical_weight: float = 0.4
    rerank: int = 10
    top_k: int = 10


def of_sections(chunks: DataFrame, sections: list[str] | None) -> DataFrame:
    """Chunks of the sections, all of them if none are named."""
    return chunks if sections is None else chunks.filter(F.col("section").isin(sections))


def without_source(hits: DataFrame, source: Column | str = "query_id") -> DataFrame:
    """Hits of other documents than the source; asked after a cutoff, its own have used up places of that."""
    return hits.filter(F.col("document_id") != (F.col(source) if isinstance(source, str) else source))


def lexical_list(queries: DataFrame, chunks: DataFrame, k: int, index: DataFrame | lexical.LexicalIndex | None = None) -> DataFrame:
    """The k best chunks of each query by their terms, from a stored index if there is one."""
    if isinstance(index, lexical.LexicalIndex):
        return lexical.top(index, queries, k)
    return retrieval.lexical_top(queries, retrieval.postings(chunks, queries=queries) if index is None else index, k)


def candidates(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", config: SearchConfig = SearchConfig(), sections: list[str] | None = None, index: DataFrame | lexical.LexicalIndex | None = None) -> DataFrame:
    """Documents for each query (query_id, tenant_id, query, embedding): ``query_id, document_id, score, spans, rank``.

    ``mode`` is hybrid, semantic or lexical.  The score is that of the
    reranker that keeps the order, so fusion decides order and the sum of
    1 / position over a document's chunks decides its score.  ``sections``
    restricts the chunks, ``index`` is a stored index of them (or their
    postings); without one, the chunks' texts are read for the queries' terms.
    """
    if mode not in ("hybrid", "semantic", "lexical"):
        raise ValueError(mode)
    within = of_sections(chunks, sections)
    lists = []
    if mode != "lexical":
        lists.append((retrieval.dense_top(queries, retrieval.searchable(within), config.recall), config.dense_weight if mode == "hybrid" else 1.0))
    if mode != "semantic":
        lists.append((lexical_list(queries, within, config.recall, index), config.lexical_weight if mode == "hybrid" else 1.0))
    kept = retrieval.keep_order(retrieval.fuse(lists), config.rerank)
    return retrieval.group_by_document(kept, most=config.top_k)


def similar(sources: DataFrame, chunks: DataFrame, embed=mock_embedding, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Documents like each of ``sources`` (tenant_id, document_id), by its first chunks; not itself, and nothing is reranked.

    The source is left out after the recall, so its own chunks use up places of it.
    """
    text = retrieval.representative_text(chunks.join(sources, ["tenant_id", "document_id"], "left_semi"))
    queries = text.select(F.col("document_id").alias("query_id"), "tenant_id", embed(F.col("query")).alias("embedding"))
    # The search reads vectors several times, texts are chunked for them once.
    held = frozen(retrieval.searchable(chunks).select("tenant_id", "chunk_id", "document_id", "embedding"))
    hits = retrieval.dense_top(frozen(queries), held, 2 * config.recall)
    hits = without_source(hits)
    return retrieval.group_by_document(hits, most=config.top_k)


def index_versions(versions: DataFrame, embed=mock_embedding, model: tuple[str, str] = ("mock", "1"), most_children: int = 600) -> DataFrame:
    """Chunk rows of resume versions that have text and aren't in quarantine; children have vectors, parents none."""
    usable = versions.filter(~F.col("quarantined") & (F.trim("extracted_text") != ""))
    chunks = chunking.cap_children(chunking.chunk_documents(usable), most_children)
    vector = F.when(~F.col("is_parent"), embed(F.col("content")).cast("array<float>"))
    return chunks.withColumns({"embedding": vector, "embedding_model": F.lit(model[0]), "embedding_version": F.lit(model[1])})


def ingest(arrivals: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents, versions and chunks for ``arrivals`` (id, tenant_id, arrival, content, filename, text, spans, metadata).

    Content is known by its SHA-256: only its first arrival is stored.
    """
    hashed = arrivals.withColumn("sha256", F.sha2("content", 256))
    new = dedup(hashed, stored).filter("is_new")
    clean = sanitize(new)
    documents = clean.select("id", "tenant_id", "sha256", "filename", F.octet_length("content").cast("long").alias("size_bytes"), F.concat_ws("/", F.lit("tenants"), "tenant_id", F.lit("resumes"), "sha256", "filename").alias("storage_key"))
    versions = clean.select(
        F.sha2(F.concat_ws(":", "id", F.lit("1")), 256).alias("id"), "tenant_id", F.col("id").alias("document_id"), F.lit(1).alias("version"), F.col("clean_text").alias("extracted_text"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("text_sha256"), "injection_risk_score", "quarantined"
    )
    return {"documents": documents, "versions": versions, "chunks": index_versions(versions), "duplicates": dedup(hashed, stored).filter("not is_new")}


def funnel(queries: DataFrame, chunks: DataFrame, recall: int = 200, rerank: int = 120, output: int = 60, index: DataFrame | lexical.LexicalIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """The judged candidates of each query, and what each cutoff left: dense recall, lexical recall, fusion, rerank, output."""
    dense = retrieval.dense_top(queries, retrieval.searchable(chunks), recall)
    fused = retrieval.fuse([(dense, 0.6), (lexical_list(queries, chunks, recall, index), 0.4)]).filter(F.col("rank") <= recall)
    kept = retrieval.keep_order(fused, rerank)
    counts = fused.groupBy("query_id").agg(
        F.lit(recall).alias("initial"), F.count("*").alias("after_recall"), F.count_if(F.col("rank") <= rerank).alias("after_rerank"), F.count_if(F.col("rank") <= output).alias("final")
    )
    return kept.filter(F.col("rank") <= output), counts


