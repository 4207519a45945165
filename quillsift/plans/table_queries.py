"""Queries over stored tables: rubrics, versions, sinks, chunks, tasks, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillsift.functions import text as tx
from quillsift.operators import agents, catalog, chunking, ingest, limits, retrieval, rubric, scoring
from quillsift.plans import search
from quillsift.plans.registry import query
from quillsift.sources import tables
from quillsift.sources.tables import load

# --- rubrics: an order is a rubric version of its customer's job ---------------------------------

_RUBRICS = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS job_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'superseded' END AS status FROM orders)"""


def rubrics(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "draft").otherwise("superseded")
    none = {c: F.lit(None).cast("string") for c in ("content_hash", "approved_by")}
    shown = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.col("o_custkey").alias("job_id"), version.alias("version"), status.alias("status"))
    return shown.withColumns(none | {"approved_at": F.lit(None).cast("timestamp"), "aggregation_formula_version": F.when(F.col("job_id") % 10 == 0, "v9").otherwise("v1")})


def items(spark, sf_dir):
    """Line items as requirements, each the share of its quantity."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    parts = load(spark, sf_dir, "lineitem").withColumn("ordinal", place)
    text = {"text": F.concat(F.lit("part "), F.col("l_partkey").cast("string")), "category": F.lit("skill"), "min_years": F.lit(None).cast("decimal(4,1)"), "min_seniority": F.lit(None).cast("string")}
    named = parts.select(F.concat_ws(":", "l_orderkey", "ordinal").alias("id"), F.col("l_orderkey").cast("string").alias("rubric_version_id"), "ordinal", F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("is_must_have"), "l_partkey")
    return named.withColumns(text).withColumn("weight", F.lit("0.2500").cast("decimal(5,4)")).drop("l_partkey")


@query(
    f"""WITH {_RUBRICS}, w AS (SELECT c_custkey AS job_id, n FROM customer, range(1, 3) t(n) WHERE c_custkey % 2 = 0), top AS (SELECT job_id, MAX(version) AS v FROM r GROUP BY job_id)
    SELECT w.job_id, CAST(w.job_id AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS id, CAST(COALESCE(v, 0) + n AS INTEGER) AS version, 'draft' AS status, CAST(40 AS INTEGER) AS must_have_fail_cap FROM w LEFT JOIN top USING (job_id)"""
)
def draft_create(spark, sf_dir):
    """Two drafts for every second customer's job, and two for jobs that nobody has."""
    jobs = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit("t").alias("tenant_id"), F.col("c_custkey").alias("id"))
    all_ids = load(spark, sf_dir, "customer").select(F.lit("t").alias("tenant_id"), F.col("c_custkey").alias("job_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n"))
    wanted = all_ids.select("tenant_id", "job_id", F.concat_ws("/", "job_id", "n").alias("id"))
    return rubric.create_drafts(rubrics(spark, sf_dir), jobs, wanted).select("job_id", "id", "version", "status", "must_have_fail_cap")


_EDIT = f"""WITH {_RUBRICS}, e AS (SELECT id, status FROM r WHERE job_id % 3 = 0)"""


@query(f"{_EDIT} SELECT id AS rubric_version_id, status FROM e WHERE status <> 'draft'")
def draft_edit_refused(spark, sf_dir):
    return rubric.edit(rubrics(spark, sf_dir), items(spark, sf_dir), _changes(spark, sf_dir))[1].select("rubric_version_id", "status")


@query(
    f"""{_EDIT}, old AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT id AS rubric_version_id, CAST(1 AS BIGINT) AS n FROM e WHERE status = 'draft' UNION ALL SELECT k, n FROM old WHERE k NOT IN (SELECT id FROM e WHERE status = 'draft')"""
)
def draft_edit(spark, sf_dir):
    """Requirement counts after edits that give every version of some jobs one requirement."""
    return rubric.edit(rubrics(spark, sf_dir), items(spark, sf_dir), _changes(spark, sf_dir))[0].groupBy("rubric_version_id").agg(F.count("*").alias("n"))


def _changes(spark, sf_dir):
    one = items(spark, sf_dir).limit(0)
    wanted = rubrics(spark, sf_dir).filter("job_id % 3 = 0").select(F.col("id").alias("rubric_version_id"))
    fields = {c.name: F.lit(None).cast(c.dataType) for c in one.schema if c.name != "rubric_version_id"}
    return wanted.withColumns(fields | {"id": F.col("rubric_version_id"), "ordinal": F.lit(1)}).select(*one.columns)


@query(
    f"""WITH {_RUBRICS}, j AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, sha256(string_agg(j, chr(10) ORDER BY j)) AS h FROM (SELECT l_orderkey, '{{"category":"skill","is_must_have":' || CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END || ',"min_seniority":null,"min_years":null,"text":"part ' || CAST(l_partkey AS VARCHAR) || '","weight":"0.2500"}}' AS j FROM lineitem) GROUP BY 1)
    SELECT r.id, CASE WHEN status = 'draft' AND h IS NOT NULL THEN 'approved' ELSE status END AS status, CASE WHEN status = 'draft' THEN h END AS content_hash, CASE WHEN status = 'draft' AND h IS NOT NULL THEN 'boss' END AS approved_by FROM r LEFT JOIN j USING (id)"""
)
def rubric_approve(spark, sf_dir):
    all_of_them = rubrics(spark, sf_dir)
    wanted = all_of_them.select("id", F.lit("boss").alias("approved_by"), F.lit(datetime.datetime(2024, 1, 1)).alias("approved_at"))
    return rubric.approve(all_of_them, items(spark, sf_dir), wanted).select("id", "status", "content_hash", "approved_by")


_MINT = f"""WITH {_RUBRICS}, w AS (SELECT * FROM r WHERE status = 'approved' AND job_id % 2 = 1 AND version = 1), top AS (SELECT job_id, MAX(version) AS v FROM r GROUP BY job_id)"""


@query(
    f"""{_MINT} SELECT id, job_id, version, CASE WHEN id IN (SELECT id FROM w) THEN 'superseded' ELSE status END AS status FROM r
    UNION ALL SELECT 'n' || id, job_id, CAST(v + 1 AS INTEGER), 'draft' FROM w JOIN top USING (job_id)"""
)
def rubric_mint_next(spark, sf_dir):
    return rubric.mint_next(rubrics(spark, sf_dir), items(spark, sf_dir), _minted(spark, sf_dir))[0].select("id", "job_id", "version", "status")


@query(f"{_MINT}, q AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT k AS rubric_version_id, n FROM q UNION ALL SELECT 'n' || k, n FROM q WHERE k IN (SELECT id FROM w)")
def rubric_mint_requirements(spark, sf_dir):
    return rubric.mint_next(rubrics(spark, sf_dir), items(spark, sf_dir), _minted(spark, sf_dir))[1].groupBy("rubric_version_id").agg(F.count("*").alias("n"))


def _minted(spark, sf_dir):
    return rubrics(spark, sf_dir).filter("job_id % 2 = 1 and version = 1").select("id", F.concat(F.lit("n"), "id").alias("new_id"))


@query(f"WITH {_RUBRICS} SELECT id, status = 'draft' AS editable, status = 'approved' AS scorable FROM r")
def rubric_guards(spark, sf_dir):
    return rubrics(spark, sf_dir).select("id", rubric.editable(F.col("status")).alias("editable"), rubric.scorable(F.col("status")).alias("scorable"))


@query(
    f"""WITH {_RUBRICS}, n AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT * FROM (SELECT r.id, CASE WHEN status <> 'approved' THEN 'not_approved' WHEN job_id % 10 = 0 THEN 'unknown_formula' WHEN n IS NULL THEN 'no_requirements' WHEN n <> 4 THEN 'weights_do_not_sum_to_one' END AS violation FROM r LEFT JOIN n USING (id)) WHERE violation IS NOT NULL"""
)
def rubric_violations(spark, sf_dir):
    return scoring.rubric_violations(rubrics(spark, sf_dir), items(spark, sf_dir))


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, COUNT(*) OVER (PARTITION BY l_orderkey % 3) AS n FROM lineitem)
    SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'blank_text' WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 'text_too_long' WHEN w > 49 THEN 'weight_out_of_range' WHEN l_linenumber = 2 AND w < 3 THEN 'years_out_of_range' END AS violation FROM q) WHERE violation IS NOT NULL"""
)
def requirement_rules(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.when((n == 1) & (k % 5 == 0), " \t ").when((n == 1) & (k % 7 == 0), F.repeat(F.lit("x"), F.lit(2001))).otherwise(" text ")
    rows = load(spark, sf_dir, "lineitem").withColumns({"rubric_id": k, "text": text, "weight": F.when(F.col("l_quantity") > 49, 1001).otherwise(F.col("l_quantity")), "min_years": F.when((n == 2) & (F.col("l_quantity") < 3), 100).otherwise(5)})
    return rubric.requirement_violations(rows).select("l_orderkey", "l_linenumber", "violation")


@query("WITH q AS (SELECT o_custkey AS k, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT k AS rubric_id, CAST(ordinal AS INTEGER) AS ordinal, CAST((10000 // n + CASE WHEN ordinal <= 10000 % n THEN 1 ELSE 0 END) / 10000.0 AS DOUBLE) AS weight FROM q")
def rubric_rescope(spark, sf_dir):
    """Equal weights of a customer's orders: what is left over goes to the first of them."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rubric_id"), place.alias("position"), F.lit(3).alias("weight"))
    return rubric.rescope(rows).select("rubric_id", "ordinal", F.col("weight").cast("double").alias("weight"))


@query("SELECT c_custkey, c_nationkey % 3 = 0 OR c_nationkey % 5 = 0 AS allowed FROM customer")
def role_checks(spark, sf_dir):
    k = F.col("c_nationkey")
    roles = F.array_compact(F.array(F.lit("viewer"), F.when(k % 3 == 0, "recruiter"), F.when(k % 5 == 0, "admin")))
    return load(spark, sf_dir, "customer").select("c_custkey", catalog.allowed(roles, ("owner", "admin", "recruiter")).alias("allowed"))


# --- sinks ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS document_id, COUNT(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def delete_by_document(spark, sf_dir):
    return tables.without_document(*_deleted(spark, sf_dir)).groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("SELECT l_orderkey AS document_id, COUNT(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def delete_counts(spark, sf_dir):
    return tables.deleted_counts(*_deleted(spark, sf_dir)).select("document_id", "deleted")


def _deleted(spark, sf_dir):
    chunks = load(spark, sf_dir, "lineitem").select(F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("document_id"), "l_linenumber")
    return chunks, load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("document_id"))


@query("SELECT l_orderkey AS owner, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1 UNION ALL SELECT o_orderkey, CAST(99 AS BIGINT) FROM orders WHERE o_orderstatus = 'O'")
def replace_set(spark, sf_dir):
    old = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("n"))
    new = load(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("owner"), F.lit(99).cast("long").alias("n"))
    return tables.replace_set(old, new, "owner").groupBy("owner").agg(F.sum("n").alias("total"))


@query("SELECT o_custkey AS cache_key, arg_max(o_orderkey, o_orderkey) AS payload FROM orders GROUP BY 1")
def cache_upsert(spark, sf_dir):
    """A customer's orders as answers to one key, the odd ones stored already: the newest stays."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cache_key"), F.col("o_orderkey").alias("payload"), F.col("o_orderkey").alias("created_at"))
    return tables.upsert(rows.filter("payload % 2 = 1"), rows.filter("payload % 2 = 0"), "cache_key", "created_at").select("cache_key", "payload")


@query("SELECT o_orderkey AS cache_key FROM orders WHERE o_orderkey % 3 = 0 OR o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01'")
def cache_live(spark, sf_dir):
    expires = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(days=F.lit(30)))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cache_key"), expires.alias("expires_at"))
    return tables.live_cache(rows, F.lit("1997-01-01").cast("timestamp_ntz")).select("cache_key")


@query("SELECT c_custkey AS id, c_name AS title, c_mktsegment AS description_raw, 'manual' AS source, 'draft' AS status FROM customer")
def job_create(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("t").alias("tenant_id"), F.lit("u").alias("created_by"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"))
    return tables.create_jobs(rows).select("id", "title", "description_raw", "source", "status")


@query("SELECT doc_id AS id, sha256(text) AS sha, 'upload' AS source FROM documents WHERE doc_id % 3 > 0 AND text <> ''")
def job_upload(spark, sf_dir):
    """Every third upload is of a type without a reader, and empty ones are refused; these give no job."""
    from quillsift.sources import documents

    files = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("t").alias("tenant_id"), F.lit("u").alias("created_by"), F.lit("Title").alias("title"), F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 3 == 0, documents.PDF).otherwise(documents.TEXT).alias("media_type"))
    refused = documents.upload_violation(F.col("content"), F.col("media_type"), (documents.PDF, documents.DOCX, documents.TEXT))
    jobs, _ = tables.create_jobs_from_uploads(documents.parse(files.filter(refused.isNull())))
    return jobs.select("id", tx.sha256(F.col("description_raw")).alias("sha"), "source")


# --- chunks: a line item is a chunk, the first of an order the parent of the others --------------


def _chunks(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    parent = F.when(F.col("n") > 1, F.concat_ws(":", F.col("l_orderkey").cast("string"), F.lit("1")))
    rows = load(spark, sf_dir, "lineitem").withColumn("n", n)
    return rows.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("chunk_id"), parent.alias("parent_chunk_id"), F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("document_id"), F.col("l_orderkey").alias("resume_version_id"),
        (F.col("n") - 1).alias("chunk_index"), F.col("l_linestatus").alias("section"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("content"), (F.col("n") == 1).alias("is_parent"),
    )


_CHUNKS = """c AS (SELECT *, CAST(l_orderkey AS VARCHAR) || ':' || CAST(n AS VARCHAR) AS chunk_id, n = 1 AS is_parent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem))"""


@query(f"WITH {_CHUNKS} SELECT a.chunk_id, 'c' || CAST(b.l_partkey AS VARCHAR) AS parent_content FROM c a LEFT JOIN c b ON a.l_orderkey = b.l_orderkey AND b.n = 1 AND a.n > 1")
def parent_expansion(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return retrieval.parents_of(chunks.select("chunk_id"), chunks).select("chunk_id", "parent_content")


@query(f"WITH {_CHUNKS} SELECT chunk_id, n - 1 AS place FROM c WHERE n > 1 AND n <= 4 UNION ALL SELECT chunk_id, n - 1 FROM c WHERE n = 1")
def capped_children(spark, sf_dir):
    return chunking.cap_children(_chunks(spark, sf_dir), 3).select("chunk_id", F.col("chunk_index").cast("long").alias("place"))


@query(f"WITH {_CHUNKS} SELECT l_orderkey AS resume_version_id, COUNT(*) FILTER (n = 1) AS parents, COUNT(*) FILTER (n > 1) AS children, COUNT(DISTINCT l_linestatus) AS sections FROM c GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return chunking.chunk_counts(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT l_orderkey AS document_id, string_agg('c' || CAST(l_partkey AS VARCHAR), ' ' ORDER BY n) AS query FROM c WHERE n > 1 AND n <= 6 GROUP BY 1")
def representative_texts(spark, sf_dir):
    return retrieval.representative_text(_chunks(spark, sf_dir)).select("document_id", "query")


@query(f"WITH {_CHUNKS} SELECT chunk_id, l_linestatus AS section FROM c WHERE n > 1")
def children_by_parent_link(spark, sf_dir):
    return retrieval.children(_chunks(spark, sf_dir)).select("chunk_id", "section")


@query(
    """SELECT o_custkey AS id, CAST(COUNT(*) AS INTEGER) AS versions, MAX(o_orderkey) AS newest FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def documents_with_versions(spark, sf_dir):
    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("t").alias("tenant_id"))
    numbered = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    versions = load(spark, sf_dir, "orders").filter("o_custkey % 3 > 0").select(F.lit("t").alias("tenant_id"), F.col("o_custkey").alias("document_id"), numbered.alias("version"), F.col("o_orderkey").alias("text"))
    made = catalog.with_versions(docs, versions)
    return made.select("id", F.when(F.col("versions").isNotNull(), F.size("versions")).alias("versions"), F.element_at("versions", -1)["text"].alias("newest"))


# --- retrieval -----------------------------------------------------------------------------------


def _hits(spark, sf_dir):
    """An order as a query, its line items as hits by falling price."""
    hits = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("chunk_id"), F.col("l_suppkey").alias("document_id"), F.col("l_extendedprice").cast("double").alias("score"))
    return retrieval.ranked(hits)


_HITS = "h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT l_orderkey AS query_id, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) AS chunk_id, l_suppkey AS document_id, CAST(l_extendedprice AS DOUBLE) AS score, l_partkey FROM lineitem))"


@query(
    f"""WITH {_HITS}, m AS (SELECT query_id, chunk_id, rank, l_partkey % 97 AS s, MAX(CASE WHEN query_id % 5 = 0 AND rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS failed FROM h),
    s AS (SELECT query_id, chunk_id, CASE WHEN failed = 1 THEN 1.0 / rank ELSE CAST(s AS DOUBLE) END AS score FROM m)
    SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3"""
)
def rerank_model_scores(spark, sf_dir):
    """A model's scores by table; of every fifth query one is missing, so it keeps its order."""
    hits = _hits(spark, sf_dir)
    part = F.split("chunk_id", ":")[2].cast("long")
    scores = hits.filter(~((F.col("query_id") % 5 == 0) & (F.col("rank") == 1))).select("query_id", "chunk_id", (part % 97).cast("double").alias("model_score"))
    return retrieval.rerank(hits, scores, 3).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(
    f"""WITH {_HITS}, s AS (SELECT query_id, chunk_id, rank AS was, query_id % 5 = 0 AS degraded, CASE WHEN query_id % 5 = 0 THEN 1.0 / rank ELSE CAST(l_partkey % 97 AS DOUBLE) END AS score FROM h)
    SELECT query_id, chunk_id, round(score, 9) AS score, degraded, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM s) WHERE rank <= 2"""
)
def rerank_port(spark, sf_dir):
    """A reranker that fails for every fifth query."""

    def model(asked: str, texts: list[str]) -> list[float]:
        if int(asked) % 5 == 0:
            raise TimeoutError(asked)
        return [float(int(t) % 97) for t in texts]

    hits = _hits(spark, sf_dir)
    queries = hits.select("query_id", F.col("query_id").cast("string").alias("query")).distinct()
    chunks = hits.select("chunk_id", F.split("chunk_id", ":")[2].alias("content"))
    return retrieval.rerank_with(hits, queries, chunks, model, 2).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "degraded", "rank")


@query(f"WITH {_HITS} SELECT query_id, CAST(4 AS INTEGER) AS initial, COUNT(*) FILTER (rank <= 4) AS after_recall, COUNT(*) FILTER (rank <= 2) AS after_rerank, COUNT(*) FILTER (rank <= 1) AS final FROM h GROUP BY 1")
def funnel_counts(spark, sf_dir):
    return catalog.funnel(_hits(spark, sf_dir), 4, 2, 1)


@query(f"WITH {_HITS} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 3 AND document_id <> query_id % 10")
def source_excluded(spark, sf_dir):
    """The source's own hits go after the cutoff, so they use up places of it."""
    return search.without_source(_hits(spark, sf_dir).filter("rank <= 3"), F.col("query_id") % 10).select("query_id", "chunk_id", "rank")


@query(
    r"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE doc_id % 2 = 0),
    q AS (SELECT item_id, term, COUNT(*) OVER (PARTITION BY item_id) AS n FROM (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark))
    SELECT item_id AS query_id, doc_id AS chunk_id FROM (SELECT item_id, doc_id, n, COUNT(*) AS m FROM q JOIN t USING (term) GROUP BY ALL) WHERE m = n"""
)
def section_filter(spark, sf_dir):
    """Lexical matches in chunks of one section only."""
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("t").alias("tenant_id"), F.col("text").alias("query"))
    section = F.when(F.col("doc_id") % 2 == 0, "skills").otherwise("summary")
    chunks = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), section.alias("section"))
    within = search.of_sections(chunks, ["skills"])
    return retrieval.lexical_matches(asked, retrieval.postings(within, queries=asked)).select("query_id", "chunk_id")


@query("SELECT doc_id AS id, MIN(doc_id) OVER (PARTITION BY source, text) AS document_id, MIN(doc_id) OVER (PARTITION BY source, text) = doc_id AS is_new FROM documents")
def ingest_resume(spark, sf_dir):
    arrivals = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("arrival"), F.col("source").alias("tenant_id"), tx.sha256(F.col("text")).alias("sha256"))
    return ingest.dedup(arrivals).select("id", "document_id", "is_new")


# --- tasks and streams ---------------------------------------------------------------------------


@query("SELECT user_id AS run_id, event_id AS ordinal, ROW_NUMBER() OVER (ORDER BY user_id, event_type, event_id) AS id, 'pending' AS status FROM events")
def task_enqueue(spark, sf_dir):
    payloads = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("ordinal"))
    return limits.enqueue(payloads).select("run_id", "ordinal", "id", "status")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'claimed' END AS status, CASE WHEN event_id % 3 = 1 THEN 'boom' END AS error FROM events")
def task_finish(spark, sf_dir):
    tasks = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("claimed").alias("status"))
    given = tasks.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "{}").alias("result"), F.when(F.col("id") % 3 == 1, "boom").alias("error"))
    return limits.finish(tasks, given).select("id", "status", "error")


@query("SELECT user_id AS run_id, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS last_stage, MAX(ts) AS heartbeat_at FROM events GROUP BY 1")
def task_heartbeats(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    old = events.filter("event_id % 2 = 0").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("last_stage"), F.col("ts").alias("heartbeat_at"))
    return limits.beat(old, events.filter("event_id % 2 = 1").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at")))


@query("SELECT user_id AS run_id FROM (SELECT user_id, MAX(ts) AS t FROM events GROUP BY 1) WHERE t < TIMESTAMP '2024-01-25' - INTERVAL 3600 SECOND")
def stale_runs(spark, sf_dir):
    beats = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("heartbeat_at"))
    return limits.stale_runs(beats, F.lit("2024-01-25").cast("timestamp_ntz"), 3600)


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'bad' END AS error FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 120")
def task_drain(spark, sf_dir):
    """Three rounds of forty tasks."""
    tasks = load(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("timestamp_ntz").alias("not_before"))
    work = lambda taken: taken.select("id", F.lit("{}").alias("result"), F.when(F.col("id") % 4 == 0, "bad").alias("error"))
    return limits.drain(tasks, work, F.lit("2024-01-01").cast("timestamp_ntz"), 3, 40)[0].select("id", "error")


@query(
    """WITH r AS (SELECT user_id, event_type, event_id, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n, event_id % 11 = 0 AS failed FROM events),
    f AS (SELECT user_id, event_type, MIN(n // 4) AS w FROM r WHERE failed AND event_type = 'click' GROUP BY ALL)
    SELECT user_id AS run_id, event_id AS task, CASE WHEN n // 4 > w THEN 'cancelled' WHEN failed THEN 'failed' ELSE 'ok' END AS status FROM r LEFT JOIN f USING (user_id, event_type)"""
)
def stage_cancellation(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    results = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), n.alias("ordinal"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"), F.col("event_id").alias("task"))
    return limits.cancel_siblings(results, ["click"], 4).select("run_id", "task", "status")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 2 DAY END AS read_at FROM events),
    n AS (SELECT a.user_id, a.event_id, (SELECT COUNT(*) FROM e b WHERE b.user_id = a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id)) - (SELECT COUNT(*) FROM e b WHERE b.user_id = a.user_id AND b.read_at <= a.ts) AS waiting FROM e a)
    SELECT user_id AS run_id, event_id, waiting >= 6 AS dropped FROM n"""
)
def stream_capacity(spark, sf_dir):
    """A run's queue of six events; a third are never read, the others after two days."""
    events = load(spark, sf_dir, "events").withColumn("read_at", F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.make_interval(days=F.lit(2))))
    return limits.within_capacity(events.withColumnRenamed("user_id", "run_id"), "run_id", ["ts", "event_id"], "read_at", 6).select("run_id", "event_id", "dropped")


@query("SELECT o_custkey AS request_id, arg_min(o_orderkey, o_orderkey) FILTER (o_orderkey % 4 = 0) AS api_key FROM orders GROUP BY 1")
def first_free_key(spark, sf_dir):
    waits = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("api_key"), (F.col("o_orderkey") % 4).cast("double").alias("wait"))
    return limits.first_free_key(waits)


@query("SELECT run_id, event_id, CAST(greatest(0, COALESCE(ceil((epoch(lead(ts) OVER w) - epoch(ts)) / 3600.0) - 1, 0)) AS BIGINT) AS beats FROM (SELECT user_id AS run_id, event_id, ts FROM events) WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)")
def stream_heartbeats(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.heartbeats(events, "run_id", "at", "event_id", 3600.0).select("run_id", "event_id", "beats")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '{"recommendation":"hold","narrative":"' || c_name || '","confidence":0.5}' END AS output, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS warnings FROM customer"""
)
def insight_agents(spark, sf_dir):
    """The recommendation agent with a provider that never answers some with JSON."""

    def provider(prompt: str) -> str:
        name = prompt.split("score_json:\n")[1].split("\n")[0]
        return "{ this is no JSON }" if int(name.split("#")[1]) % 4 == 0 else '{"recommendation": "hold", "narrative": "%s", "confidence": 0.5}' % name

    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("score_json"), *[F.lit("[]").alias(c) for c in agents.INSIGHTS[3].inputs[1:]])
    return agents.insight(rows, agents.INSIGHTS[3], provider).select("c_custkey", "result.status", "result.output", F.size("result.warnings").alias("warnings"))


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR t = '' THEN 'blank' WHEN length(t) > 3000 THEN 'too_long' END AS violation,
    CASE WHEN doc_id % 5 > 0 AND t <> '' AND length(t) <= 3000 THEN sha256('Position: Title' || chr(10) || chr(10) || '<job_description>' || chr(10) || replace(t, '</job_description>', '&lt;/job_description&gt;') || chr(10) || '</job_description>' || chr(10) || chr(10) || 'List what this description requires, as a JSON object.') END AS sha
    FROM (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN '</job_description>' ELSE ' ' END, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM documents)""".replace("\\\\", "\\")
)
def job_prompts(spark, sf_dir):
    """Descriptions, some with a forged end of their block."""
    forged = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "</job_description>").otherwise(" "))
    made = load(spark, sf_dir, "documents").withColumn("p", agents.job_prompt(F.lit("Title"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(forged), 3000))
    return made.select("doc_id", "p.violation", tx.sha256(F.col("p.prompt")).alias("sha"))


@query(
    r"""SELECT doc_id, CASE WHEN t = '' THEN 'blank' END AS violation, CASE WHEN t <> '' THEN sha256('<candidate_document>' || chr(10) || substring(replace(t, '</candidate_document>', '&lt;/candidate_document&gt;'), 1, 50000) || chr(10) || '</candidate_document>' || chr(10) || chr(10) || 'Return this person''s profile as a JSON object.') END AS sha
    FROM (SELECT doc_id, regexp_replace(COALESCE(text, ''), '^[\s]+|[\s]+$', '', 'g') AS t FROM documents)"""
)
def extraction_prompts(spark, sf_dir):
    made = load(spark, sf_dir, "documents").withColumn("p", agents.extraction_prompt(F.coalesce("text", F.lit(""))))
    return made.select("doc_id", "p.violation", tx.sha256(F.col("p.prompt")).alias("sha"))
