"""Shards of bounded size by extendible hashing of document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.extendible import BITS, bucket_name, build, leading_bits
from quillsift.llm.shared import frozen


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards of at most ``limit`` bytes of text.

    Returns one row per document: ``doc_id, n_bytes, shard`` (the hash bits
    that its documents share), ``depth`` (how many), ``page``.  Shards are
    buckets of a directory over the MD5 of the id.  Documents that share all
    32 bits (repeated ids, null ids among them) can't be told apart by bits:
    where they are over the limit, they go to overflow pages of the bucket, as
    many rows to each as fit if all had the bucket's largest size.  A document
    over the limit is alone in its shard.  Null texts have no bytes; an empty
    table gives no rows; other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    ).withColumn("bits", leading_bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    sized = frozen(sized)
    dealt = frozen(build(sized, limit, "n_bytes").route(sized).withColumn("row", F.monotonically_increasing_id()))
    # Overflow pages, only for buckets out of bits: ranks from counts per partition, so a hot id isn't gathered.
    deep = dealt.filter(F.col("depth") == BITS).withColumn("part", F.shiftright("row", 33))
    bucket = deep.groupBy("prefix").agg(F.max("n_bytes").alias("largest"), F.sum("n_bytes").alias("all_bytes")).filter(F.col("all_bytes") > limit)
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), "largest")))
    counts = deep.groupBy("prefix", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("prefix", "part").orderBy("row")) - 1
    paged = (
        deep.join(counts.select("prefix", "part", before.alias("before")), ["prefix", "part"])
        .withColumn("rank", rank)
        .join(bucket.select("prefix", per_page.alias("per_page")), "prefix", "left")
        .withColumn("page", F.coalesce(F.floor(F.col("rank") / F.col("per_page")), F.lit(0)))
    )
    columns = ["doc_id", "n_bytes", bucket_name(F.col("depth"), F.col("prefix")).alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("page").cast("long").alias("page")]
    rest = dealt.filter(F.col("depth") < BITS).withColumn("page", F.lit(0))
    return rest.select(*columns).unionByName(paged.select(*columns))


def oracle(limit: int) -> str:
    """The same in SQL for distinct ids: a document's shard is its shallowest prefix within the limit."""
    return f"""
    WITH sized AS (
        SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes,
               CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS bits
        FROM documents
    ), prefixes AS (
        SELECT doc_id, n_bytes, d.depth, bits >> CAST(32 - d.depth AS INTEGER) AS prefix,
               SUM(n_bytes) OVER (PARTITION BY d.depth, bits >> CAST(32 - d.depth AS INTEGER)) AS bucket
        FROM sized, range(0, 33) AS d(depth)
    ), leaf AS (
        SELECT doc_id, n_bytes, COALESCE(MIN(CASE WHEN bucket <= {limit} THEN depth END), 32) AS depth
        FROM prefixes GROUP BY doc_id, n_bytes
    )
    SELECT l.doc_id, l.n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(p.prefix), CAST(l.depth AS INTEGER), '0') END AS shard,
           CAST(l.depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page
    FROM leaf l JOIN prefixes p ON p.doc_id = l.doc_id AND p.depth = l.depth
    """
