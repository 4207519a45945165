"""Table scans scoped to a tenant, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scoped(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; a foreign row reads as absent."""
    return df.filter(F.col(column) == F.lit(tenant))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that come more than once, with their count: violations of a unique key."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def without_document(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks that are left when the documents ``tenant_id, document_id`` are deleted."""
    return chunks.join(removed.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_anti")


def deleted_counts(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks that the deletion of documents takes away, by document."""
    return chunks.join(removed.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_semi").groupBy("tenant_id", "document_id").agg(F.count("*").alias("deleted"))


def replace_set(table: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """``table`` with all rows of the owners that ``rows`` names replaced by ``rows``."""
    kept = table.join(rows.select(owner).distinct(), owner, "left_anti").select(*table.columns)
    return kept.unionByName(rows.select(*table.columns))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write so that only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` and ``rows`` with one row per key, the latest by ``order`` (null is the oldest); of equal ones, that of ``rows``.

    Each task reduces its keys before the shuffle.
    """
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order), F.col("_new")))
    return both.groupBy(key).agg(latest.alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in table.columns])


def live_cache(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that haven't expired at ``now``."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def object_key(tenant: Column, digest: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("tenants"), tenant, F.lit("resumes"), digest, name)


def create_jobs(sources: DataFrame, source: str = "manual") -> DataFrame:
    """Draft jobs from ``sources`` (id, tenant_id, created_by, title, text; other columns that jobs have are kept).

    The text becomes the raw description as it is: job descriptions, unlike
    résumés, aren't sanitized.
    """
    optional = [F.col(c) if c in sources.columns else F.lit(None).cast("string").alias(c) for c in ("department", "location", "employment_type", "seniority")]
    return sources.select("id", "tenant_id", "created_by", "title", F.col("text").alias("description_raw"), *optional, F.lit(source).alias("source"), F.lit("draft").alias("status"))


def create_jobs_from_uploads(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs from parsed files (id, tenant_id, created_by, title, ``parsed``, ``error``), and the files that gave none."""
    read = parsed.filter("error is null").withColumn("text", F.col("parsed.text"))
    return create_jobs(read, "upload"), parsed.filter("error is not null").select("id", "tenant_id", "error")
