"""Maintenance of the chunk index from a stream of document versions.

Each micro-batch has a folder of its own under ``chunks`` and ``versions``,
named by its number, and overwrites it: a batch that runs again leaves what it
left before.  It is complete when its ``versions`` are there; readers take, of
each document, the chunks of the batch that has its highest version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsift.plans.search import index_versions
from quillsift.session import frozen

#: A batch's documents are broadcast to the list of stored versions up to so many.
FEW = 200_000
DOCUMENT = ["tenant_id", "document_id"]


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/versions") if _there(spark, f"{path}/versions") else None


def index_batch(batch: DataFrame, number: int, path: str, build: Callable[[DataFrame], DataFrame] = index_versions) -> None:
    """Index the documents of a batch whose version is above the stored one.

    Only versions stored by earlier batches count, so that a batch that runs
    again decides as it did before.  Of several versions of a document in the
    batch the highest is indexed.  A version in quarantine or without text has
    no chunks, and takes those of its document away.
    """
    spark, rest = batch.sparkSession, [c for c in batch.columns if c not in DOCUMENT]
    latest = batch.groupBy(*DOCUMENT).agg(F.max_by(F.struct(*rest), F.struct("version", "id")).alias("_r")).select(*DOCUMENT, *[F.col(f"_r.{c}").alias(c) for c in rest])
    stored = _versions(spark, path)
    if stored is not None:
        keys = frozen(latest.select(*DOCUMENT))
        known = stored.filter(F.col("batch") < number).join(F.broadcast(keys) if keys.count() <= FEW else keys, DOCUMENT, "left_semi")
        latest = latest.join(known.groupBy(*DOCUMENT).agg(F.max("version").alias("_stored")), DOCUMENT, "left").filter(F.col("_stored").isNull() | (F.col("version") > F.col("_stored"))).drop("_stored")
    changed = frozen(latest)
    build(changed).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
    changed.select(*DOCUMENT, "version").write.mode("overwrite").parquet(f"{path}/versions/batch={number}")


def maintain(versions: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = index_versions) -> StreamingQuery:
    """Index all versions (id, tenant_id, document_id, version, extracted_text, page_offsets, quarantined) that a stream has now, and stop."""
    return versions.writeStream.foreachBatch(lambda batch, number: index_batch(batch, number, path, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The index: chunks of each document's highest version."""
    best = F.max_by("batch", F.struct("version", "batch"))
    live = spark.read.parquet(f"{path}/versions").groupBy(*DOCUMENT).agg(best.alias("batch"))
    return spark.read.parquet(f"{path}/chunks").join(live, [*DOCUMENT, "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the index as one batch to another folder, without chunks that aren't read any more; later batches go on there."""
    last = spark.read.parquet(f"{path}/versions").agg(F.max("batch")).first()[0]
    current(spark, path).write.mode("overwrite").parquet(f"{to}/chunks/batch={last}")
    spark.read.parquet(f"{path}/versions").groupBy(*DOCUMENT).agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{to}/versions/batch={last}")
