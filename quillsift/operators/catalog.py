"""Reads over stored tables: pages of listings, latest versions, counts, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 200


def keyset_page(df: DataFrame, time: str, key: str, limit: int, before: tuple | None = None) -> DataFrame:
    """The newest rows, ties by falling key, after the cursor ``(time, key)``.

    The cursor has the key as well, so rows that share an instant aren't
    skipped between pages.  At most MOST rows; only the top rows of each
    partition are compared.
    """
    if before is not None:
        t, k = before
        df = df.filter((F.col(time) < F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(key) < F.lit(k))))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(max(1, min(limit, MOST)))


def next_cursor(page: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """One row: the last row's cursor if the page is full, nulls if it is the last one."""
    last = page.agg(F.count("*").alias("_n"), F.min(F.struct(time, key)).alias("_last"))
    full = F.col("_n") >= limit
    return last.select(F.when(full, F.col(f"_last.{time}")).alias(time), F.when(full, F.col(f"_last.{key}")).alias(key))


def latest(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """For each group the row with the highest ``order``, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])
    return df.groupBy(*by).agg(F.max(row).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def counts(df: DataFrame, by: str = "tenant_id") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("rows"))


def of_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of ids; an empty one gives none."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def existing(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``ids`` with ``found``: whether the table has a row."""
    return ids.join(df.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``documents`` with an array of their versions, by number."""
    fields = [c for c in versions.columns if c not in ("document_id", "tenant_id")]
    grouped = versions.groupBy("tenant_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("version", *[c for c in fields if c != "version"]))).alias("versions"))
    return documents.join(grouped.withColumnRenamed("document_id", "id"), ["tenant_id", "id"], "left")


def allowed(roles: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(roles, F.array(*[F.lit(r) for r in wanted]))


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """``labels, count, total`` and a cumulative count for each upper bound."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(*labels).agg(F.count("*").alias("count"), F.round(F.sum(value), 4).alias("total"), *buckets)


def funnel(hits: DataFrame, recall: int = 200, rerank: int = 120, output: int = 60) -> DataFrame:
    """``query_id, initial, after_recall, after_rerank, final``: what each cutoff of the funnel leaves of a ranked list."""
    at = lambda k: F.count_if(F.col("rank") <= k).alias
    return hits.groupBy("query_id").agg(F.lit(recall).alias("initial"), at(recall)("after_recall"), at(rerank)("after_rerank"), at(output)("final"))
