"""Tables in hash buckets of an owner, of which a change rewrites only the buckets it touches.

A bucket is a folder ``bucket=N``.  Changes find their buckets from the owners
they name, read those, and write their new rows to a scratch folder first;
then the table's folders are replaced, one rename each.  Other buckets' files
aren't touched, and a change that fails before the renames leaves all as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources import tables

#: Owners are broadcast to the rows of touched buckets up to so many.
FEW = 200_000


def bucket_of(owner: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*owner), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, owner: list[str], buckets: int) -> None:
    """Write a table in ``buckets`` by its owner's columns; large buckets are several files."""
    df.withColumn("bucket", bucket_of(owner, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


class Buckets:
    """A table written by ``create``, with the schema of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, owner: list[str], buckets: int):
        self.spark, self.path, self.owner, self.buckets = spark, path, owner, buckets
        self.schema = schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).drop("bucket")

    def touched(self, owners: DataFrame) -> list[int]:
        """The buckets of the owners; no more of them come to the driver than there are."""
        return sorted(r[0] for r in owners.select(bucket_of(self.owner, self.buckets).alias("b")).distinct().collect())

    def _of(self, numbers: list[int]) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return rows.filter(F.col("bucket").isin(numbers)).drop("bucket")

    def _replace(self, numbers: list[int], rows: DataFrame) -> list[int]:
        """Put ``rows`` in the place of the numbered buckets, and return these."""
        if not numbers:
            return numbers
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        # Names that begin with an underscore are no rows to readers.
        scratch = f"{self.path}/_change"
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        at = jvm.org.apache.hadoop.fs.Path
        rows.withColumn("bucket", bucket_of(self.owner, self.buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(scratch)
        for n in numbers:
            fs.delete(at(f"{self.path}/bucket={n}"), True)
            if fs.exists(at(f"{scratch}/bucket={n}")):
                fs.rename(at(f"{scratch}/bucket={n}"), at(f"{self.path}/bucket={n}"))
        fs.delete(at(scratch), True)
        self.spark.catalog.refreshByPath(self.path)
        return numbers

    def _without(self, rows: DataFrame, owners: DataFrame) -> DataFrame:
        gone = owners.select(*self.owner).distinct()
        return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, self.owner, "left_anti").select(*rows.columns)

    def delete(self, owners: DataFrame) -> list[int]:
        """Delete all rows of the owners; returns the buckets that were rewritten."""
        numbers = self.touched(owners)
        return self._replace(numbers, self._without(self._of(numbers), owners))

    def replace_set(self, rows: DataFrame, owners: DataFrame | None = None) -> list[int]:
        """Replace all rows of the owners (those of ``rows``, if none are given) by ``rows``."""
        named = rows.select(*self.owner) if owners is None else owners.select(*self.owner).unionByName(rows.select(*self.owner))
        numbers = self.touched(named)
        kept = self._without(self._of(numbers), named)
        return self._replace(numbers, kept.unionByName(rows.select(*kept.columns)))

    def upsert(self, rows: DataFrame, key: str, order: str) -> list[int]:
        """One row per key, the latest by ``order`` (see ``tables.upsert``); the key has to determine the owner."""
        numbers = self.touched(rows)
        return self._replace(numbers, tables.upsert(self._of(numbers), rows, key, order))
