"""Membership filters of stored content: which arrivals can't be there yet, without reading the store.

A tenant has a Bloom filter per shard of its keys, kept as a table beside the
store.  Numbers of shards and of bits are powers of two, so filters of any two
sizes merge: the smaller is repeated to the larger one's size, which loses no
key.  Only arrivals that a filter lets through ask the store.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.operators.skew import meet

#: Keys of a shard, bits for each key, and bits set for each.
SHARD_KEYS = 100_000
BITS, HASHES = 16, 8
#: Keys of a batch that one task holds against a filter.
TASK_KEYS = 1_000_000
#: Small tables are broadcast up to so many rows.
FEW = 200_000
FILTER = "tenant_id string, shard bigint, shards bigint, bits binary"


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, a power of two."""
    steps = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (first.astype(np.uint64)[:, None] + steps * (second.astype(np.uint64)[:, None] | np.uint64(1))) & np.uint64(size - 1)


def _hashed(rows: DataFrame, digest: str) -> DataFrame:
    return rows.select("tenant_id", digest).distinct().withColumns({"_h": F.xxhash64(digest), "_g": F.xxhash64(digest, F.lit(1))})


def _power(count: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.ceil(F.log2(count))).cast("int"))


def build(stored: DataFrame, digest: str = "sha256") -> DataFrame:
    """The filters of ``stored`` (tenant_id, digest): ``tenant_id, shard, shards, bits``; a task holds the keys of one shard."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        size = max(64, 1 << (BITS * len(group) - 1).bit_length())
        bits = np.zeros(size, dtype=bool)
        bits[_places(group["_h"].to_numpy(), group["_g"].to_numpy(), size).ravel()] = True
        return pd.DataFrame({"tenant_id": [group["tenant_id"].iloc[0]], "shard": [group["_shard"].iloc[0]], "shards": [group["_shards"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    keys = _hashed(stored, digest)
    shards = keys.groupBy("tenant_id").agg(_power(F.count("*") / SHARD_KEYS).alias("_shards"))
    placed = keys.join(shards, "tenant_id").withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))
    return placed.groupBy("tenant_id", "_shard").applyInPandas(one, FILTER)


def merge(filters: DataFrame, more: DataFrame) -> DataFrame:
    """The filters of what either holds."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint8) for b in group["bits"]]
        out = np.zeros(max(map(len, parts)), np.uint8)
        for part in parts:
            out |= np.tile(part, len(out) // len(part))
        return pd.DataFrame({"tenant_id": [group["tenant_id"].iloc[0]], "shard": [group["shard"].iloc[0]], "shards": [group["shards"].iloc[0]], "bits": [out.tobytes()]})

    both = filters.unionByName(more)
    most = both.groupBy("tenant_id").agg(F.max("shards").alias("_most"))
    # A filter of few shards stands in each of the shards that its own falls into.
    spread = both.join(most, "tenant_id").withColumn("shard", F.explode(F.sequence(F.col("shard"), F.col("_most") - 1, F.col("shards")))).withColumn("shards", F.col("_most")).drop("_most")
    return spread.groupBy("tenant_id", "shard").applyInPandas(one, FILTER)


def likely(keys: DataFrame, filters: DataFrame, digest: str = "sha256") -> DataFrame:
    """``tenant_id, digest`` of the distinct keys that the store may have; keys that it has are always among them."""
    shards = filters.select("tenant_id", "shards").distinct()
    found = _hashed(keys, digest)
    # Many keys of a small store are dealt to several tasks, with the filter in each.
    parts = found.groupBy("tenant_id").agg(F.count("*").alias("_n")).join(shards, "tenant_id").select("tenant_id", "shards", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("shards") / TASK_KEYS)).alias("_parts"))
    asked = found.join(parts, "tenant_id").select("tenant_id", digest, "_h", "_g", F.pmod(F.col("_h"), F.col("shards")).alias("shard"), F.pmod(F.col("_g"), F.col("_parts")).alias("_part"))
    held = filters.join(parts.select("tenant_id", "_parts"), "tenant_id").select("tenant_id", "shard", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))

    def passed(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return asked.iloc[:0][["tenant_id", digest]]
        bits = np.frombuffer(held["bits"].iloc[0], np.uint8)
        at = _places(asked["_h"].to_numpy(), asked["_g"].to_numpy(), 8 * len(bits))
        return asked.loc[((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1), ["tenant_id", digest]]

    on = ("tenant_id", "shard", "_part")
    return asked.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(passed, f"tenant_id string, {digest} string")


def dedup(arrivals: DataFrame, stored: DataFrame, filters: DataFrame, digest: str = "sha256", order: str = "arrival") -> DataFrame:
    """What ``ingest.dedup`` gives, but of the store only rows of likely keys are shuffled.

    Few likely keys are broadcast to the store's scan; the count of a much
    repeated arrival is reduced before its rows meet it.
    """
    first = arrivals.groupBy("tenant_id", digest).agg(F.min(F.struct(F.col(order).alias("o"), F.col("id").alias("id"))).alias("_first"), F.count("*").alias("_n"))
    asked = likely(first.select("tenant_id", digest), filters, digest)
    few = F.broadcast(asked) if asked.count() <= FEW else asked
    known = stored.select("tenant_id", F.col("sha256").alias(digest), "id").join(few, ["tenant_id", digest], "left_semi").groupBy("tenant_id", digest).agg(F.min("id").alias("_stored"))
    both = meet(arrivals, first.join(known, ["tenant_id", digest], "left"), ["tenant_id", digest], "_n")
    new = F.col("_stored").isNull() & (F.col("id") == F.col("_first.id"))
    return both.withColumn("document_id", F.coalesce("_stored", "_first.id")).withColumn("is_new", new).drop("_first", "_stored", "_n")
