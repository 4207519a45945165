"""Directories of extendible hashing over tables.

A directory starts as one bucket; only buckets over their limit split, each on
its next hash bit, until all are within the limit or out of bits.  Weights of
prefixes come from distributed sums; the directory itself is a table of slots
(prefix -> depth of its bucket) that is doubled only where buckets are still
over the limit, so one deep bucket doesn't blow it up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import frozen

#: Hash bits there are.
BITS = 32
#: Bits by which the directory is doubled beyond what evenly spread weights need, and in each later round.
SLACK = 4
ROUND = 8
#: Tiers of at most so many bits (16 MB of slots) are broadcast; larger ones are joined by shuffle.
BROADCAST_BITS = 20


def leading_bits(hex_digest: Column) -> Column:
    """The first 32 bits of a hex digest, as a long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int, of: int = BITS) -> Column:
    """The first ``depth`` of ``of`` bits."""
    if isinstance(depth, int):
        return F.shiftright(bits, of - depth)
    return F.call_function("shiftright", bits, (F.lit(of) - depth).cast("int"))


@dataclass
class Directory:
    """Slots by tier: a slot (prefix of ``top`` bits) leads to a bucket of ``depth`` bits, or to the next tier if depth is null."""

    tiers: list[tuple[int, DataFrame]]

    def route(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a long ``bits``) with ``depth`` and ``prefix`` of the bucket of each; rows of hash bits unknown to the directory are dropped."""
        settled, left = [], rows
        for top, slots in self.tiers:
            few = F.broadcast(slots) if top <= BROADCAST_BITS else slots
            found = left.join(few, prefix(F.col("bits"), top) == F.col("slot")).drop("slot")
            settled.append(found.filter("depth is not null"))
            left = found.filter("depth is null").drop("depth")
        if self.tiers[-1][0] == BITS:
            settled.append(left.withColumn("depth", F.lit(BITS)))
        out = settled[0]
        for more in settled[1:]:
            out = out.unionByName(more)
        return out.withColumn("prefix", prefix(F.col("bits"), F.col("depth")))


def build(entries: DataFrame, limit: int, weight: str) -> Directory:
    """The directory over ``entries`` (with a long ``bits`` and a weight each).

    A bucket is the shallowest prefix whose weight is within ``limit``; one
    that is over it at 32 bits stays as it is (its keys collide).  Keys spread
    evenly are settled in the first round; only entries of buckets still over
    the limit take part in further rounds.
    """
    total = entries.agg(F.sum(weight)).first()[0] or 0
    base, top = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    tiers, left = [], entries
    while True:
        slots = frozen(left.groupBy(prefix(F.col("bits"), top).alias("slot")).agg(F.sum(weight).alias("w")))
        depths = slots.select("slot", "w", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        above = depths.withColumn("prefix", prefix(F.col("slot"), F.col("depth"), top))
        sums = above.groupBy("depth", "prefix").agg(F.sum("w").alias("sum"))
        fit = above.join(sums, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.when(F.col("sum") <= limit, F.col("depth"))).alias("depth"))
        fit = frozen(fit)
        tiers.append((top, fit))
        over = fit.filter("depth is null").select("slot")
        if top == BITS or over.isEmpty():
            return Directory(tiers)
        left = frozen(left.join(over, prefix(F.col("bits"), top) == over["slot"], "left_semi"))
        base, top = top + 1, min(BITS, top + ROUND)


def bucket_name(depth: Column, value: Column) -> Column:
    """The bucket's hash bits as text; the whole table's is empty."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, F.lit("0")))
