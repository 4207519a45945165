"""Membership filters: no key is lost, few are let through, filters of different sizes merge."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillsift.operators import ingest, membership


def keys(spark, tenant, numbers):
    return spark.createDataFrame([(tenant, hashlib.sha256(str(n).encode()).hexdigest()) for n in numbers], "tenant_id string, sha256 string")


@pytest.mark.parametrize("shard", [100_000, 64])
def test_filters_lose_nothing(spark, monkeypatch, shard):
    monkeypatch.setattr(membership, "SHARD_KEYS", shard)
    monkeypatch.setattr(membership, "TASK_KEYS", 150)
    big, small = keys(spark, "t", range(900)).unionByName(keys(spark, "u", range(40))), keys(spark, "t", range(5000, 5030))
    filters = membership.merge(membership.build(big), membership.build(small))
    if shard == 64:
        assert filters.filter("tenant_id = 't'").count() == 16
    asked = keys(spark, "t", range(20_000)).unionByName(keys(spark, "u", range(300))).unionByName(keys(spark, "v", range(50)))
    got = {(r.tenant_id, r.sha256) for r in membership.likely(asked, filters).collect()}
    held = {(r.tenant_id, r.sha256) for r in big.unionByName(small).collect()}
    assert held <= got and len(got) - len(held) < 0.02 * 20_000 and not any(t == "v" for t, _ in got)
    assert membership.merge(filters, membership.build(big.limit(0))).count() == filters.count()


def test_filtered_dedup_equals_dedup(spark):
    """With hot arrivals; of the store, about the rows that arrive again are shuffled."""
    row = lambda i, n, t: (i, i, t, hashlib.sha256(str(n).encode()).hexdigest())
    schema = "id long, arrival long, tenant_id string, sha256 string"
    stored = spark.createDataFrame([row(i, i % 700, "tu"[i % 2]) for i in range(1000)], schema)
    arrivals = spark.createDataFrame([row(2000 + i, 7 if i % 3 == 0 else 650 + i, "tuv"[i % 3 if i % 5 else 0]) for i in range(1500)], schema)
    filters = membership.build(stored)
    rows = lambda df: sorted(df.select("id", "document_id", "is_new").collect())
    assert rows(membership.dedup(arrivals, stored, filters)) == rows(ingest.dedup(arrivals, stored))
    again = arrivals.join(stored, ["tenant_id", "sha256"], "left_semi").select("tenant_id", "sha256").distinct().count()
    assert again <= membership.likely(arrivals, filters).count() <= again + 0.01 * 1500
    none = membership.dedup(arrivals.filter(F.lit(False)), stored, filters)
    assert none.collect() == []
