"""Views that show no row without a tenant, and only the tenant's with one."""

from __future__ import annotations

import pytest

from quillsift.sources import tenants


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_need_a_tenant(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.createDataFrame([("t", 1), ("t", 2), ("u", 3), (None, 4)], "tenant_id string, chunk_id int").write.parquet(path)
    tenants.publish(spark, {"own_chunks": path})
    ids = lambda sql, **args: sorted(r.chunk_id for r in spark.sql(sql, args=args).collect())
    assert ids("SELECT chunk_id FROM own_chunks") == []
    tenants.act_for(spark, "t")
    assert ids("SELECT chunk_id FROM own_chunks") == [1, 2] and ids("SELECT chunk_id FROM own_chunks WHERE tenant_id = 'u' OR true") == [1, 2]
    assert "EqualTo(tenant_id,t)" in plan(spark.sql("SELECT chunk_id FROM own_chunks"))
    tenants.act_for(spark, "x' OR 'a' = 'a")
    assert ids("SELECT chunk_id FROM own_chunks") == []
    tenants.act_for(spark, None)
    assert ids("SELECT chunk_id FROM own_chunks") == []
    assert ids("SELECT chunk_id FROM own_chunks_of(:t)", t="u") == [3] and ids("SELECT chunk_id FROM own_chunks_of(NULL)") == []
    assert "EqualTo(tenant_id,u)" in plan(spark.sql("SELECT chunk_id FROM own_chunks_of('u')"))
    with pytest.raises(ValueError):
        tenants.publish(spark, {"a; b": path})
