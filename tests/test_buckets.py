"""Changes of bucketed tables against plain Python, and which files they touch."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillsift.sources.buckets import Buckets, create

SCHEMA = "tenant_id string, document_id long, chunk_id string, at long, body string"


def files(path):
    return {d: {f: os.stat(f"{path}/{d}/{f}").st_ino for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [("tu"[d % 2], d, f"{d}:{k}", k, f"body {k}") for d in range(40) for k in range(3)]
    path = str(tmp_path / "table")
    create(spark.createDataFrame(rows, SCHEMA), path, ["tenant_id", "document_id"], 16)
    return Buckets(spark, path, SCHEMA, ["tenant_id", "document_id"], 16), {r[2]: r for r in rows}, path


def same(table, rows):
    assert {r.chunk_id: tuple(r) for r in table.read().collect()} == rows and table.read().count() == len(rows)


def unchanged(before, after, numbers):
    """Buckets that weren't touched have the same files, of the same names."""
    assert len(numbers) < 16
    for name in before:
        if int(name.split("=")[1]) not in numbers:
            assert after[name] == before[name]


def test_delete_touches_its_buckets_only(spark, table):
    stored, rows, path = table
    before = files(path)
    gone = spark.createDataFrame([("t", 4), ("u", 7), ("t", 999)], "tenant_id string, document_id long")
    numbers = stored.delete(gone)
    same(stored, {k: r for k, r in rows.items() if (r[0], r[1]) not in {("t", 4), ("u", 7)}})
    unchanged(before, files(path), numbers)
    # All rows of a bucket: its folder goes.
    whole = spark.createDataFrame([(t, d) for t, d in {(r[0], r[1]) for r in rows.values()}], "tenant_id string, document_id long")
    one = stored.touched(whole)[0]
    left = {(r.tenant_id, r.document_id) for r in stored.read().collect()}
    from quillsift.sources.buckets import bucket_of

    of_one = whole.filter(bucket_of(["tenant_id", "document_id"], 16) == one)
    assert stored.delete(of_one) == [one] and f"bucket={one}" not in files(path)
    assert {(r.tenant_id, r.document_id) for r in stored.read().collect()} == left - {(r.tenant_id, r.document_id) for r in of_one.collect()}
    assert stored.delete(whole.limit(0)) == []


def test_replace_set_and_upsert(spark, table):
    stored, rows, path = table
    before = files(path)
    new = [("t", 2, "2:9", 9, "new"), ("v", 77, "77:0", 0, "first")]
    numbers = stored.replace_set(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([("u", 5)], "tenant_id string, document_id long"))
    wanted = {k: r for k, r in rows.items() if (r[0], r[1]) not in {("t", 2), ("u", 5)}} | {r[2]: r for r in new}
    same(stored, wanted)
    unchanged(before, files(path), numbers)
    before = files(path)
    changed = [("t", 6, "6:1", 50, "later"), ("t", 6, "6:2", 0, "earlier"), ("t", 6, "6:3", 1, "added")]
    numbers = stored.upsert(spark.createDataFrame(changed, SCHEMA), "chunk_id", "at")
    same(stored, wanted | {r[2]: r for r in changed if r[2] != "6:2"})
    unchanged(before, files(path), numbers)


def test_a_failed_change_leaves_all(spark, table):
    stored, rows, path = table
    before = files(path)
    bad = spark.createDataFrame([("t", 2, "2:0", 1, "x")], SCHEMA).withColumn("body", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        stored.replace_set(bad)
    assert files(path) == before
    same(stored, rows)
