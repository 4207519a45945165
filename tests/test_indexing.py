"""The index that a stream maintains equals a full build, whatever ran again or broke off."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillsift.plans.search import index_versions
from quillsift.streaming import indexing

SCHEMA = "id string, tenant_id string, document_id long, version int, extracted_text string, page_offsets array<struct<page:int,start_char:int,end_char:int>>, quarantined boolean"


def written(spark, folder, rng, first, documents):
    """One file of versions: new documents, higher and lower versions of old ones, blanks and quarantine."""
    rows = []
    for _ in range(12):
        d, v = rng.randrange(documents), rng.randrange(1, 6)
        text = rng.choice(["Worked on payments.\nSkills\nPython, SQL.", "Led a team. " * 40, "", f"Version {v} of {d}."])
        rows.append((f"{d}-{v}", "tu"[d % 2], d, v, f"{text} {d} {v}" if text else text, None, rng.random() < 0.15))
    spark.createDataFrame(rows, SCHEMA).dropDuplicates(["id"]).coalesce(1).write.mode("append").parquet(folder)


def expected(spark, folder):
    """A full build over the highest version of each document."""
    rows = {}
    for r in spark.read.schema(SCHEMA).parquet(folder).orderBy("id").collect():
        key = (r.tenant_id, r.document_id)
        if key not in rows or r.version > rows[key].version:
            rows[key] = r
    return index_versions(spark.createDataFrame(list(rows.values()), SCHEMA))


def shown(df):
    return sorted(df.select("chunk_id", "tenant_id", "document_id", "content", "start_char", "is_parent", F.round(F.col("embedding")[0], 5)).collect(), key=str)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_full_build(spark, tmp_path):
    rng = random.Random(4)
    source, index, log = (str(tmp_path / x) for x in ("source", "index", "log"))
    for _ in range(2):
        # Texts of a document's version are the same wherever it comes again.
        written(spark, source, random.Random(7), 0, 8)
        written(spark, source, rng, 0, 8)
    once = {r.id: r for r in spark.read.schema(SCHEMA).parquet(source).orderBy("id", "extracted_text", "quarantined").collect()}
    files = str(tmp_path / "files")
    numbers = sorted(once)
    for part in (numbers[::3], numbers[1::3]):
        spark.createDataFrame([once[k] for k in part], SCHEMA).coalesce(1).write.mode("append").parquet(files)
    indexing.maintain(stream(spark, files), index, log).awaitTermination()
    assert shown(indexing.current(spark, index)) == shown(expected(spark, files))
    spark.createDataFrame([once[k] for k in numbers[2::3]], SCHEMA).coalesce(1).write.mode("append").parquet(files)

    def broken(changed):
        raise ValueError("the embedder is away")

    with pytest.raises(Exception, match="embedder is away"):
        indexing.maintain(stream(spark, files), index, log, broken).awaitTermination()
    before = shown(indexing.current(spark, index))
    indexing.maintain(stream(spark, files), index, log).awaitTermination()
    done = shown(indexing.current(spark, index))
    assert done == shown(expected(spark, files)) and done != before
    # As if the last batch's commit had been lost: it runs again and changes nothing.
    last = max(int(x) for x in os.listdir(f"{log}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{log}/commits/{name}"):
            os.remove(f"{log}/commits/{name}")
    indexing.maintain(stream(spark, files), index, log).awaitTermination()
    assert shown(indexing.current(spark, index)) == done
    assert spark.read.parquet(f"{index}/versions").groupBy("tenant_id", "document_id", "version").count().filter("count > 1").count() == 0
    indexing.compact(spark, index, str(tmp_path / "compact"))
    assert shown(indexing.current(spark, str(tmp_path / "compact"))) == done
    assert spark.read.parquet(f"{tmp_path}/compact/chunks").count() == len(done)
