from __future__ import annotations

import pytest

import corpus_pipeline
from quillsift.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, data):
    """Every stage takes what its predecessor left, and its decisions show."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, data).toPandas(), first.schema)
        assert after.columns == first.columns, name
        before_rows, after_rows = docs.collect(), after.collect()
        if name == "quality classifier":
            assert 0 < len(after_rows) < len(before_rows) and {r.doc_id for r in after_rows} <= {r.doc_id for r in before_rows}
            bad = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality == 0}
            good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality == 1}
            kept = {r.doc_id for r in after_rows}
            assert len(kept & good) >= 0.97 * len(good) and len(kept & bad) <= 0.15 * len(bad)
        elif name == "line dedup":
            assert len(after_rows) == len(before_rows) and all(r.n_chars == len(r.text) for r in after_rows)
            assert sum(len(r.text) for r in after_rows) < sum(len(r.text) for r in before_rows)
        elif name == "SimHash near-dedup":
            assert len({r.doc_id for r in after_rows}) == len(after_rows) < len(before_rows)
            assert len({" ".join(r.text.split()) for r in after_rows}) == len(after_rows)
        else:
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert abs(words(after_rows) - words(before_rows)) <= 0.2 * words(before_rows)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.filter("piece = 0").count() == docs.count()


def test_pipeline_runs(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
