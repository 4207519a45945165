from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillsift.operators import rubric, scoring

LONG = "rubric_id string, ordinal int, weight decimal(20,8)"


def normalized(spark, weights):
    rows = [("r", k, Decimal(str(w))) for k, w in enumerate(weights)]
    out = rubric.normalize_weights(spark.createDataFrame(rows, LONG)).orderBy("ordinal").collect()
    return [r.normalized for r in out], {r.violation for r in out}


@pytest.mark.parametrize(
    ("weights", "expected"),
    [((3, 1), (".7500", ".2500")), ((1, 1, 1), (".3334", ".3333", ".3333")), ((3, 0), ("1.0000", "0.0000"))],
)
def test_weights(spark, weights, expected):
    got, violations = normalized(spark, weights)
    assert got == [Decimal(e) for e in expected] and violations == {None}


@pytest.mark.parametrize("weights", [(1,) * 7, (2, 3, 5, 7, 11), (0.1, 0.2, 0.3)])
def test_weights_add_up_to_one(spark, weights):
    assert sum(normalized(spark, weights)[0]) == 1


@pytest.mark.parametrize(("weights", "violation"), [((1000, 0.00000001), "weight_too_small"), ((0, 0), "zero_total"), ((1, -1, 2), "negative_weight")])
def test_weight_violations(spark, weights, violation):
    got, violations = normalized(spark, weights)
    assert violations == {violation} and set(got) == {None}


def test_too_many_equal_weights(spark):
    rows = spark.range(20_000).select(F.lit("r").alias("rubric_id"), F.col("id").cast("int").alias("ordinal"), F.lit(1).cast("decimal(20,8)").alias("weight"))
    assert rubric.normalize_weights(rows).filter("violation = 'weight_too_small'").count() == 20_000


def score(spark, rows, cap=40):
    data = [("c", f"q{k}", k, Decimal(w), must, verdict) for k, (w, must, verdict) in enumerate(rows)]
    judged = spark.createDataFrame(data, "unit string, requirement_id string, ordinal int, weight decimal(5,4), is_must_have boolean, verdict string")
    return scoring.aggregate(judged, ["unit"], F.lit(cap), contributions=True).first()


@pytest.mark.parametrize(
    ("rows", "raw", "final", "failed", "capped"),
    [
        ([(".6", False, "met"), (".4", True, "met")], "100.00", "100.00", False, False),
        ([(".5", False, "missing"), (".5", False, "missing")], "0.00", "0.00", False, False),
        ([(".1", True, "missing"), (".9", False, "met")], "90.00", "40.00", True, True),
        ([(".1", True, "partial"), (".9", False, "met")], "95.00", "40.00", True, True),
        ([(".1", True, "unclear"), (".9", False, "met")], "90.00", "40.00", True, True),
        ([(".9", True, "missing"), (".1", False, "met")], "10.00", "10.00", True, False),
        ([(".3333", False, "partial"), (".6667", False, "missing")], "16.67", "16.67", False, False),
    ],
)
def test_scores(spark, rows, raw, final, failed, capped):
    got = score(spark, rows)
    assert (got.raw_score, got.score, got.must_have_failed, got.cap_applied) == (Decimal(raw), Decimal(final), failed, capped)


def test_failed_ids_in_order(spark):
    got = score(spark, [(".2", True, "missing"), (".3", False, "met"), (".5", True, "partial")])
    assert got.failed_must_have_ids == ["q0", "q2"] and [c.ordinal for c in got.contributions] == [0, 1, 2]


def test_verdict_violations(spark):
    req = spark.createDataFrame([("u", 1), ("u", 2)], "unit string, requirement_id int")
    ver = spark.createDataFrame([("u", 1, "met"), ("u", 1, "met"), ("u", 3, "great")], "unit string, requirement_id int, verdict string")
    got = {(r.requirement_id, r.violation) for r in scoring.verdict_violations(req, ver, ["unit"]).collect()}
    assert got == {(1, "duplicate_verdict"), (2, "unjudged_requirement"), (3, "unknown_label"), (3, "unknown_requirement")}


def test_rubric_violations(spark):
    rubrics = spark.createDataFrame([("a", "draft", "v1"), ("b", "approved", "v9"), ("c", "approved", "v1"), ("d", "approved", "v1"), ("e", "approved", "v1")], "id string, status string, aggregation_formula_version string")
    rows = [(x, Decimal(w)) for x, w in (("a", "1"), ("b", "1"), ("d", ".5"), ("d", ".4"), ("e", ".5"), ("e", ".5"))]
    req = spark.createDataFrame(rows, "rubric_version_id string, weight decimal(5,4)")
    got = {r.id: r.violation for r in scoring.rubric_violations(rubrics, req).collect()}
    assert got == {"a": "not_approved", "b": "unknown_formula", "c": "no_requirements", "d": "weights_do_not_sum_to_one"}


HASH = "rubric_id string, text string, category string, is_must_have boolean, weight decimal(5,4), min_years decimal(4,1), min_seniority string"


def test_content_hash_is_canonical_json(spark):
    rows = [("r", " Größe 🙂 \"x\" ", "skill", True, Decimal(".4"), Decimal("3.0"), "mid"), ("r", "SQL", "skill", False, Decimal(".6"), None, None)]
    lines = sorted(
        json.dumps({"text": t.strip(), "category": c, "is_must_have": m, "weight": f"{w:.4f}", "min_years": None if y is None else str(y), "min_seniority": s}, sort_keys=True, separators=(",", ":"))
        for _, t, c, m, w, y, s in rows
    )
    expected = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    for order in (rows, rows[::-1]):
        assert rubric.content_hash(spark.createDataFrame(order, HASH)).first().content_hash == expected
    changed = [rows[0], ("r", "SQL", "skill", True, *rows[1][4:])]
    assert rubric.content_hash(spark.createDataFrame(changed, HASH)).first().content_hash != expected


RUBRIC = "id string, tenant_id string, job_id string, version int, status string, content_hash string, approved_by string, approved_at timestamp"
REQ = "id string, rubric_version_id string, ordinal int, text string, category string, is_must_have boolean, weight decimal(5,4), min_years decimal(4,1), min_seniority string"


def test_rubric_life(spark):
    rubrics = spark.createDataFrame([("v1", "t", "j", 1, "draft", None, None, None), ("v2", "t", "k", 1, "draft", None, None, None)], RUBRIC)
    req = spark.createDataFrame([("q", "v1", 0, "x", "skill", True, Decimal(1), None, None)], REQ)
    wanted = spark.createDataFrame([("v1", "me"), ("v2", "me")], "id string, approved_by string").withColumn("approved_at", F.current_timestamp())
    approved = rubric.approve(rubrics, req, wanted)
    state = {r.id: r for r in approved.collect()}
    assert state["v1"].status == "approved" and len(state["v1"].content_hash) == 64
    assert state["v2"].status == "draft" and state["v2"].content_hash is None
    minted, all_req = rubric.mint_next(approved, req, spark.createDataFrame([("v1", "n1"), ("v2", "n2")], "id string, new_id string"))
    assert {(r.id, r.version, r.status) for r in minted.collect()} == {("v1", 1, "superseded"), ("v2", 1, "draft"), ("n1", 2, "draft")}
    assert {r.rubric_version_id for r in all_req.collect()} == {"v1", "n1"}
    edited, refused = rubric.edit(approved, req, spark.createDataFrame([("z", "v1", 0, "y", "skill", False, Decimal(1), None, None), ("w", "v2", 0, "y", "skill", False, Decimal(1), None, None)], REQ))
    assert {r.id for r in edited.collect()} == {"q", "w"} and [r.rubric_version_id for r in refused.collect()] == ["v1"]
    drafts = rubric.create_drafts(rubrics, spark.createDataFrame([("t", "j")], "tenant_id string, id string"), spark.createDataFrame([("t", "j", "a"), ("t", "zz", "b")], "tenant_id string, job_id string, id string"))
    assert [(r.id, r.version) for r in drafts.collect()] == [("a", 2)]


def test_templates(spark):
    names = [r.name for r in rubric.templates(spark).select("name").distinct().orderBy("name").collect()]
    assert len(names) == 7 and names == sorted(names)
    assert rubric.templates(spark, "Backend-Engineer").count() == 0 < rubric.templates(spark, "backend-engineer").count()


def test_requirement_rules(spark):
    rows = [("r", " ", Decimal(1), None), ("r", "x" * 2001, Decimal(1), None), ("r", "ok", Decimal(1001), None), ("r", "ok", Decimal(1), 100.0), ("r", "ok", Decimal(1), 3.0)]
    got = sorted(r.violation for r in rubric.requirement_violations(spark.createDataFrame(rows, "rubric_id string, text string, weight decimal(10,2), min_years double")).collect())
    assert got == ["blank_text", "text_too_long", "weight_out_of_range", "years_out_of_range"]


def test_ranks(spark):
    s = spark.createDataFrame([("r", "b", 5.0), ("r", "a", 5.0), ("r", "c", 9.0)], "run string, id string, score double")
    assert [(r.id, r.rank) for r in scoring.ranked(s, ["run"], "id").orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
