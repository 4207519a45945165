"""Row types, closed vocabularies and limits of the engine."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# Vocabularies.
VERDICTS = ("met", "partial", "missing", "unclear")
RUBRIC_STATUSES = ("draft", "approved", "superseded")
FORMULA_VERSIONS = ("v1",)
FINDING_KINDS = ("invisible_text", "tiny_font", "off_canvas", "metadata", "instruction_pattern")
RUN_EVENTS = ("run.started", "run.complete", "run.failed", "run.cancelled", "stage.started", "stage.progress", "stage.complete", "verdict.ready", "heartbeat")
TERMINAL_EVENTS = ("run.complete", "run.failed", "run.cancelled")
WRITE_ROLES = ("owner", "admin", "recruiter")

# Limits.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_PAGES = 500
MAX_CHARS = 5_000_000
CHARS_PER_PAGE = 20
MAX_CHILDREN = 600
MAX_REQUIREMENTS = 200

WEIGHT = T.DecimalType(5, 4)
POINTS = T.DecimalType(5, 2)

PAGE_OFFSET = "struct<page:int,start_char:int,end_char:int>"
SPAN = "struct<text:string,page:int,size:double,color:int,bbox:array<double>,page_rect:array<double>>"
FINDING = "struct<kind:string,detail:string,excerpt:string,page:int,removed:boolean>"
PARSED = f"text string, pages array<struct<page:int,text:string,start_char:int,end_char:int>>, page_count int, needs_ocr boolean, parse_status string, error string"

#: Tables of the data model: name -> columns (DDL). Vectors are arrays of floats, JSON of known shape is nested.
TABLES = {
    "resume_documents": "id string, tenant_id string, sha256 string, filename string, media_type string, size_bytes bigint, storage_key string, created_at timestamp",
    "resume_versions": f"id string, tenant_id string, document_id string, version int, extracted_text string, text_sha256 string, page_offsets array<{PAGE_OFFSET}>, parser_version string, injection_risk_score double, quarantined boolean, created_at timestamp",
    "resume_chunks": "id string, tenant_id string, resume_version_id string, document_id string, chunk_index int, parent_chunk_id string, section string, content string, page_from int, page_to int, start_char int, end_char int, token_count int, embedding array<float>, embedding_model string, embedding_version string, is_parent boolean",
    "jobs": "id string, tenant_id string, title string, description_raw string, created_at timestamp",
    "rubric_versions": "id string, tenant_id string, job_id string, version int, status string, source string, content_hash string, must_have_fail_cap int, aggregation_formula_version string, approved_by string, approved_at timestamp, created_at timestamp",
    "requirements": "id string, tenant_id string, rubric_version_id string, ordinal int, text string, category string, is_must_have boolean, weight decimal(5,4), min_years decimal(4,1), min_seniority string",
    "screening_runs": "id string, tenant_id string, job_id string, rubric_version_id string, status string, created_at timestamp",
    "candidate_scores": "id string, tenant_id string, run_id string, candidate_id string, score decimal(5,2), raw_score decimal(5,2), must_have_failed boolean, cap_applied boolean, rank int",
    "requirement_verdicts": "id string, tenant_id string, candidate_score_id string, requirement_id string, verdict string, confidence double, points decimal(6,4)",
    "evidence_spans": "id string, tenant_id string, verdict_id string, chunk_id string, quote string, start_char int, end_char int",
    "run_tasks": "id bigint, tenant_id string, run_id string, stage string, status string, attempt int, not_before timestamp, claimed_at timestamp, heartbeat_at timestamp",
    "agent_result_cache": "cache_key string, agent string, payload string, created_at timestamp, expires_at timestamp",
    "rate_limit_buckets": "provider string, model string, api_key string, bucket string, capacity int, used int, window_start timestamp",
    "run_checkpoints": "run_id string, stage string, payload string, created_at timestamp",
    "ats_compliance_reports": "id string, tenant_id string, document_id string, keyword_coverage double, matched_keywords array<string>, missing_keywords array<string>, compliance_score double, is_ats_safe boolean",
    "fraud_flags": "id string, tenant_id string, candidate_id string, kind string, detail string, severity string",
    "bias_flags": "id string, tenant_id string, run_id string, kind string, detail string, severity string",
    "skill_gaps": "id string, tenant_id string, candidate_id string, requirement_id string, severity string, gap_type string, suggested_probe string, weight double",
    "interview_kits": "id string, tenant_id string, candidate_id string, run_id string, created_at timestamp",
    "interview_questions": "id string, tenant_id string, kit_id string, ordinal int, question string, rationale string",
    "decisions": "id string, tenant_id string, candidate_id string, run_id string, outcome string, reason string, decided_by string, created_at timestamp",
    "fairness_snapshots": "id string, tenant_id string, computed_for_date date, payload string",
    "tenants": "id string, name string, created_at timestamp",
    "users": "id string, tenant_id string, email string, created_at timestamp",
    "user_roles": "id string, tenant_id string, user_id string, role string",
    "api_keys": "id string, tenant_id string, user_id string, key_hash string, created_at timestamp",
    "audit_events": "id string, tenant_id string, actor string, action string, payload string, created_at timestamp",
    "candidates": "id string, tenant_id string, email string, name string, created_at timestamp",
    "candidate_profiles": "id string, tenant_id string, candidate_id string, skills array<string>, years_experience decimal(4,1), languages array<string>",
    "chat_sessions": "id string, tenant_id string, user_id string, created_at timestamp",
    "chat_messages": "id string, tenant_id string, session_id string, role string, content string, created_at timestamp",
}

#: Unique keys that writers must keep; ``duplicates`` finds rows against them.
UNIQUE = {
    "resume_documents": ("tenant_id", "sha256"),
    "rubric_versions": ("job_id", "version"),
    "candidates": ("tenant_id", "email"),
    "fairness_snapshots": ("tenant_id", "computed_for_date"),
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def known(value: Column, vocabulary: tuple[str, ...]) -> Column:
    """The value if it is in the vocabulary; any other (null too) fails the query."""
    return F.when(value.isin(*vocabulary), value).otherwise(F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(value.cast("string"), F.lit("null")))))
