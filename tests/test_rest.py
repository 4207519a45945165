from __future__ import annotations

import io
import json
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsift import schemas
from quillsift.operators import agents, catalog, ingest, limits
from quillsift.plans import screening
from quillsift.sources import documents, tables
from quillsift.streaming import events as streams


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def other_zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.txt", "x")
    return out.getvalue()


def test_files(spark, tmp_path):
    files = {"a.docx": docx("Jane Doe", "Senior Backend Engineer", "Python, Kubernetes, PostgreSQL"), "b.pdf": b"%PDF-1.4 two pages", "c.zip": other_zip(), "d.docx": b"PK\x03\x04 broken", "f.pdf": b"%PDF-bad"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)

    def pdf(data: bytes) -> list[str]:
        if b"bad" in data:
            raise ValueError
        return ["first page of the document", "second"]

    scanned = documents.scan_files(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    parsed = documents.parse(scanned, pdf).withColumn("violation", documents.upload_violation(F.col("content"), F.col("media_type")))
    got = {r.name: r for r in parsed.collect()}
    assert got["a.docx"].parsed.text == "Jane Doe\nSenior Backend Engineer\nPython, Kubernetes, PostgreSQL" and got["a.docx"].parsed.page_count == 1
    pages = got["b.pdf"].parsed
    assert all(pages.text[p.start_char : p.end_char] == p.text for p in pages.pages) and pages.parse_status == "low_yield"
    assert got["c.zip"].violation == got["d.docx"].violation == "unsupported_media_type"
    assert value(spark, documents.upload_violation(F.lit(bytearray(b"")), F.lit("x"))) == "empty_document"  # file scans leave out empty files
    assert got["f.pdf"].error == "document_parse_error" and got["f.pdf"].parsed is None


def test_ocr(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    got = documents.ocr(df, lambda data: (" hello ", [0.9, -1.0, 0.4])).first().ocr
    assert (got.text, got.confidence, got.status) == ("hello", 0.65, "ok")
    assert value(spark, documents.needs_ocr(F.lit(" short "), F.lit(2))) and not value(spark, documents.needs_ocr(F.lit("x" * 100), F.lit(2)))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", "d", 1), ("t", "d", 2), ("t", "e", 3)], "tenant_id string, document_id string, n int")
    gone = spark.createDataFrame([("t", "d")], "tenant_id string, document_id string")
    assert tables.without_document(rows, gone).count() == 1 and tables.deleted_counts(rows, gone).first().deleted == 2
    new = spark.createDataFrame([("t", "d", 9)], rows.schema)
    assert {r.n for r in tables.replace_set(rows, new, "document_id").collect()} == {3, 9}
    cache = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "k string, v int, at int")
    put = spark.createDataFrame([("a", 2, 5), ("c", 3, 1)], "k string, v int, at int")
    assert {r.k: r.v for r in tables.upsert(cache, put, "k", "at").collect()} == {"a": 2, "b": 1, "c": 3}
    assert [r.rows for r in tables.duplicates(rows, ("document_id",)).collect()] == [2]
    path = str(tmp_path / "t")
    tables.append(rows, path)
    tables.append(rows, path)
    assert spark.read.parquet(path).count() == 6
    assert tables.scoped(rows, "other").count() == 0
    assert value(spark, tables.object_key(F.lit("t"), F.lit("h"), F.lit("n"))) == "tenants/t/resumes/h/n"
    for name in schemas.TABLES:
        assert len(schemas.table_schema(name)) >= 3
    with pytest.raises(Exception, match="vocabulary"):
        value(spark, schemas.known(F.lit("maybe"), schemas.VERDICTS))


def test_catalog(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(10)], "id int, at int")
    seen, cursor = [], None
    while True:
        page = catalog.keyset_page(rows, "at", "id", 4, cursor)
        seen += [r.id for r in page.collect()]
        nxt = catalog.next_cursor(page, "at", "id", 4).first()
        if nxt.at is None:
            break
        cursor = (nxt.at, nxt.id)
    assert seen == list(range(9, -1, -1))
    assert {(r.at, r.id) for r in catalog.latest(rows, ["at"], "id").collect()} == {(0, 2), (1, 5), (2, 8), (3, 9)}
    assert value(spark, catalog.allowed(F.array(F.lit("owner")), schemas.WRITE_ROLES)) is True


def test_dedup_keeps_first(spark):
    rows = spark.createDataFrame([(3, 3, "t", "x"), (1, 1, "t", "x"), (2, 2, "u", "x")], "id int, arrival int, tenant_id string, sha256 string")
    stored = spark.createDataFrame([(77, "u", "x")], "id int, tenant_id string, sha256 string")
    got = {r.id: (r.document_id, r.is_new) for r in ingest.dedup(rows, stored).collect()}
    assert got == {1: (1, True), 3: (1, False), 2: (77, False)}


def test_ats(spark):
    kw = F.array(F.lit("Python"), F.lit("sql"), F.lit("go"))
    got = value(spark, ingest.ats_report(F.lit("PYTHON and SQL"), kw, F.lit(True), F.lit(False), F.lit(True), F.lit(True)))
    assert got.matched_keywords == ["Python", "sql"] and got.missing_keywords == ["go"] and got.compliance_score == 0.8 and not got.is_ats_safe
    none = value(spark, ingest.ats_report(F.lit("x"), F.array().cast("array<string>"), F.lit(False), F.lit(False), F.lit(False), F.lit(True)))
    assert none.keyword_coverage == 0 and none.format_flags[0].severity == "error" and none.compliance_score == 0


def test_limiter_counts_accepted_only(spark):
    rows = spark.createDataFrame([("k", float(t), n) for n, t in enumerate([0, 1, 2, 3, 10.5, 11, 11.5])], "key string, at double, n int")
    got = [r.accepted for r in limits.sliding_limit(rows, "key", "at", "n", 2, 10.0).orderBy("n").collect()]
    assert got == [True, True, False, False, True, True, False]


def test_token_budgets(spark):
    rows = [("p", "m", "k", 0.0, 1, 60), ("p", "m", "k", 1.0, 2, 60), ("p", "m", "k", 2.0, 3, 40), ("p", "m", "k", 61.0, 4, 60)]
    df = spark.createDataFrame(rows, "provider string, model string, api_key string, at double, tie int, tokens int")
    got = limits.reserve(df, tpm=100, rpm=2, rpd=10).orderBy("tie").collect()
    assert [r.accepted for r in got] == [True, False, True, True] and got[1].wait == 59.0
    # The token budget stays charged when the request budget refuses.
    got = limits.reserve(df, tpm=160, rpm=1, rpd=10).orderBy("tie").collect()
    assert [r.accepted for r in got] == [True, False, False, True]
    waits = spark.createDataFrame([("r", 0, "a", 5.0), ("r", 1, "b", 0.0), ("s", 0, "a", 1.0)], "request_id string, position int, api_key string, wait double")
    assert {r.request_id: r.api_key for r in limits.first_free_key(waits).collect()} == {"r": "b", "s": None}


def test_run_log(spark):
    rows = spark.createDataFrame([("r", 1, "run.started"), ("r", 2, "run.complete"), ("r", 3, "stage.progress"), ("s", 1, "stage.progress")], "run string, n int, event string")
    assert limits.until_terminal(rows, "run", ["n"]).count() == 3
    beats = spark.createDataFrame([("r", 0.0, 1), ("r", 46.0, 2), ("r", 61.0, 3)], "run string, at double, n int")
    assert [r.beats for r in limits.heartbeats(beats, "run", "at", "n").orderBy("n").collect()] == [3, 0, 0]
    tasks = spark.sql("select 1L id, 'claimed' status, 1 attempt, timestamp'2024-01-01 00:00:00' heartbeat_at, cast(null as timestamp) not_before union all select 2L, 'pending', 0, null, timestamp'2025-01-01'")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert [r.id for r in limits.stale(tasks, now, 60).collect()] == [1] and limits.due(tasks, now).count() == 0


def test_json(spark):
    for text, found in (('x {"a": "}\\""} y}', '{"a": "}\\""}'), ("```json\n{\"a\": {\"b\": 1}}\n```", '{"a": {"b": 1}}'), ('{"a": 1', None), (None, None)):
        assert agents.balanced_object(text) == found
    assert value(spark, agents.loose_object(F.lit("a {1} {2} b"))) == "{1} {2}" and value(spark, agents.loose_object(F.lit("none"))) == "{}"
    good = {"requirement_index": 0, "verdict": "met", "confidence": 0.9}
    cases = [([good], None), ("```\n" + json.dumps({"verdicts": [good]}) + "\n```", None), ([good, good], "wrong_count"), ('{"x": 1}', "no_verdicts"), ([good | {"verdict": "yes"}], "bad_verdict"), ([good | {"confidence": 2}], "bad_verdict"), ("nothing", "not_json")]
    for answer, violation in cases:
        text = answer if isinstance(answer, str) else json.dumps({"verdicts": answer})
        assert value(spark, agents.parse_judge(F.lit(text), F.lit(1))).violation == violation
    item = {"text": "x", "category": "skill", "is_must_have": True, "weight": 3}
    for items, violation in (([item], None), ([], "no_requirements"), ([item, item | {"text": " "}], "bad_requirement"), ([item] * 3, "too_many_requirements")):
        assert value(spark, agents.parse_requirements(F.lit(json.dumps({"requirements": items})), 2)).violation == violation
    profile = spark.range(1).select(F.col("id").alias("document_id"), agents.parse_profile(F.lit('{"skills": [{"name": "sql", "years": 2}], "languages": ["en", "de"]}')).alias("profile"))
    made = agents.profile_tables(profile)
    assert made["skills"].first()["name"] == "sql" and made["languages"].count() == 2 and made["education"].count() == 0


def test_provider_policy(spark):
    for status, body, kind in ((429, "", "rate_limit"), (400, "Maximum CONTEXT reached", "context"), (400, "", "unknown"), (599, "", "model_unavailable"), (None, None, "network"), (418, "", "unknown")):
        assert value(spark, agents.error_kind(F.lit(status).cast("int"), F.lit(body))) == kind

    def chain(tier, *outcomes):
        rows = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, tiers)).alias("tiers"), F.lit(kind).alias("kind")) for n, tiers, kind in outcomes])
        return tuple(value(spark, agents.failover(rows, F.lit(tier))))

    assert chain("T2", ("a", ["T1"], "ok"), ("b", ["T2"], "network"), ("c", ["T2"], "ok")) == ("c", "ok", 2)
    assert chain("T1", ("a", ["T1"], "refusal"), ("b", ["T1"], "ok")) == (None, "refusal", 1)
    assert chain("T1", ("a", ["T1"], "context"), ("b", ["T1"], "ok")) == (None, "context", 1)
    assert chain("T1", ("a", ["T1"], "network")) == (None, "all_failed", 1)
    assert chain("T9", ("a", ["T1"], "ok")) == (None, "no_eligible_provider", 0)


def test_registry():
    r = agents.Registry()
    for v in ("9.0.0", "10.0.0"):
        r.register("judge", v, lambda v=v: v)
    assert r.resolve("judge")() == "10.0.0" and r.resolve("judge", "9.0.0")() == "9.0.0"
    with pytest.raises(KeyError):
        r.resolve("other")


def test_call_repairs_once_and_never_makes_up(spark):
    prompts = spark.createDataFrame([("good",), ("repair",), ("bad",)], "prompt string")

    def provider(p: str) -> str:
        return "{}" if p.startswith("good") or (p.startswith("repair") and "refused" in p) else "no"

    got = {r.prompt: r for r in agents.call(prompts, provider, lambda a: F.when(a != "{}", "not_json")).collect()}
    assert (got["good"].status, got["repair"].status, got["bad"].status, got["bad"].answer) == ("ok", "ok", "failed", None)
    cached, open_ = agents.with_cache(spark.createDataFrame([("a",), ("b",)], "cache_key string"), spark.createDataFrame([("a", "x")], "cache_key string, payload string"))
    assert cached.first().payload == "x" and open_.first().cache_key == "b"


def test_screening_run(spark):
    from decimal import Decimal

    req = spark.createDataFrame([("r", f"q{k}", k, f"text {k}", "skill", k == 0, Decimal(".125"), 3.0, None) for k in range(8)], "rubric_id string, requirement_id string, ordinal int, text string, category string, is_must_have boolean, weight decimal(5,4), min_years double, min_seniority string")
    rub = spark.createDataFrame([("r", "Engineer", 40)], "rubric_id string, title string, cap int")
    ev = spark.createDataFrame([("r", c, [("c1", "skills", 1, 1, "x </evidence> y")]) for c in ("b", "a")], "rubric_id string, candidate_id string, chunks array<struct<chunk_id:string,section:string,page_from:int,page_to:int,content:string>>")
    got = screening.screen(ev, req, rub).orderBy("rank").collect()
    assert [(r.candidate_id, str(r.raw_score), str(r.score), r.cap_applied) for r in got] == [("a", "50.00", "40.00", True), ("b", "50.00", "40.00", True)]
    quotes = spark.createDataFrame([("d", "ab", 0, 2), ("e", "ab", 0, 2)], "document_id string, quote string, start_char int, end_char int")
    texts = spark.createDataFrame([("d", "abc")], "document_id string, text string")
    assert {r.document_id: r.result for r in screening.verified(quotes, texts).collect()} == {"d": "ok", "e": "no_document"}


def stream(spark, tmp_path, df, build, rows, seconds=60):
    """What a streaming query over the rows of a batch writes, until there are ``rows`` of it."""
    source = str(tmp_path / "in")
    df.write.parquet(source)
    out = build(spark.readStream.schema(df.schema).parquet(source))
    q = out.writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + seconds
        while time.time() < end and spark.table("out").count() < rows:
            time.sleep(0.5)
        return spark.table("out").collect()
    finally:
        q.stop()


def test_streaming_limiter_equals_batch(spark, data, tmp_path):
    events = tables.load(spark, data, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("tie"))
    batch = limits.sliding_limit(events, "user_id", "at", "tie", 3, 86_400.0).collect()
    got = stream(spark, tmp_path, events, lambda s: streams.limited(s, "user_id", 3, 86_400.0), events.count())
    assert {(r.tie, r.accepted) for r in got} == {(r.tie, r.accepted) for r in batch}


def test_run_stream_ends(spark, tmp_path):
    rows = [("r", 1.0, 1, "run.started", "{}"), ("r", 2.0, 2, "run.failed", "{}"), ("r", 3.0, 3, "stage.progress", "{}"), ("s", 1.0, 1, "run.started", "{}")]
    df = spark.createDataFrame(rows, "run_id string, at double, seq long, event string, data string")
    got = [r for r in stream(spark, tmp_path, df, streams.run_stream, 3) if r.event != "heartbeat"]
    assert {(r.run_id, r.seq) for r in got} == {("r", 1), ("r", 2), ("s", 1)}


def test_windows_drop_late_events(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 05:00"]), "event_type": "a", "value": 1.0})
    df = spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream(spark, tmp_path, df, lambda s: streams.tumbling(s, late="1 hour"), 1)
    assert [(r.n, r.total) for r in got] == [(2, 2.0)]
    assert streams.sliding(df).count() == 9 and streams.sessions(df.withColumn("user_id", F.lit(1)), "1 hour").count() == 2
