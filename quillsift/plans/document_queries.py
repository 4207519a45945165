"""Queries over texts, spans, files and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import numbers, text as tx
from quillsift.operators import agents, chunking, sanitize, skew
from quillsift.plans.registry import query
from quillsift.sources import documents
from quillsift.sources.tables import load, object_key


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, chr(10), repeat(chr(10), CAST(1 + doc_id % 4 AS BIGINT))), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS sha FROM documents")
def blank_runs(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 4 + 1).cast("int")))
    return load(spark, sf_dir, "documents").select("doc_id", tx.sha256(tx.collapse_blank_lines(spaced)).alias("sha"))


@query("SELECT doc_id, sha256(replace(replace(text, COALESCE(string_split(text, ' ')[1], ''), ''), COALESCE(string_split(text, ' ')[3], ''), '')) AS sha FROM documents")
def hidden_text_removed(spark, sf_dir):
    """Texts without their first and third part; shorter ones have no third."""
    w = F.split("text", " ", -1)
    parts = F.array_compact(F.array(F.get(w, F.lit(0)), F.get(w, F.lit(2))))
    return load(spark, sf_dir, "documents").select("doc_id", tx.sha256(tx.without_all(F.col("text"), parts)).alias("sha"))


@query(
    r"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'C:\x\' || replace(url, '/', '?') || '..pdf' WHEN 2 THEN url || '/' ELSE ' .._' || CAST(page_id AS VARCHAR) || ' (1)....docx' END AS name FROM pages),
    t AS (SELECT page_id, regexp_extract(replace(name, '\', '/'), '[^/]*$', 0) AS t FROM n),
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]', '_', 'g'), '\.{2,}', '.', 'g'), '^[. _]+|[. _]+$', '', 'g') AS c FROM t)
    SELECT page_id, CASE WHEN c = '' THEN 'unnamed' ELSE left(c, 120) END AS name FROM c"""
)
def safe_filenames(spark, sf_dir):
    url, n = F.col("url"), F.col("page_id") % 4
    odd = F.concat(F.lit(" .._"), F.col("page_id").cast("string"), F.lit(" (1)....docx"))
    name = F.when(n == 0, url).when(n == 1, F.concat(F.lit("C:\\x\\"), F.replace(url, F.lit("/"), F.lit("?")), F.lit("..pdf"))).when(n == 2, F.concat(url, F.lit("/"))).otherwise(odd)
    return load(spark, sf_dir, "pages").select("page_id", tx.safe_filename(name).alias("name"))


@query(r"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, sha256(array_to_string(s, '|')) AS sha FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = tx.sentences(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), tx.sha256(F.array_join(s, "|")).alias("sha"))


@query("SELECT doc_id, sha256(replace(text || '</evidence>' || source || '</evidence >', '</evidence>', '&lt;/evidence&gt;')) AS sha FROM documents")
def neutral_delimiters(spark, sf_dir):
    forged = F.concat(F.col("text"), F.lit("</evidence>"), F.col("source"), F.lit("</evidence >"))
    return load(spark, sf_dir, "documents").select("doc_id", tx.sha256(tx.neutral(forged, "evidence")).alias("sha"))


@query("SELECT doc_id, sha256(sha256(text) || '|p' || CAST(doc_id % 3 AS VARCHAR) || '|m') AS cache_key FROM documents")
def extraction_keys(spark, sf_dir):
    version = F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", tx.extraction_key(tx.sha256(F.col("text")), version, F.lit("m")).alias("cache_key"))


@query("""SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 3 = 0 THEN '{"mode":"hybrid","recall":' || CAST(o_custkey AS VARCHAR) || '}' WHEN o_orderkey % 3 = 1 THEN '{"recall":null}' ELSE '{}' END) AS config FROM orders""")
def config_hashes(spark, sf_dir):
    n = F.col("o_orderkey") % 3
    two = F.create_map(F.lit("recall"), F.col("o_custkey").cast("string"), F.lit("mode"), F.lit('"hybrid"'))
    one = F.create_map(F.lit("recall"), F.lit(None).cast("string"))
    settings = F.when(n == 0, two).when(n == 1, one).otherwise(F.create_map().cast("map<string,string>"))
    return load(spark, sf_dir, "orders").select("o_orderkey", tx.config_hash(settings).alias("config"))


@query(
    """WITH s AS (SELECT p_partkey AS k, (p_partkey % 23) / 2.0 AS size, (p_partkey * 99991) % 16777216 AS color, CAST(p_partkey % 700 AS DOUBLE) - 20 AS x, CAST(p_partkey % 37 AS DOUBLE) AS w FROM part)
    SELECT k AS p_partkey, x + w < -2.0 OR x > 602.0 AS off_canvas,
    CASE WHEN size > 0 AND size <= 4 THEN 'tiny_font' WHEN x + w < -2.0 OR x > 602.0 THEN 'off_canvas'
    WHEN 0.2126 * ((color >> 16) & 255) / 255.0 + 0.7152 * ((color >> 8) & 255) / 255.0 + 0.0722 * (color & 255) / 255.0 >= 0.92 THEN 'invisible_text' END AS kind FROM s"""
)
def span_kinds(spark, sf_dir):
    k, x = F.col("p_partkey"), (F.col("p_partkey") % 700).cast("double") - 20
    box = F.array(x, F.lit(10.0), x + (F.col("p_partkey") % 37).cast("double"), F.lit(20.0))
    page = F.array(*map(F.lit, (0.0, 0.0, 600.0, 800.0)))
    span = F.struct(((k % 23) / 2.0).alias("size"), ((k * 99991) % 16777216).cast("int").alias("color"), box.alias("bbox"), page.alias("page_rect"))
    return load(spark, sf_dir, "part").withColumn("s", span).select("p_partkey", numbers.off_canvas(F.col("s.bbox"), F.col("s.page_rect")).alias("off_canvas"), numbers.hidden_kind(F.col("s")).alias("kind"))


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 2 AS m FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: (x + 2 * x * m) / (1 + m)) AS pooled, e FROM e),
    n AS (SELECT vec_id, pooled, sqrt(list_sum(list_transform(pooled, lambda x: x * x))) AS norm FROM p)
    SELECT vec_id, round(pooled[1], 6) AS first_pooled, round(pooled[2] / norm, 6) AS second_unit FROM n"""
)
def pooled_vectors(spark, sf_dir):
    tokens = F.array(F.col("embedding"), F.transform("embedding", lambda x: x * 2))
    pooled = numbers.mean_pool(tokens, F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double")))
    made = load(spark, sf_dir, "embeddings").withColumn("p", pooled)
    return made.select("vec_id", F.round(F.col("p")[0], 6).alias("first_pooled"), F.round(numbers.unit(F.col("p"))[1], 6).alias("second_unit"))


@query(
    """WITH r AS (SELECT item_id, list_transform(range(0, 40), lambda k: (CAST('0x' || substr(sha256(text), CAST((k % 32) * 2 + 1 AS INTEGER), 2) AS INTEGER) - 128) / 128.0) AS raw FROM benchmark),
    n AS (SELECT item_id, raw, sqrt(list_sum(list_transform(raw, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM r)
    SELECT item_id, unnest(range(0, 40)) AS place, round(unnest(list_transform(raw, lambda x: CAST(x AS DOUBLE) / norm)), 9) AS x FROM n"""
)
def mock_embeddings(spark, sf_dir):
    """The deterministic embedding, place by place."""
    v = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(numbers.mock_embedding(F.col("text"), 40)).alias("place", "x"))
    return v.select("item_id", F.col("place").cast("long").alias("place"), F.round("x", 9).alias("x"))


@query(
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
    o AS (SELECT doc_id, p, len(p) AS n, list_sum(list_transform(p, lambda x: length(x))) AS chars, length(array_to_string(p, chr(10) || chr(10))) AS total FROM p)
    SELECT doc_id, CAST(n AS INTEGER) AS page_count, CAST(total - length(p[n]) AS INTEGER) AS last_start, CAST(total AS INTEGER) AS last_end, chars < 20 * n AS needs_ocr,
    CASE WHEN chars < 20 * n THEN 'low_yield' ELSE 'ok' END AS parse_status, sha256(array_to_string(p, chr(10) || chr(10))) AS sha FROM o"""
)
def page_assembly(spark, sf_dir):
    """Every line of a document as a page."""
    made = load(spark, sf_dir, "documents").select("doc_id", documents.assemble(F.split("text", "\n", -1)).alias("a"))
    last = F.element_at("a.pages", -1)
    return made.select("doc_id", "a.page_count", last["start_char"].alias("last_start"), last["end_char"].alias("last_end"), "a.needs_ocr", "a.parse_status", tx.sha256(F.col("a.text")).alias("sha"))


@query(
    """WITH k AS (SELECT doc_id, doc_id % 5 AS n, octet_length(encode(text)) AS size FROM documents),
    m AS (SELECT doc_id, CASE WHEN n = 0 THEN 5 + size WHEN n = 1 THEN 4 + size WHEN n = 4 THEN 0 ELSE size END AS bytes, CASE WHEN n = 0 THEN 'application/pdf' END AS media_type FROM k)
    SELECT doc_id, media_type, CASE WHEN bytes = 0 THEN 'empty_document' WHEN bytes > 3000 THEN 'payload_too_large' WHEN media_type IS NULL THEN 'unsupported_media_type' END AS violation FROM m"""
)
def upload_checks(spark, sf_dir):
    """Bytes that begin like a PDF, a ZIP that holds no document, plain text, and nothing."""
    body, n = F.col("text").cast("binary"), F.col("doc_id") % 5
    content = F.when(n == 0, F.concat(F.lit(b"%PDF-"), body)).when(n == 1, F.concat(F.lit(b"PK\x03\x04"), body)).when(n == 4, F.lit(b"")).otherwise(body)
    typed = load(spark, sf_dir, "documents").select("doc_id", content.alias("content")).withColumn("media_type", documents.media_type(F.col("content")))
    return typed.select("doc_id", "media_type", documents.upload_violation(F.col("content"), F.col("media_type"), limit=3000).alias("violation"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsupported_media_type' END AS error, CAST(CASE WHEN doc_id % 3 > 0 THEN length(text) END AS INTEGER) AS chars, CAST(CASE WHEN doc_id % 3 > 0 THEN 1 END AS INTEGER) AS pages FROM documents")
def parse_dispatch(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 3 == 0, documents.PDF).otherwise(documents.TEXT).alias("media_type"))
    parsed = documents.parse(files)
    return parsed.select("doc_id", "error", F.length("parsed.text").alias("chars"), F.col("parsed.page_count").alias("pages"))


@query("SELECT doc_id, CAST(10 AS INTEGER) AS pages, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 100 AS needs_ocr FROM documents")
def thin_pages(spark, sf_dir):
    """The other parser's threshold."""
    docs = load(spark, sf_dir, "documents").withColumn("pages", F.lit(10))
    return docs.select("doc_id", "pages", documents.needs_ocr(F.col("text"), F.col("pages")).alias("needs_ocr"))


@query("SELECT vec_id, round(CASE WHEN len(c) > 0 THEN list_avg(c) ELSE 0 END, 5) AS confidence, CASE WHEN len(c) > 0 AND list_avg(c) >= 0.6 THEN 'ok' ELSE 'low_confidence' END AS status FROM (SELECT vec_id, list_filter(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 5), lambda x: x > 0) AS c FROM embeddings)")
def ocr_confidence(spark, sf_dir):
    mean = documents.mean_confidence(F.transform("embedding", lambda x: x.cast("double") * 5))
    made = load(spark, sf_dir, "embeddings").withColumn("m", mean)
    return made.select("vec_id", F.round("m", 5).alias("confidence"), documents.ocr_status(F.col("m")).alias("status"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
    h AS (SELECT doc_id, i, CASE WHEN i % 9 = 4 THEN 'Education' WHEN i % 18 = 5 THEN 'Skills' ELSE 'x ' || line END AS line, CASE WHEN i % 9 = 4 THEN 'education' END AS label FROM l),
    s AS (SELECT *, SUM(CASE WHEN label IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k, SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start FROM h),
    g AS (SELECT doc_id, k, COALESCE(MAX(label), 'summary') AS label, MIN(start) AS start, regexp_replace(string_agg(CASE WHEN label IS NULL THEN line END, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM s GROUP BY doc_id, k)
    SELECT doc_id, label, CAST(start AS INTEGER) AS start, CAST(length(body) AS INTEGER) AS chars FROM g WHERE body <> ''"""
)
def section_rows(spark, sf_dir):
    """Sections of documents with headings put in, two in a row among them: the second of these belongs to the body."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 9 == 4, "Education").when(i % 18 == 5, "Skills").otherwise(F.concat(F.lit("x "), x)))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunking.section_documents(docs, "doc_id", "text").select("doc_id", "label", "start", F.length("body").alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE '{\"n\":{\"t\":\"' || CAST(conv_id AS VARCHAR) || ' }{ \\\" \"}}' END AS strict, CASE WHEN turn % 3 = 2 THEN '{}' ELSE '{\"n\":{\"t\":\"' || CAST(conv_id AS VARCHAR) || ' }{ \\\" \"}}' || CASE WHEN turn % 3 = 0 THEN ' and }' ELSE '' END END AS loose FROM conversations")
def json_objects(spark, sf_dir):
    """An object with braces and quotes in a string, in the middle of an answer; every third answer has none."""
    body = F.concat(F.lit('{"n":{"t":"'), F.col("conv_id").cast("string"), F.lit(' }{ \\" "}}'))
    answer = F.concat(F.lit("Sure: "), F.when(F.col("turn") % 3 < 2, body).otherwise("none"), F.when(F.col("turn") % 3 == 0, " and }").otherwise(" done"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", agents.json_object(answer).alias("strict"), agents.loose_object(answer).alias("loose"))


@query(
    """WITH g AS (SELECT l_orderkey AS k, COUNT(*) AS n, COUNT(*) FILTER (l_returnflag = 'R') AS bad, COUNT(*) FILTER (l_discount > 0.09) AS over FROM lineitem GROUP BY l_orderkey)
    SELECT k AS l_orderkey, CASE WHEN k % 11 = 0 THEN 'not_json' WHEN k % 7 = 0 THEN 'wrong_count' WHEN k % 5 = 0 AND bad > 0 OR k % 3 = 0 AND over > 0 THEN 'bad_verdict' END AS violation,
    CAST(CASE WHEN NOT (k % 11 = 0 OR k % 7 = 0 OR (k % 5 = 0 AND bad > 0) OR (k % 3 = 0 AND over > 0)) THEN n END AS INTEGER) AS verdicts FROM g"""
)
def judge_answers(spark, sf_dir):
    """Judges' answers that are sound, no JSON, of the wrong number, of unknown labels, or of confidences over 1."""
    k = F.col("l_orderkey")
    label = F.when((k % 5 == 0) & (F.col("l_returnflag") == "R"), "yes").otherwise("met")
    sure = F.when((k % 3 == 0) & (F.col("l_discount") > 0.09), 1.5).otherwise(0.5)
    row = F.struct(F.col("l_linenumber").cast("int").alias("requirement_index"), label.alias("verdict"), sure.alias("confidence"), F.lit("{r}").alias("reasoning"))
    answers = skew.spread(load(spark, sf_dir, "lineitem"), "l_orderkey", most=5 * skew.ANSWER_ROWS).groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(row).alias("verdicts"))).alias("a"), F.count("*").alias("n"))
    answer = F.when(k % 11 == 0, "no verdicts").otherwise(F.concat(F.lit("Here: "), F.col("a"), F.lit(" end")))
    parsed = answers.withColumn("p", agents.parse_judge(answer, F.when(k % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))))
    return parsed.select("l_orderkey", "p.violation", F.size("p.verdicts").alias("verdicts")).withColumn("verdicts", F.when(F.col("violation").isNull(), F.col("verdicts")))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'not_json' WHEN c_custkey % 5 = 0 THEN 'no_requirements' WHEN c_custkey % 11 = 0 THEN 'too_many_requirements' WHEN c_custkey % 3 = 0 THEN 'bad_requirement' END AS violation,
    CAST(CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 OR c_custkey % 3 = 0 THEN NULL ELSE 1 + c_custkey % 4 END AS INTEGER) AS n FROM customer"""
)
def job_answers(spark, sf_dir):
    """Job analyses, all or nothing."""
    k = F.col("c_custkey")
    count = F.when(k % 5 == 0, 0).when(k % 11 == 0, 201).otherwise(1 + k % 4).cast("int")
    item = lambda i: F.struct(F.concat(F.col("c_name"), i.cast("string")).alias("text"), F.lit("skill").alias("category"), F.lit(True).alias("is_must_have"), F.when((k % 3 == 0) & (i == 1), -1.0).otherwise(2.0).alias("weight"))
    items = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), item)).otherwise(F.array())
    answer = F.when(k % 7 == 0, "{ broken").otherwise(F.to_json(F.struct(items.alias("requirements"))))
    parsed = skew.spread(load(spark, sf_dir, "customer"), most=skew.ANSWER_ROWS).withColumn("p", agents.parse_requirements(answer))
    return parsed.select("c_custkey", "p.violation", F.when(F.col("p.violation").isNull(), F.size("p.requirements")).alias("n"))


@query("SELECT c_custkey, c_name AS name, CAST(c_nationkey AS DOUBLE) AS years FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 1.5 FROM customer WHERE c_nationkey % 2 = 0")
def profile_skills(spark, sf_dir):
    first = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").cast("double").alias("years"))
    second = F.struct(F.col("c_mktsegment").alias("name"), F.lit(1.5).alias("years"))
    skills = F.when(F.col("c_nationkey") % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    answer = F.concat(F.lit("Profile: "), F.to_json(F.struct(skills.alias("skills"), F.array(F.lit("en")).alias("languages"))))
    profiles = load(spark, sf_dir, "customer").select("c_custkey", agents.parse_profile(answer).alias("profile"))
    return agents.profile_tables(profiles, key="c_custkey")["skills"].select("c_custkey", "name", "years")


@query("""SELECT p_partkey, '{"injection_risk_score":' || CASE WHEN p_partkey % 3 = 0 THEN '0.3333' ELSE '1.0' END || ',"findings":[{"kind":"metadata","detail":"d","excerpt":"' || p_type || '","page":null,"removed":false}]}' AS report FROM part""")
def report_json(spark, sf_dir):
    finding = F.struct(F.lit("metadata").alias("kind"), F.lit("d").alias("detail"), F.col("p_type").alias("excerpt"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("removed"))
    risk = F.when(F.col("p_partkey") % 3 == 0, 1.0 / 3).otherwise(1.0)
    return load(spark, sf_dir, "part").select("p_partkey", sanitize.report_json(F.array(finding), risk).alias("report"))


@query("SELECT doc_id, length(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END) AS shown FROM documents")
def quarantine_view(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.length(sanitize.shown_text(F.col("text"), F.col("doc_id") % 4 == 0)).cast("long").alias("shown"))


@query("SELECT doc_id, 'tenants/' || source || '/resumes/' || sha256(text) || '/' || CAST(doc_id AS VARCHAR) || '.pdf' AS key FROM documents")
def object_keys(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    return load(spark, sf_dir, "documents").select("doc_id", object_key(F.col("source"), tx.sha256(F.col("text")), name).alias("key"))


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS kept, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS INTEGER) AS start FROM orders"""
)
def clean_page_offsets(spark, sf_dir):
    """Offsets as text; a third of them malformed."""
    start = F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string"))
    raw = F.array(F.create_map(F.lit("page"), F.lit("1"), F.lit("start_char"), start, F.lit("end_char"), F.lit("9")))
    made = load(spark, sf_dir, "orders").withColumn("c", chunking.clean_offsets(raw))
    return made.select("o_orderkey", F.size("c").alias("kept"), F.get("c", F.lit(0))["start_char"].alias("start"))


@query(
    """WITH o AS (SELECT c_custkey AS k, c_custkey % 4 AS a, c_custkey % 5 AS b FROM customer)
    SELECT k AS c_custkey, CASE WHEN a IN (1, 2) AND b IN (1, 2) THEN 'all_failed' WHEN a = 3 OR (a IN (1, 2) AND b = 3) THEN 'refusal' ELSE 'ok' END AS status,
    CASE WHEN a = 0 THEN 'first' WHEN a IN (1, 2) AND b IN (0, 4) THEN 'second' END AS provider, CAST(CASE WHEN a IN (1, 2) THEN 2 ELSE 1 END AS INTEGER) AS attempted FROM o"""
)
def failover_chain(spark, sf_dir):
    """Three providers, one without the tier: failures that another may do better go on, a refusal ends the chain."""
    kind = lambda n: F.when(n == 1, "network").when(n == 2, "rate_limit").when(n == 3, "refusal").otherwise("ok")
    of = lambda name, tiers, k: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, tiers)).alias("tiers"), k.alias("kind"))
    k = F.col("c_custkey")
    chain = F.array(of("none", ("T0",), F.lit("ok")), of("first", ("T1", "T2"), kind(k % 4)), of("second", ("T2",), kind(k % 5)))
    made = load(spark, sf_dir, "customer").withColumn("f", agents.failover(chain, F.lit("T2")))
    return made.select("c_custkey", "f.status", "f.provider", "f.attempted")
