"""Agents: typed functions over rows, external or deterministic, with a status.

An external agent is a provider function (prompt -> answer) that is passed in;
no provider is bundled.  Around it, prompts, caching, validation and failover
are column expressions; only answers that need a JSON balancer or the provider
itself are Python.
"""

from __future__ import annotations

import re
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from quillsift.functions.text import neutral, strip
from quillsift.schemas import VERDICTS

MAX_JOB_CHARS = 200_000
MAX_RESUME_CHARS = 50_000
BATCH = 6
CEILING = 12
RESULT = "struct<status:string,output:string,warnings:array<string>>"
#: Failures after which another provider may do better (fixed values).
RETRYABLE = ("network", "rate_limit", "model_unavailable", "auth", "unknown")
#: Kinds of provider failures by HTTP status (fixed values).
STATUS_KINDS = {401: "auth", 403: "auth", 404: "model_unavailable", 408: "network", 413: "context", 429: "rate_limit", 500: "unknown", 502: "network", 503: "model_unavailable", 504: "network"}
#: Phrases by which a 400 says that the prompt is too long (fixed values).
CONTEXT_HINTS = ("context length", "context window", "maximum context", "token count exceeds", "too many tokens", "reduce the length", "input is too long")

JUDGE_ANSWER = "struct<verdicts:array<struct<requirement_index:int,verdict:string,confidence:double,reasoning:string,evidence_quote:string,years_evidenced:double>>>"
PROFILE = "struct<skills:array<struct<name:string,years:double,level:string>>,experience:array<struct<title:string,company:string,start:string,end:string,summary:string>>,education:array<struct<degree:string,institution:string,year:int>>,certifications:array<string>,languages:array<string>>"
REQUIREMENTS_ANSWER = "struct<requirements:array<struct<text:string,category:string,is_must_have:boolean,weight:double,min_years:double,min_seniority:string>>>"


@dataclass
class Registry:
    """Agents by name and version; the latest is the highest version by its numbers."""

    agents: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def register(self, name: str, version: str, agent: Callable) -> None:
        self.agents[name, version] = agent

    def resolve(self, name: str, version: str | None = None) -> Callable:
        found = [v for n, v in self.agents if n == name and version in (None, v)]
        if not found:
            raise KeyError(f"{name}@{version or 'latest'}")
        return self.agents[name, max(found, key=lambda v: tuple(int(x) if x.isdigit() else -1 for x in v.split(".")))]

    def expose(self, spark: SparkSession) -> None:
        """Register every agent's latest version as an SQL function of its name."""
        for name in {n for n, _ in self.agents}:
            spark.udf.register(name.replace("-", "_"), self.resolve(name))


#: Strings (to the end, if never closed) with their escapes, and braces outside of them.
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}]', re.DOTALL)


def balanced_object(text: str | None) -> str | None:
    """The first ``{`` up to the brace that closes it, with strings and escapes heeded; null if it is never closed."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depths = itertools.accumulate(((m, {"{": 1, "}": -1}.get(m[0], 0)) for m in _BRACES.finditer(text, start)), lambda a, b: (b[0], a[1] + b[1]))
    return next((text[start : m.end()] for m, depth in depths if depth == 0), None)


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)


def loose_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; ``{}`` if there are none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.coalesce(found, F.lit("")) == "", "{}").otherwise(found)


def parse_judge(answer: Column, expected: Column) -> Column:
    """``verdicts, violation`` of a judge's answer: one verdict per requirement, known labels, confidences from 0 to 1."""
    body = json_object(answer)
    parsed = F.from_json(body, JUDGE_ANSWER)
    verdicts = parsed["verdicts"]
    fits = F.forall(verdicts, lambda v: F.coalesce(v["verdict"].isin(*VERDICTS), F.lit(False)) & F.coalesce(v["confidence"].between(0.0, 1.0), F.lit(False)) & v["requirement_index"].isNotNull())
    violation = (
        F.when(body.isNull() | F.coalesce(F.from_json(body, "map<string,string>").isNull(), F.lit(True)), "not_json")
        .when(verdicts.isNull(), "no_verdicts")
        .when(F.size(verdicts) != expected, "wrong_count")
        .when(~fits, "bad_verdict")
    )
    return F.struct(F.when(violation.isNull(), verdicts).alias("verdicts"), violation.alias("violation"))


def parse_requirements(answer: Column, most: int = 200) -> Column:
    """``requirements, violation`` of a job analysis, all or nothing: 1 to ``most`` items, each with text, weight in range and category."""
    body = json_object(answer)
    items = F.from_json(body, REQUIREMENTS_ANSWER)["requirements"]
    good = F.forall(items, lambda r: F.coalesce(F.trim(r["text"]) != "", F.lit(False)) & (F.length(r["text"]) <= 2000) & r["category"].isNotNull() & F.coalesce(r["weight"], F.lit(1.0)).between(0, 1000))
    violation = F.when(body.isNull(), "not_json").when(items.isNull() | (F.size(items) == 0), "no_requirements").when(F.size(items) > most, "too_many_requirements").when(~good, "bad_requirement")
    return F.struct(F.when(violation.isNull(), items).alias("requirements"), violation.alias("violation"))


def parse_profile(answer: Column) -> Column:
    """Skills, experience, education, certifications and languages from one answer."""
    return F.from_json(loose_object(answer), PROFILE)


def profile_tables(profiles: DataFrame, profile: str = "profile", key: str = "document_id") -> dict[str, DataFrame]:
    """A table for each list of the profiles, from one parse."""
    p = F.col(profile)
    return {name: profiles.select(key, F.inline(p[name])) for name in ("skills", "experience", "education")} | {name: profiles.select(key, F.explode(p[name]).alias("value")) for name in ("certifications", "languages")}


def judge_batches(requirements: DataFrame, unit: str, size: int = BATCH) -> DataFrame:
    """``requirements`` with ``batch`` and ``index``: at most ``size`` of a unit in each."""
    if not 0 < size <= CEILING:
        raise ValueError(f"a batch holds 1 to {CEILING} requirements")
    n = F.row_number().over(Window.partitionBy(unit).orderBy("ordinal", "requirement_id")) - 1
    return requirements.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("index", (F.col("_n") % size).cast("int")).drop("_n")


def requirement_line(index: Column, category: Column, text: Column, must_have: Column, years: Column, seniority: Column) -> Column:
    """One requirement in a prompt, its demands in brackets."""
    whole = F.when(years == F.floor(years), F.floor(years).cast("string")).otherwise(years.cast("string"))
    tags = F.array_compact(F.array(F.when(must_have, "MUST-HAVE"), F.when(years.isNotNull(), F.concat(F.lit("min "), whole, F.lit(" years"))), F.when(F.coalesce(seniority, F.lit("")) != "", F.concat(F.lit("min seniority: "), seniority))))
    tag = F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, " | "), F.lit("]"))).otherwise("")
    return F.concat(F.format_string("  [%d] (%s) %s", index, category, text), tag)


def judge_prompt(title: Column, lines: Column, evidence: Column) -> Column:
    """A judge's prompt: requirements as instructions, evidence (chunk_id, section, page_from, page_to, content) as delimited data."""
    blocks = F.transform(evidence, lambda e: F.concat(F.format_string("#%s | %s | p. %d to %d\n", e["chunk_id"], e["section"], e["page_from"], e["page_to"]), neutral(e["content"], "evidence")))
    return F.concat(F.lit("Position: "), title, F.lit("\n\nDecide for each of these, by its number:\n"), F.array_join(lines, "\n"), F.lit("\n\n"), block(F.array_join(blocks, "\n\n"), "evidence"), F.lit("\n\nAnswer with a JSON object that has one verdict for every number, and nothing else."))


def block(text: Column, tag: str) -> Column:
    """Untrusted text between tags that it can't close (the caller neutralizes the closing tag)."""
    return F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))


def job_prompt(title: Column, description: Column, most: int = MAX_JOB_CHARS) -> Column:
    """``prompt, violation`` for the analysis of a job description, which is data between tags; blank and too long ones aren't asked about."""
    bare = strip(description)
    violation = F.when(F.coalesce(bare, F.lit("")) == "", "blank").when(F.length(bare) > most, "too_long")
    prompt = F.concat(F.lit("Position: "), title, F.lit("\n\n"), block(neutral(bare, "job_description"), "job_description"), F.lit("\n\nList what this description requires, as a JSON object."))
    return F.struct(F.when(violation.isNull(), prompt).alias("prompt"), violation.alias("violation"))


def extraction_prompt(text: Column, most: int = MAX_RESUME_CHARS) -> Column:
    """``prompt, violation`` for the one extraction that skills, experience and education share; only the first ``most`` characters travel."""
    bare = strip(text)
    violation = F.when(F.coalesce(bare, F.lit("")) == "", "blank")
    part = F.substring(neutral(bare, "candidate_document"), 1, most)
    prompt = F.concat(block(part, "candidate_document"), F.lit("\n\nReturn this person's profile as a JSON object."))
    return F.struct(F.when(violation.isNull(), prompt).alias("prompt"), violation.alias("violation"))


@dataclass(frozen=True)
class Insight:
    """An agent that comments on a run: its inputs (JSON columns), the task in words, and the type of its answer."""

    name: str
    inputs: tuple[str, ...]
    task: str
    answer: str
    unavailable: str

    def prompt(self) -> Column:
        parts = [F.concat(F.lit(f"{c}:\n"), F.coalesce(F.col(c), F.lit("null"))) for c in self.inputs]
        return F.concat_ws("\n\n", F.lit(self.task), *parts, F.lit("Answer with a JSON object only."))

    def violation(self, answer: Column) -> Column:
        return F.when(answer.isNull() | F.from_json(loose_object(answer), "map<string,string>").isNull(), "not_json")


#: Agents whose failure only degrades a run.
INSIGHTS = (
    Insight("interview", ("verdicts_json", "gaps_json"), "Propose interview questions that settle the open points.", "struct<questions:array<struct<ordinal:int,question:string,category:string,targets_requirement_id:string,difficulty:string,rationale:string,expected_signal:string,follow_ups:array<string>>>>", "no interview kit in this run"),
    Insight("bias", ("generated_texts_json",), "Find wording in these generated texts that may be biased.", "struct<findings:array<struct<source:string,text_excerpt:string,bias_category:string,severity:string,rationale:string>>>", "no bias check in this run"),
    Insight("fraud", ("profile_json",), "Find statements of this profile that contradict each other.", "struct<signals:array<struct<signal_type:string,description:string,confidence:double,related_requirement_id:string>>>", "no fraud check in this run"),
    Insight("recommendation", ("score_json", "verdicts_json", "gaps_json", "fraud_signals_json", "bias_findings_json"), "Recommend how to go on with this candidate, and say why.", "struct<recommendation:string,narrative:string,confidence:double,uncertainties:array<string>>", "no recommendation in this run"),
)


def insight(inputs: DataFrame, agent: Insight, provider: Callable[[str], str]) -> DataFrame:
    """``inputs`` with ``result`` (status, output, warnings): asked twice at most, then degraded with a warning, never made up."""
    done = call(inputs.withColumn("_prompt", agent.prompt()), provider, agent.violation, "_prompt", attempts=2, exhausted="degraded")
    output = F.to_json(F.from_json(loose_object(F.col("answer")), agent.answer))
    result = F.struct(F.col("status").alias("status"), F.when(F.col("status") == "ok", output).alias("output"), F.when(F.col("status") == "ok", F.array().cast("array<string>")).otherwise(F.array(F.lit(agent.unavailable))).alias("warnings"))
    return done.withColumn("result", result.cast(RESULT)).drop("_prompt", "answer", "status", "violation")


def call(prompts: DataFrame, provider: Callable[[str], str], check: Callable[[Column], Column], prompt: str = "prompt", attempts: int = 2, exhausted: str = "failed") -> DataFrame:
    """``prompts`` with ``answer, status``: a provider asked up to ``attempts`` times until ``check`` (answer -> violation) is null.

    Only rows whose answer has a violation are asked again.  An answer is never
    made up: rows out of attempts are ``failed`` (or ``degraded``).
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: None if p is None else provider(p))

    out = prompts.withColumn("answer", ask(F.col(prompt))).withColumn("_violation", check(F.col("answer")))
    for n in range(1, attempts):
        again = F.concat(F.col(prompt), F.lit(f"\n\nAttempt {n} was refused: "), F.col("_violation"))
        out = out.withColumn("answer", F.when(F.col("_violation").isNull(), F.col("answer")).otherwise(ask(F.when(F.col("_violation").isNotNull(), again))))
        out = out.withColumn("_violation", check(F.col("answer")))
    status = F.when(F.col("_violation").isNull(), "ok").otherwise(exhausted)
    return out.withColumn("status", status).withColumn("answer", F.when(F.col("status") == "ok", F.col("answer"))).withColumnRenamed("_violation", "violation")


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Requests answered by a cache (cache_key, payload), and those that still have to be asked."""
    stored = cache.select(key, "payload")
    return requests.join(stored, key), requests.join(stored.select(key), key, "left_anti")


def error_kind(status: Column, body: Column) -> Column:
    """What a provider's HTTP failure means; null status is a transport failure."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_KINDS.items() for x in pair])
    overflow = F.exists(F.array(*[F.lit(h) for h in CONTEXT_HINTS]), lambda h: F.contains(F.lower(F.coalesce(body, F.lit(""))), h))
    return F.when(status.isNull(), "network").when((status == 400) & overflow, "context").otherwise(F.coalesce(table[status], F.when(status.between(500, 599), "model_unavailable").otherwise("unknown")))


def failover(outcomes: Column, tier: Column) -> Column:
    """``provider, status, attempted`` of a chain from what each provider would do.

    ``outcomes`` is an array, in order of priority, of ``name, tiers, kind``
    (kind is ok, refusal or a failure).  Providers without the tier are
    skipped before they are asked; the first that answers, refuses or fails
    for good ends the chain.
    """
    eligible = F.filter(outcomes, lambda p: F.array_contains(p["tiers"], tier))
    ends = F.transform(eligible, lambda p, i: F.when(p["kind"].isin(*RETRYABLE), None).otherwise(i))
    first = F.array_min(F.array_compact(ends))
    at = F.when(first.isNotNull(), F.get(eligible, first))
    status = F.when(F.size(eligible) == 0, "no_eligible_provider").when(first.isNull(), "all_failed").otherwise(at["kind"])
    return F.struct(F.when(status == "ok", at["name"]).alias("provider"), status.alias("status"), F.coalesce(first + 1, F.size(eligible)).alias("attempted"))


def stub_judge(prompt: str) -> str:
    """A provider for tests: partial credit for every requirement line of the prompt."""
    n = sum(line.startswith("  [") for line in prompt.split("\n"))
    return json.dumps({"verdicts": [{"requirement_index": k, "verdict": "partial", "confidence": 0.5, "reasoning": "stub"} for k in range(n)]})
