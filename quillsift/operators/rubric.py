"""Rubrics: weights, content hashes, versions and templates.

Operators take many rubrics at once; ``rubric`` columns name what a row
belongs to, ``ordinal`` its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.functions.text import strip
from quillsift.schemas import FORMULA_VERSIONS, MAX_REQUIREMENTS, WEIGHT

UNITS = 10_000
#: Relative weights are taken to eight decimal places.
PRECISION = 100_000_000
MOST_WEIGHT = 9_000_000
DEFAULT_CAP = 40


def normalize_weights(requirements: DataFrame, rubric: str = "rubric_id", ordinal: str = "ordinal", weight: str = "weight") -> DataFrame:
    """``requirements`` with ``normalized`` weights that add up to exactly 1.0000 in each rubric, and ``violation``.

    Shares are counted in units of 0.0001, rounded down; left-over units go to
    the largest fractions, ties by position.  A rubric with a negative weight,
    no positive one, a positive one that gets no unit, or weights of over
    MOST_WEIGHT together has a violation and no weights.
    """
    of_rubric = Window.partitionBy(rubric)
    # Longs hold weights up to MOST_WEIGHT times PRECISION times UNITS; sums of larger ones are refused.
    fits = F.abs(F.col(weight)) <= MOST_WEIGHT
    exact = F.when(fits, F.round(F.col(weight).cast("decimal(20,8)") * PRECISION).cast("long"))
    counted = requirements.withColumn("_w", exact).withColumn("_total", F.sum("_w").over(of_rubric)).withColumn("_least", F.min("_w").over(of_rubric)).withColumn("_large", F.max((~fits).cast("int")).over(of_rubric))
    whole = (F.col("_total") > 0) & (F.col("_total") <= MOST_WEIGHT * PRECISION) & (F.col("_w") >= 0)
    shares = counted.withColumn("_rest", F.when(whole, (F.col("_w") * UNITS) % F.col("_total"))).withColumn("_units", F.when(whole, F.expr(f"(_w * {UNITS}) div _total")))
    ranked = shares.withColumn("_left", F.lit(UNITS) - F.sum("_units").over(of_rubric)).withColumn(
        "_rank", F.row_number().over(of_rubric.orderBy(F.col("_rest").desc(), F.col(ordinal)))
    )
    given = ranked.withColumn("_units", F.col("_units") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0))
    starved = F.max(((F.col("_units") == 0) & (F.col("_w") > 0)).cast("int")).over(of_rubric)
    judged = given.withColumn(
        "violation",
        F.when((F.col("_large") == 1) | (F.col("_total") > MOST_WEIGHT * PRECISION), "weight_too_large").when(F.col("_least") < 0, "negative_weight").when(F.coalesce(F.col("_total"), F.lit(0)) == 0, "zero_total").when(starved == 1, "weight_too_small"),
    )
    normalized = F.when(F.col("violation").isNull(), (F.col("_units").cast("decimal(10,0)") / UNITS).cast(WEIGHT))
    return judged.withColumn("normalized", normalized).drop("_w", "_total", "_least", "_large", "_units", "_rest", "_left", "_rank")


def requirement_json(text: Column, category: Column, must_have: Column, weight: Column, min_years: Column, seniority: Column) -> Column:
    """Canonical JSON of what a requirement assesses: sorted keys, nulls written, decimals as text."""
    fields = F.struct(
        category.alias("category"),
        must_have.alias("is_must_have"),
        seniority.alias("min_seniority"),
        min_years.cast("string").alias("min_years"),
        strip(text).alias("text"),
        weight.cast(WEIGHT).cast("string").alias("weight"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def escaped(json: Column) -> Column:
    """JSON with characters beyond ASCII as \\uXXXX (UTF-16 units); ASCII text isn't touched."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
    pieces = F.transform(F.regexp_extract_all(json, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(r"^[^\x00-\x7F]"), units(c)).otherwise(c))
    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(pieces, "")).otherwise(json)


def content_hash(requirements: DataFrame, rubric: str = "rubric_id") -> DataFrame:
    """``rubric, content_hash``: SHA-256 of the requirements' canonical JSON, whatever their order."""
    json = escaped(requirement_json(*[F.col(c) for c in ("text", "category", "is_must_have", "weight", "min_years", "min_seniority")]))
    lines = requirements.select(rubric, json.alias("_json")).groupBy(rubric).agg(F.array_sort(F.collect_list("_json")).alias("_lines"))
    return lines.select(rubric, F.sha2(F.array_join("_lines", "\n").cast("binary"), 256).alias("content_hash"))


def requirement_violations(requirements: DataFrame, rubric: str = "rubric_id") -> DataFrame:
    """Requirements that break a rule, with ``violation``: text of 1 to 2000 characters, weight 0 to 1000, years 0 to 99, MAX_REQUIREMENTS a rubric."""
    n = F.count("*").over(Window.partitionBy(rubric))
    length = F.length(strip(F.col("text")))
    rule = (
        F.when(F.coalesce(length, F.lit(0)) == 0, "blank_text")
        .when(length > 2000, "text_too_long")
        .when(F.col("weight").isNull() | (F.col("weight") < 0) | (F.col("weight") > 1000), "weight_out_of_range")
        .when((F.col("min_years") < 0) | (F.col("min_years") > 99), "years_out_of_range")
        .when(n > MAX_REQUIREMENTS, "too_many_requirements")
    )
    return requirements.withColumn("violation", rule).filter("violation is not null")


def next_versions(rubrics: DataFrame, by: str = "job_id") -> DataFrame:
    """``job, latest, next``: highest version so far (0 if none) and the one to come."""
    top = rubrics.groupBy(by).agg(F.coalesce(F.max("version"), F.lit(0)).alias("latest"))
    return top.withColumn("next", F.col("latest") + 1)


def create_drafts(rubrics: DataFrame, jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Draft versions for ``wanted`` (tenant_id, job_id, id); jobs that the tenant doesn't have give none."""
    known = wanted.join(jobs.select("tenant_id", F.col("id").alias("job_id")), ["tenant_id", "job_id"], "left_semi")
    top = rubrics.groupBy("tenant_id", "job_id").agg(F.max("version").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("tenant_id", "job_id").orderBy("id"))
    numbered = known.join(top, ["tenant_id", "job_id"], "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + nth).cast("int")).drop("_top")
    return numbered.withColumns({"status": F.lit("draft"), "must_have_fail_cap": F.lit(DEFAULT_CAP), "aggregation_formula_version": F.lit(FORMULA_VERSIONS[0]), "content_hash": F.lit(None).cast("string")})


def editable(status: Column) -> Column:
    return status == "draft"


def scorable(status: Column) -> Column:
    return status == "approved"


def edit(rubrics: DataFrame, requirements: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the requirement sets that ``changes`` (rubric_version_id, ...) gives, of drafts only.

    Returns the new requirements and the refused versions with their status.
    """
    state = rubrics.select(F.col("id").alias("rubric_version_id"), "status")
    refused = changes.select("rubric_version_id").distinct().join(state.filter(~editable(F.col("status"))), "rubric_version_id")
    taken = changes.join(state.filter(editable(F.col("status"))).select("rubric_version_id"), "rubric_version_id", "left_semi")
    kept = requirements.join(taken.select("rubric_version_id").distinct(), "rubric_version_id", "left_anti").select(*requirements.columns)
    return kept.unionByName(taken.select(*requirements.columns)), refused


def approve(rubrics: DataFrame, requirements: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rubrics`` with the drafts in ``wanted`` (id, approved_by, approved_at) approved and their hash frozen; empty ones stay drafts."""
    hashes = content_hash(requirements.withColumnRenamed("rubric_version_id", "rubric_id")).select(F.col("rubric_id").alias("id"), F.col("content_hash").alias("_hash"))
    asked = wanted.select("id", F.col("approved_by").alias("_by"), F.col("approved_at").alias("_at")).join(hashes, "id")
    both = rubrics.join(asked, "id", "left")
    go = F.col("_hash").isNotNull() & editable(F.col("status"))
    new = {"status": F.when(go, "approved").otherwise(F.col("status")), "content_hash": F.when(go, F.col("_hash")).otherwise(F.col("content_hash")), "approved_by": F.when(go, F.col("_by")).otherwise(F.col("approved_by")), "approved_at": F.when(go, F.col("_at")).otherwise(F.col("approved_at"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in rubrics.columns])


def mint_next(rubrics: DataFrame, requirements: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next draft of each approved version in ``wanted`` (id, new_id): requirements are copied, the old version is superseded."""
    from_ = wanted.join(rubrics.filter(scorable(F.col("status"))), "id")
    top = rubrics.groupBy("job_id").agg(F.max("version").alias("_top"))
    drafts = from_.join(top, "job_id").withColumns({"id": F.col("new_id"), "version": F.col("_top") + 1, "status": F.lit("draft"), "content_hash": F.lit(None).cast("string"), "approved_by": F.lit(None).cast("string"), "approved_at": F.lit(None).cast("timestamp")})
    old = rubrics.join(from_.select("id", F.lit(True).alias("_old")), "id", "left").withColumn("status", F.when(F.col("_old"), "superseded").otherwise(F.col("status")))
    copied = requirements.join(from_.select(F.col("id").alias("rubric_version_id"), "new_id"), "rubric_version_id")
    copied = copied.withColumns({"rubric_version_id": F.col("new_id"), "id": F.sha2(F.concat_ws(":", "new_id", F.col("ordinal").cast("string")), 256)})
    return old.select(*rubrics.columns).unionByName(drafts.select(*rubrics.columns)), requirements.unionByName(copied.select(*requirements.columns))


def rescope(requirements: DataFrame, rubric: str = "rubric_id", position: str = "position") -> DataFrame:
    """Requirements as they are stored: ordinal from the position, normalized weights; violations fail the query."""
    done = normalize_weights(requirements, rubric, position)
    checked = F.when(F.col("violation").isNull(), F.col("normalized")).otherwise(F.raise_error(F.col("violation")))
    return done.withColumn("weight", checked.cast(WEIGHT)).withColumn("ordinal", F.col(position)).drop("normalized", "violation")


def latest_approved(rubrics: DataFrame) -> DataFrame:
    """For each job its approved version with the highest number; each task reduces its jobs before the shuffle."""
    rest = [c for c in rubrics.columns if c not in ("tenant_id", "job_id")]
    last = F.max_by(F.struct(*rest), F.struct("version", "id"))
    out = rubrics.filter(scorable(F.col("status"))).groupBy("tenant_id", "job_id").agg(last.alias("_r"))
    return out.select(*[F.col(c) if c in ("tenant_id", "job_id") else F.col(f"_r.{c}").alias(c) for c in rubrics.columns])


#: Starting points for rubrics: (key, name, family, requirements as (text, category, must-have, weight)); own wording.
TEMPLATES = (
    ("backend-engineer", "Backend Engineer", "Engineering", (("Has run production services for three years or more", "experience", True, 5), ("Writes a typed server language well", "skill", True, 4), ("Models relational data and tunes SQL", "skill", False, 4), ("Tests what they deliver", "skill", False, 3))),
    ("customer-support-specialist", "Customer Support Specialist", "Support", (("Has answered customers for a year or more", "experience", True, 5), ("Writes clearly and kindly", "skill", True, 5), ("Works with a ticket system", "skill", False, 2))),
    ("data-scientist", "Data Scientist", "Data", (("Has taken models into production", "experience", True, 5), ("Sound in statistics and experiments", "skill", True, 5), ("Programs in Python with data libraries", "skill", False, 3))),
    ("devops-engineer", "DevOps Engineer", "Engineering", (("Has run cloud infrastructure as code", "experience", True, 5), ("Builds delivery pipelines", "skill", True, 4), ("Handles incidents and monitoring", "skill", False, 4))),
    ("product-manager", "Product Manager", "Product", (("Has shipped products with a team", "experience", True, 5), ("Sets priorities from evidence", "skill", True, 4), ("Talks to customers regularly", "skill", False, 3))),
    ("sales-representative", "Sales Representative", "Sales", (("Has met a sales quota", "experience", True, 5), ("Leads a deal from contact to close", "skill", True, 4), ("Keeps the CRM up to date", "skill", False, 2))),
    ("ux-designer", "UX Designer", "Design", (("Has a portfolio of shipped work", "experience", True, 5), ("Researches with users", "skill", True, 4), ("Prototypes and design systems", "skill", False, 3))),
)


def templates(spark: SparkSession, key: str | None = None) -> DataFrame:
    """Template requirements, one row each, in order of template name; ``key`` is case-sensitive."""
    rows = [(k, name, family, n, *r) for k, name, family, items in TEMPLATES for n, r in enumerate(items) if key in (None, k)]
    return spark.createDataFrame(rows, "key string, name string, role_family string, ordinal int, text string, category string, is_must_have boolean, weight int").orderBy("name", "ordinal")
