"""Model-review batch (A1-A7): request building and response merging.

The network call itself is outside the engine.  Job 1 writes one request row
per report (payload + prompt); job 2 reads the captured responses, parses and
validates them with native JSON functions and joins them back by URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.json import pretty_json
from sitelens.functions.text import js_round, php_empty
from sitelens.operators.lookup import one_per_key

# Error messages and generation settings of the reference.
MSG_API_ERROR = "Gemini API error"
MSG_EMPTY = "Empty response from Gemini API."
MSG_INVALID = "Invalid JSON response from Gemini API."
GENERATION_CONFIG = '{"temperature":0.2,"responseMimeType":"application/json"}'
PAYLOAD_IMAGES = 10

# The prompt text around the JSON payload.
PROMPT_HEAD = (
    "You are an expert website analyst. Analyze the following website data and provide a comprehensive assessment.\n\n"
    "IMPORTANT: Use ONLY the provided data. Do not make assumptions beyond what is given.\n\n"
    "Website Data:\n"
)
PROMPT_TAIL = """

Respond ONLY with a valid JSON object (no markdown, no preamble) with this exact structure:
{
  "overall_score": <integer 0-100>,
  "summary": "<2-3 sentence executive summary>",
  "ratings": {
    "performance": <0-100>,
    "seo": <0-100>,
    "security": <0-100>,
    "mobile": <0-100>,
    "accessibility": <0-100>,
    "technical": <0-100>
  },
  "critical_issues": [
    {"issue": "<issue title>", "description": "<details>", "priority": "critical|high|medium|low"}
  ],
  "seo_report": {
    "assessment": "<paragraph>",
    "strengths": ["<item>"],
    "weaknesses": ["<item>"]
  },
  "performance_tips": ["<actionable tip>"],
  "content_analysis": "<paragraph about content quality and structure>",
  "recommendations": [
    {"title": "<title>", "description": "<details>", "priority": "critical|high|medium|low", "category": "seo|performance|security|accessibility|technical"}
  ],
  "ai_notes": "<additional expert observations>"
}"""

_REC = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "priority", "category")])
_ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("issue", "description", "priority")])
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("ratings", T.StructType([T.StructField(k, T.StringType()) for k in
                                               ("performance", "seo", "security", "mobile", "accessibility", "technical")])),
        T.StructField("critical_issues", T.ArrayType(_ISSUE)),
        T.StructField("seo_report", T.StructType([
            T.StructField("assessment", T.StringType()),
            T.StructField("strengths", T.ArrayType(T.StringType())),
            T.StructField("weaknesses", T.ArrayType(T.StringType())),
        ])),
        T.StructField("performance_tips", T.ArrayType(T.StringType())),
        T.StructField("content_analysis", T.StringType()),
        T.StructField("recommendations", T.ArrayType(_REC)),
        T.StructField("ai_notes", T.StringType()),
    ]
)


def review_payload(reports: DataFrame, id_col: str = "page_id", images: int = PAYLOAD_IMAGES) -> DataFrame:
    """A1: the report with at most ``images`` images (``seo.total_images`` keeps their
    number), as a struct column ``payload``."""
    cols = [c for c in reports.columns if c != id_col]
    slim = reports.withColumn("seo", F.col("seo").withField("images", F.slice(F.col("seo.images"), 1, images)))
    return slim.select(id_col, "url", F.struct(*[F.col(c) for c in cols]).alias("payload"))


def review_requests(reports: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A2: one request row per report: prompt text and generation settings."""
    p = review_payload(reports, id_col)
    prompt = F.concat(F.lit(PROMPT_HEAD), pretty_json(F.col("payload"), p.schema["payload"].dataType), F.lit(PROMPT_TAIL))
    return p.select(id_col, "url", prompt.alias("prompt"), F.lit(GENERATION_CONFIG).alias("generation_config"))


def is_json_container(text: Column) -> Column:
    """Decodes to an object or an array (PHP ``is_array`` after ``json_decode``)."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    return v.isNotNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))


def esc_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parse_responses(responses: DataFrame) -> DataFrame:
    """A3: ``url, ok, error_message, text`` per captured response."""
    text = F.get_json_object(F.col("body"), "$.candidates[0].content.parts[0].text")
    api_msg = F.coalesce(F.get_json_object(F.col("body"), "$.error.message"), F.lit(MSG_API_ERROR))
    err = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status") != 200, esc_html(api_msg))
        .when(php_empty(text), F.lit(MSG_EMPTY))
        .when(~is_json_container(text), F.lit(MSG_INVALID))
    )
    keep = [c for c in responses.columns if c not in ("status", "body", "error")]
    return responses.select(*keep, err.isNull().alias("ok"), err.alias("error_message"), F.when(err.isNull(), text).alias("text"))


def _rounded(number: Column) -> Column:
    """A score as the nearest whole number; fractions and quoted numbers count too."""
    return js_round(number.try_cast("double"))


def review_struct(text: Column) -> Column:
    """Typed review fields plus the presence and value of ``overall_score``."""
    parsed = F.from_json(text, REVIEW_SCHEMA)
    keys = F.json_object_keys(text)
    return F.struct(
        F.coalesce(F.array_contains(keys, "overall_score"), F.lit(False)).alias("has_overall"),
        _rounded(F.get_json_object(text, "$.overall_score")).alias("overall_score"),
        *[
            F.struct(*[_rounded(parsed["ratings"][k.name]).alias(k.name) for k in f.dataType.fields]).alias("ratings")
            if f.name == "ratings"
            else parsed[f.name].alias(f.name)
            for f in REVIEW_SCHEMA.fields
        ],
    )


def merge_reviews(scored: DataFrame, parsed: DataFrame) -> DataFrame:
    """A4: successful reviews joined by URL as column ``ai``; ``scores.overall``
    replaced when the review has the key (even when its value is null)."""
    # a URL may have been answered more than once; its key is no hot one, so no salt
    ok = one_per_key(parsed.where("ok").select("url", "text"), ["url"]).select("url", review_struct(F.col("text")).alias("ai"))
    j = scored.join(ok, "url", "left")
    overall = F.when(F.col("ai.has_overall"), F.col("ai.overall_score")).otherwise(F.col("scores.overall"))
    return j.withColumn("scores", F.col("scores").withField("overall", overall))


def summary_with_review(auto: Column) -> Column:
    """A5: the review's summary unless empty, else the rule sentence."""
    s = F.col("ai.summary")
    return F.when(F.coalesce(s, F.lit("")) != "", s).otherwise(auto)


def review_issues(parsed: DataFrame) -> DataFrame:
    """Critical issues long form; class defaults to ``medium``, badge keeps the raw value."""
    r = parsed.where("ok").select("url", review_struct(F.col("text")).alias("ai"))
    x = r.select("url", F.posexplode(F.coalesce(F.col("ai.critical_issues"), F.array())).alias("pos", "i"))
    return x.select(
        "url", F.col("pos").cast("bigint").alias("pos"), F.col("i.issue").alias("issue"), F.col("i.description").alias("description"),
        F.col("i.priority").alias("priority"),
        F.when(F.coalesce(F.col("i.priority"), F.lit("")) != "", F.col("i.priority")).otherwise(F.lit("medium")).alias("priority_class"),
    )


def review_tips(parsed: DataFrame) -> DataFrame:
    """Performance tips long form."""
    r = parsed.where("ok").select("url", review_struct(F.col("text")).alias("ai"))
    x = r.select("url", F.posexplode(F.coalesce(F.col("ai.performance_tips"), F.array())).alias("pos", "tip"))
    return x.select("url", F.col("pos").cast("bigint").alias("pos"), "tip")


def valid_review_request(payload: Column) -> Column:
    """A non-empty payload that decodes to an object or array."""
    return ~php_empty(payload) & is_json_container(payload)
