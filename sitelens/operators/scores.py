"""Category scores, overall score, bands, summary sentence, score cards.

All plain ``when``/``greatest`` arithmetic over report columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import WEIGHTS
from sitelens.functions.text import js_round
from sitelens.functions.url import strip_scheme_and_slash

# Score-card order and labels; band thresholds 80 / 60.
CARDS = [
    ("performance", "Performance"),
    ("seo", "SEO"),
    ("security", "Security"),
    ("mobile", "Mobile"),
    ("technical", "Technical"),
    ("accessibility", "Accessibility"),
]


def _pen(cond: Column, points) -> Column:
    p = points if isinstance(points, Column) else F.lit(points)
    return F.when(cond, p).otherwise(F.lit(0))


def seo_score(seo: Column, robots: Column, sitemap: Column) -> Column:
    """C1."""
    title_pen = F.when(seo["title"] == "", 20).when((seo["title_length"] < 10) | (seo["title_length"] > 70), 10).otherwise(0)
    iwa = seo["images_without_alt"]
    s = (
        F.lit(100)
        - title_pen
        - _pen(seo["meta_description"] == "", 15)
        - _pen(seo["canonical"] == "", 5)
        - _pen(~seo["has_og"], 5)
        - _pen(~seo["has_schema"], 5)
        - _pen(seo["is_noindex"], 30)
        - _pen(iwa > 0, F.least(F.lit(15), iwa * 3))
        - _pen(F.size(seo["headings"]["h1"]) == 0, 10)
        - _pen(~robots["exists"], 5)
        - _pen(~sitemap["exists"], 5)
    )
    return F.greatest(F.lit(0), s).cast("bigint")


def security_score(sec: Column) -> Column:
    """C2."""
    s = (
        F.lit(100)
        - _pen(~sec["https"], 30)
        - _pen(~sec["has_hsts"], 15)
        - _pen(~sec["has_csp"], 15)
        - _pen(~sec["has_x_frame"], 10)
        - _pen(~sec["has_x_content"], 10)
        - _pen(~sec["has_referrer"], 5)
        - _pen(~sec["has_xss_prot"], 5)
    )
    return F.greatest(F.lit(0), s).cast("bigint")


def mobile_score(mob: Column) -> Column:
    """C3."""
    s = F.lit(100) - _pen(~mob["has_viewport"], 40) - _pen(~mob["is_responsive"], 30)
    return F.greatest(F.lit(0), s).cast("bigint")


def accessibility_score(a11y: Column) -> Column:
    """C4."""
    return F.coalesce(a11y["alt_text_score"], F.lit(100)).cast("bigint")


def technical_score(tech: Column) -> Column:
    """C5."""
    s = (
        F.lit(100)
        - _pen(F.coalesce(tech["status_code"] != 200, F.lit(True)), 30)
        - _pen(~tech["https"], 15)
        - _pen(~tech["has_gzip"] & ~tech["has_brotli"], 10)
        - _pen(~tech["robots_ok"], 10)
        - _pen(~tech["sitemap_ok"], 5)
    )
    return F.greatest(F.lit(0), s).cast("bigint")


def performance_score(perf: Column) -> Column:
    """By load time; 0 or unknown scores 100."""
    lt = F.coalesce(perf["load_time_ms"], F.lit(0))
    return (
        F.when(lt > 10000, 20)
        .when(lt > 5000, 40)
        .when(lt > 3000, 60)
        .when(lt > 1500, 75)
        .when(lt > 800, 90)
        .otherwise(100)
        .cast("bigint")
    )


def overall_score(scores: dict[str, Column]) -> Column:
    """Weighted sum in the reference's order, JS rounding."""
    total = None
    for key, w in WEIGHTS:
        term = scores[key] * F.lit(float(w))
        total = term if total is None else total + term
    return js_round(total)


def with_scores(report: DataFrame) -> DataFrame:
    """Adds the ``scores`` struct to an assembled report."""
    parts = {
        "seo": seo_score(F.col("seo"), F.col("robots"), F.col("sitemap")),
        "security": security_score(F.col("security")),
        "performance": performance_score(F.col("performance")),
        "mobile": mobile_score(F.col("mobile")),
        "technical": technical_score(F.col("technical")),
        "accessibility": accessibility_score(F.col("accessibility")),
    }
    staged = report.withColumn("_s", F.struct(*[v.alias(k) for k, v in parts.items()]))
    s = {k: F.col("_s")[k] for k in parts}
    scores = F.struct(
        overall_score(s).alias("overall"),
        *[s[k].alias(k) for k in ("seo", "security", "performance", "mobile", "technical", "accessibility")],
    )
    return staged.withColumn("scores", scores).drop("_s")


def band(score: Column) -> Column:
    """C9."""
    return F.when(score >= 80, F.lit("green")).when(score >= 60, F.lit("amber")).otherwise(F.lit("red"))


def auto_summary(url: Column, scores: Column) -> Column:
    """C10."""
    weak = F.array_compact(
        F.array(
            F.when(scores["security"] < 60, F.lit("security headers")),
            F.when(scores["seo"] < 60, F.lit("SEO metadata")),
            F.when(scores["mobile"] < 70, F.lit("mobile optimisation")),
            F.when(scores["performance"] < 60, F.lit("performance")),
        )
    )
    u = strip_scheme_and_slash(url)
    overall = F.coalesce(scores["overall"].cast("string"), F.lit("null"))  # as the reference prints it
    return F.when(
        F.size(weak) == 0,
        F.concat(u, F.lit(" scores "), overall, F.lit("/100 overall and looks healthy across all categories.")),
    ).otherwise(F.concat(u, F.lit(" scores "), overall, F.lit("/100. Key areas for improvement: "), F.array_join(weak, ", "), F.lit(".")))


def score_cards(report: DataFrame, id_col: str = "page_id") -> DataFrame:
    """C11: six cards per page in fixed order; an AI rating takes precedence."""
    has_ai = "ai" in report.columns
    cards = []
    for i, (key, label) in enumerate(CARDS):
        val = F.col("scores")[key]
        if has_ai:
            val = F.coalesce(F.col("ai")["ratings"][key], val)
        val = F.coalesce(val, F.lit(0)).cast("bigint")
        cards.append(F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"), val.alias("score")))
    out = report.select(id_col, F.explode(F.array(*cards)).alias("c"))
    return out.select(id_col, "c.ord", "c.key", "c.label", "c.score", band(F.col("c.score")).alias("band"))
