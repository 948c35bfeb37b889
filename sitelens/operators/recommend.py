"""Recommendations (R1-R3): rule list, priority order, AI precedence.

Everything stays inside the row: the rule list is an array built with
``when``, sorted with ``array_sort`` on ``(priority rank, rule order)``
(stable by construction) and exploded; there is no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priority ranks; unknown priorities sort last.
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER_RANK = 99

# The rule recommendations, in the reference's order.
RULES = [
    ("no_title", "Add a page title", "Every page needs a descriptive title tag (30–70 characters).", "critical", "seo"),
    ("no_description", "Add a meta description", "Meta descriptions (120–160 chars) improve click-through rates in search results.", "high", "seo"),
    ("no_https", "Enable HTTPS", "HTTPS is required for security and is a ranking signal for Google.", "critical", "security"),
    ("no_hsts", "Add HSTS header", "Strict-Transport-Security header prevents protocol downgrade attacks.", "high", "security"),
    ("no_csp", "Add Content Security Policy", "CSP header reduces XSS attack surface significantly.", "high", "security"),
    ("not_responsive", "Add responsive viewport",
     'Missing viewport meta tag will cause poor mobile experience. Add <meta name="viewport" content="width=device-width, initial-scale=1">.',
     "critical", "mobile"),
    ("no_og", "Add Open Graph tags", "OG tags control how your page appears when shared on social networks.", "medium", "seo"),
    ("no_schema", "Add Schema.org markup", "Structured data helps search engines understand your content and enables rich results.", "medium", "seo"),
    ("no_compression", "Enable compression", "Enable Gzip or Brotli compression to reduce page size and improve load times.", "high", "technical"),
    ("missing_alt", "Fix {n} missing alt texts", "Alt text improves accessibility and helps search engines understand image content.", "medium", "seo"),
    ("no_sitemap", "Add a sitemap", "A sitemap.xml helps search engines discover and crawl all your pages.", "medium", "seo"),
]


def priority_rank(p: Column) -> Column:
    expr = None
    for k, v in PRIORITY_RANK.items():
        expr = F.when(p == k, F.lit(v)) if expr is None else expr.when(p == k, F.lit(v))
    return expr.otherwise(F.lit(OTHER_RANK))


def _rec(ord_: int, title: Column, description: str, priority: str, category: str) -> Column:
    return F.struct(
        F.lit(PRIORITY_RANK[priority]).alias("prank"),
        F.lit(ord_).alias("ord"),
        title.alias("title"),
        F.lit(description).alias("description"),
        F.lit(priority).alias("priority"),
        F.lit(category).alias("category"),
    )


def rule_recommendations() -> Column:
    """The array of applicable rule recommendations (unsorted, rule order)."""
    seo, sec, mob, tech = F.col("seo"), F.col("security"), F.col("mobile"), F.col("technical")
    iwa = seo["images_without_alt"]
    conds = {
        "no_title": seo["title"] == "",
        "no_description": seo["meta_description"] == "",
        "no_https": ~sec["https"],
        "no_hsts": ~sec["has_hsts"],
        "no_csp": ~sec["has_csp"],
        "not_responsive": ~mob["is_responsive"],
        "no_og": ~seo["has_og"],
        "no_schema": ~seo["has_schema"],
        "no_compression": ~tech["has_gzip"] & ~tech["has_brotli"],
        "missing_alt": iwa > 0,
        "no_sitemap": ~F.col("sitemap")["exists"],
    }
    items = []
    for i, (key, title, desc, prio, cat) in enumerate(RULES):
        t = F.lit(title)
        if "{n}" in title:
            a, b = title.split("{n}")
            t = F.concat(F.lit(a), iwa.cast("string"), F.lit(b))
        items.append(F.when(conds[key], _rec(i, t, desc, prio, cat)))
    return F.array_compact(F.array(*items))


def ai_recommendations(ai_recs: Column) -> Column:
    """AI list in the same shape (rank from its priority, order = list position)."""
    return F.transform(
        ai_recs,
        lambda r, i: F.struct(
            priority_rank(r["priority"]).alias("prank"), i.alias("ord"), r["title"].alias("title"),
            r["description"].alias("description"), r["priority"].alias("priority"), r["category"].alias("category"),
        ),
    )


def recommendations(reports: DataFrame, id_col: str = "page_id") -> DataFrame:
    """R1-R3 long form: ``id, rank, title, description, priority, category, source``.

    An AI result with a ``recommendations`` list (even empty) replaces the rules.
    """
    rules = rule_recommendations()
    if "ai" in reports.columns:
        ai_list = F.col("ai")["recommendations"]
        chosen = F.when(ai_list.isNotNull(), ai_recommendations(ai_list)).otherwise(rules)
        source = F.when(ai_list.isNotNull(), F.lit("ai")).otherwise(F.lit("rules"))
    else:
        chosen, source = rules, F.lit("rules")
    x = reports.select(id_col, source.alias("source"), F.array_sort(chosen).alias("recs"))
    y = x.select(id_col, "source", F.posexplode("recs").alias("rank", "r"))
    return y.select(
        id_col, F.col("rank").cast("bigint").alias("rank"), "r.title", "r.description", "r.priority", "r.category", "source",
    )
