"""The page audit pipeline: captures -> report -> scores.

Plan shape (see ``explain``): the crawl scan and every feature expression run
in one narrow stage per input split; the body column is dropped inside that
stage, so the only shuffle carries small per-page feature rows into a
skew-safe lookup join with the per-site robots/sitemap table (itself a small aggregate,
broadcast by AQE when its measured size allows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.url import site_base
from sitelens.operators import http as H
from sitelens.operators.extract import with_page_features
from sitelens.operators.frontier import resolve_redirects
from sitelens.operators.lookup import lookup_join, one_per_key
from sitelens.operators.scores import with_scores
from sitelens.sources.captures import normalize_crawl, normalize_robots

FETCH_FAILED = "fetch failed"  # error of a final URL whose capture failed or is missing
REPORT_FIELDS = [
    "url", "timestamp", "http", "headers", "seo", "security", "robots", "sitemap", "html_meta",
    "performance", "mobile", "accessibility", "technical",
]


def page_features(crawl: DataFrame) -> DataFrame:
    """Per-page server-side features; failed fetches (``error`` set) are skipped."""
    c = normalize_crawl(crawl)
    if "error" in c.columns:
        c = c.where(F.col("error").isNull())
    return with_page_features(c)


def assemble_reports(crawl: DataFrame, robots: DataFrame, sitemaps: DataFrame, row_id: str = "url") -> DataFrame:
    """One report row per page (final URL), html already dropped."""
    f = page_features(crawl).withColumn("_base", site_base(F.col("url")))
    sites = H.site_info(normalize_robots(robots), sitemaps).withColumnRenamed("base", "_base")
    j = lookup_join(f, sites, ["_base"], [row_id])
    http = H.http_summary(F.col("status"), F.col("url"))
    keep = [c for c in ("page_id", "submitted_url", "user_id", "duration_ms") if c in crawl.columns]
    rep = j.select(
        *keep,
        F.col("url"),
        F.col("fetched_at").alias("timestamp") if "fetched_at" in j.columns else F.current_timestamp().alias("timestamp"),
        http.alias("http"),
        H.header_summary().alias("headers"),
        F.col("seo"),
        H.security_summary(F.col("url")).alias("security"),
        H.robots_struct().alias("robots"),
        H.sitemap_struct().alias("sitemap"),
        F.col("html_meta"),
        H.performance(F.col("load_ms"), F.col("nav_ttfb_ms")).alias("performance"),
        H.mobile(F.col("seo")["viewport"]).alias("mobile"),
        H.accessibility(F.col("seo")["images"]).alias("accessibility"),
    )
    return rep.withColumn(
        "technical",
        H.technical(F.col("http"), F.col("headers"), F.col("html_meta"), F.col("robots"), F.col("sitemap")),
    )


def page_scorecard(crawl: DataFrame, robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """C8 (flagship): reports with the ``scores`` struct."""
    return with_scores(assemble_reports(crawl, robots, sitemaps))


def redirected_scorecard(
    starts: DataFrame, redirects: DataFrame, dns: DataFrame, crawl: DataFrame, robots: DataFrame, sitemaps: DataFrame, row_id: str = "request_id"
) -> tuple[DataFrame, DataFrame]:
    """P7 on D2: submitted URLs to the scorecards of the pages that they lead to, and
    the outcome of every request (S6).

    ``starts``: ``request_id, submitted_url``.  Each captured page is analysed once
    and its body dropped before anything is shuffled; the requests then look up the
    report of their ``final_url``.  The scorecards have ``submitted_url``, ``final_url``
    and ``redirects`` besides the report.  The outcomes (``request_id, submitted_url,
    duration_ms, success, error, user_id, created_at``) hold failed chains and failed
    or missing captures as failures.
    """
    resolved = resolve_redirects(starts, redirects, dns, row_id=row_id)
    reports = page_scorecard(crawl, robots, sitemaps).drop("page_id").withColumnRenamed("url", "final_url")
    latest = Window.partitionBy("final_url").orderBy(F.desc("timestamp"))
    reports = reports.withColumn("_nr", F.row_number().over(latest)).filter("_nr = 1").drop("_nr", "duration_ms", "user_id")
    cards = lookup_join(resolved.filter("error IS NULL").drop("error"), reports, ["final_url"], [row_id], "inner")

    failed = F.col("error").isNotNull() if "error" in crawl.columns else F.lit(False)
    fetched = one_per_key(
        crawl.select(F.col("url").alias("final_url"), "fetched_at", "duration_ms", failed.alias("failed"), "user_id"), ["final_url"]
    )
    j = lookup_join(resolved.withColumn("_key", F.coalesce("final_url", F.concat(F.lit("\n"), F.col(row_id).cast("string")))),
                    fetched.withColumnRenamed("final_url", "_key"), ["_key"], [row_id])
    error = F.coalesce("error", F.when(F.coalesce("failed", F.lit(True)), F.lit(FETCH_FAILED)))
    outcomes = j.select(
        row_id, "submitted_url", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), error.isNull().alias("success"), error.alias("error"),
        F.col("user_id"), F.col("fetched_at").alias("created_at"),
    )
    return cards, outcomes
