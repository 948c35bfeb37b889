"""HTTP, header, robots, sitemap and browser-side analyses.

Robots and sitemap work is per site (``scheme://host``), not per page: the
capture tables are reduced to one row per site first, then looked up by the
pages with a skew-safe join (``lookup.lookup_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import js_round, wp_strip_all_tags
from sitelens.functions.url import site_base
from sitelens.operators.lookup import one_per_key

# Sitemap locations probed, in order (first 200 wins).
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
ROBOTS_PATH = "/robots.txt"
BLOCKS_ALL_RE = r"(?is)User-agent:\s*\*.*?Disallow:\s*/"

# Notes shown by the reference.
PERF_NOTE = "Metrics are estimated via iframe load timing. For precise metrics, use Lighthouse in Chrome DevTools."
MOBILE_NOTE_OK = "Responsive viewport detected."
MOBILE_NOTE_BAD = "No responsive viewport meta tag found. Mobile users may experience issues."
A11Y_NOTE_OK = "All images have alt text."


def header(name: str) -> Column:
    return F.coalesce(F.col("headers").getItem(name), F.lit(""))


def has_header(name: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col("headers"), name), F.lit(False))


def http_summary(status: Column, final_url: Column) -> Column:
    """P1."""
    return F.struct(
        status.cast("bigint").alias("status_code"),
        status.between(200, 299).alias("status_ok"),
        status.between(300, 399).alias("is_redirect"),
        final_url.alias("final_url"),
        final_url.startswith("https://").alias("https"),
    )


def header_summary() -> Column:
    """P2 (expects a lower-cased ``headers`` map)."""
    enc = F.lower(header("content-encoding"))
    return F.struct(
        header("content-type").alias("content_type"),
        enc.alias("content_encoding"),
        enc.contains("gzip").alias("has_gzip"),
        enc.contains("br").alias("has_brotli"),
        header("cache-control").alias("cache_control"),
        header("etag").alias("etag"),
        header("last-modified").alias("last_modified"),
        header("x-powered-by").alias("x_powered_by"),
        header("server").alias("server"),
        header("content-length").alias("content_length"),
    )


def security_summary(final_url: Column) -> Column:
    """P3."""
    return F.struct(
        final_url.startswith("https://").alias("https"),
        header("strict-transport-security").alias("hsts"),
        header("content-security-policy").alias("csp"),
        header("x-frame-options").alias("x_frame_options"),
        header("x-xss-protection").alias("xss_protection"),
        header("referrer-policy").alias("referrer_policy"),
        header("x-content-type-options").alias("x_content_type"),
        header("permissions-policy").alias("permissions_policy"),
        has_header("strict-transport-security").alias("has_hsts"),
        has_header("content-security-policy").alias("has_csp"),
        has_header("x-frame-options").alias("has_x_frame"),
        has_header("x-xss-protection").alias("has_xss_prot"),
        has_header("referrer-policy").alias("has_referrer"),
        has_header("x-content-type-options").alias("has_x_content"),
    )


def robots_by_site(robots: DataFrame) -> DataFrame:
    """P4/P5 per site: ``base, robots_exists, robots_url, robots_content, blocks_all``.

    ``robots`` holds captures of ``base + '/robots.txt'`` (no row = request
    error).  Computed once per site, before any join.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    ok = F.col("status") == 200
    extra = ["fetched_at"] if "fetched_at" in robots.columns else []
    latest = one_per_key(robots.where(F.col("robots_url").endswith(ROBOTS_PATH)).select("robots_url", "status", "content", *extra), ["robots_url"])
    return latest.select(
        F.expr(f"substring(robots_url, 1, length(robots_url) - {len(ROBOTS_PATH)})").alias("base"),
        ok.alias("robots_exists"),
        F.col("robots_url"),
        wp_strip_all_tags(content).alias("robots_content"),
        (ok & content.rlike(BLOCKS_ALL_RE)).alias("blocks_all"),
    )


def sitemap_by_site(sitemaps: DataFrame) -> DataFrame:
    """P6 per site: first probed location answering 200.

    ``min(rank)`` keeps a fixed-width hash aggregate (partial + final, no sort);
    the winning URL is rebuilt from the rank.
    """
    rank = None
    base = None
    for i, path in enumerate(SITEMAP_PATHS):
        cond = F.col("sitemap_url").endswith(path)
        b = F.expr(f"substring(sitemap_url, 1, length(sitemap_url) - {len(path)})")
        rank = F.when(cond, F.lit(i)) if rank is None else rank.when(cond, F.lit(i))
        base = F.when(cond, b) if base is None else base.when(cond, b)
    hits = sitemaps.where(F.col("status") == 200).select(base.alias("base"), rank.alias("rank"))
    paths = F.array(*[F.lit(x) for x in SITEMAP_PATHS])
    return (
        hits.where(F.col("rank").isNotNull())
        .groupBy("base")
        .agg(F.min("rank").alias("rank"))
        .select("base", F.lit(True).alias("sitemap_exists"), F.concat("base", F.get(paths, F.col("rank"))).alias("sitemap_url"))
    )


def site_info(robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """One row per site with robots and sitemap facts (both per-site tables, small)."""
    return robots_by_site(robots).join(sitemap_by_site(sitemaps), "base", "full")


def robots_struct() -> Column:
    """Report ``robots`` record; a request error has no ``url`` (null)."""
    exists = F.coalesce(F.col("robots_exists"), F.lit(False))
    return F.struct(
        exists.alias("exists"),
        F.col("robots_url").alias("url"),
        F.coalesce(F.col("robots_content"), F.lit("")).alias("content"),
        F.coalesce(F.col("blocks_all"), F.lit(False)).alias("blocks_all"),
    )


def sitemap_struct() -> Column:
    return F.struct(
        F.coalesce(F.col("sitemap_exists"), F.lit(False)).alias("exists"),
        F.coalesce(F.col("sitemap_url"), F.lit("")).alias("url"),
    )


def performance(load_ms: Column, nav_ttfb_ms: Column) -> Column:
    """Estimates from the load time L; unknown L keeps only the navigation TTFB."""
    has_l = F.coalesce(load_ms, F.lit(0.0)) != 0
    nav = F.when(F.coalesce(nav_ttfb_ms, F.lit(0.0)) != 0, nav_ttfb_ms)

    def part(k: float) -> Column:
        return F.when(has_l, js_round(load_ms * F.lit(k)))

    return F.struct(
        F.when(has_l, js_round(load_ms)).otherwise(F.lit(0)).cast("bigint").alias("load_time_ms"),
        F.when(has_l, js_round(load_ms * F.lit(0.15))).otherwise(js_round(nav)).alias("ttfb_ms"),
        part(0.30).alias("fcp_ms"),
        part(0.55).alias("lcp_ms"),
        F.lit(None).cast("double").alias("cls"),
        part(0.60).alias("speed_index_ms"),
        F.lit(PERF_NOTE).alias("note"),
    )


def mobile(viewport: Column) -> Column:
    """P9."""
    v = F.coalesce(viewport, F.lit(""))
    responsive = v.contains("width=device-width")
    return F.struct(
        (v != "").alias("has_viewport"),
        responsive.alias("is_responsive"),
        v.alias("viewport_content"),
        responsive.alias("touch_friendly"),
        F.when(responsive, F.lit(MOBILE_NOTE_OK)).otherwise(F.lit(MOBILE_NOTE_BAD)).alias("notes"),
    )


def accessibility(images: Column) -> Column:
    """P10: alt score = round(with / total * 100) in that operation order."""
    total = F.size(images).cast("bigint")
    with_alt = F.size(F.filter(images, lambda i: i["has_alt"])).cast("bigint")
    missing = total - with_alt
    return F.struct(
        total.alias("total_images"),
        with_alt.alias("images_with_alt"),
        missing.alias("images_missing_alt"),
        F.when(total > 0, js_round(with_alt / total * F.lit(100.0))).otherwise(F.lit(100)).cast("bigint").alias("alt_text_score"),
        F.lit(None).cast("boolean").alias("has_lang_attr"),
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" image(s) missing alt text."))).otherwise(F.lit(A11Y_NOTE_OK)).alias("notes"),
    )


def technical(http: Column, headers: Column, html_meta: Column, robots: Column, sitemap: Column) -> Column:
    """P11."""
    return F.struct(
        http["status_code"].alias("status_code"),
        http["https"].alias("https"),
        headers["has_gzip"].alias("has_gzip"),
        headers["has_brotli"].alias("has_brotli"),
        headers["cache_control"].alias("cache_control"),
        headers["server"].alias("server"),
        F.lit(None).cast("boolean").alias("has_lazy_loading"),
        F.coalesce(html_meta["page_size_kb"], F.lit(0.0)).alias("page_size_kb"),
        (robots["exists"] & ~robots["blocks_all"]).alias("robots_ok"),
        sitemap["exists"].alias("sitemap_ok"),
    )
