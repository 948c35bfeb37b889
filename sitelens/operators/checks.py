"""Check tables (K1-K9): one row per page x check, from one literal-shaped array.

``page_checks`` builds a single ``array<struct>`` per report and explodes it,
so all tabs come from one pass over the reports (no unions, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display strings of the reference.
DASH = "—"
ELLIPSIS = "…"


def format_ms(ms: Column) -> Column:
    """K9: ``x.xxs`` from 1000 ms, else ``nms``.

    The seconds are rounded as JavaScript's ``toFixed(2)`` does: by the double's
    exact value, so 1005 ms (a double just below 1.005) is ``1.00s`` and 1025 ms
    ``1.02s``, while 1125 ms, an exact tie, goes up.  Only whole ms that end in 5
    are in doubt; there the double is split into two halves whose products by 200
    are exact, and compared with the odd whole number that the tie would give.
    """
    ms = ms.cast("bigint")
    x = ms / F.lit(1000.0)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    odd = (ms / F.lit(5.0)).cast("double")
    above = (high * 200 - odd) + (x - high) * 200 >= 0
    last = ms % 10
    h = F.floor(ms / 10).cast("bigint") + F.when((last > 5) | ((last == 5) & above), 1).otherwise(0)
    secs = F.concat((h / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms >= 1000, secs).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def js_number(x: Column) -> Column:
    """JS ``String(number)`` for the non-negative doubles shown here (3 -> '3', 2.5 -> '2.5')."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def _row(tab: str, ord_: int, label: str, status: Column | None, detail: Column) -> Column:
    return F.struct(
        F.lit(tab).alias("tab"),
        F.lit(ord_).cast("bigint").alias("ord"),
        F.lit(label).alias("label"),
        (status if status is not None else F.lit(None).cast("string")).alias("status"),
        detail.cast("string").alias("detail"),
    )


def _pf(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("pass")).otherwise(F.lit("fail"))


def _pw(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("pass")).otherwise(F.lit("warn"))


def _gw(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(True)), F.lit("good")).otherwise(F.lit("warn"))


def _or(value: Column, fallback: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(fallback))


def check_rows() -> Column:
    """The array of all check rows of one report (K1-K8)."""
    p, seo, sec = F.col("performance"), F.col("seo"), F.col("security")
    mob, tech, hdr, a11y = F.col("mobile"), F.col("technical"), F.col("headers"), F.col("accessibility")
    rob, smap, http = F.col("robots"), F.col("sitemap"), F.col("http")

    def metric(ms: Column) -> Column:
        return F.when(F.coalesce(ms, F.lit(0)) != 0, format_ms(ms)).otherwise(F.lit(DASH))

    h1 = seo["headings"]["h1"]
    perf = [
        _row("performance", 0, "Load Time", _gw(p["load_time_ms"] < 2000), metric(p["load_time_ms"])),
        _row("performance", 1, "TTFB", _gw(p["ttfb_ms"] < 200), metric(p["ttfb_ms"])),
        _row("performance", 2, "First Contentful Paint", _gw(p["fcp_ms"] < 1800), metric(p["fcp_ms"])),
        _row("performance", 3, "Largest Contentful Paint", _gw(p["lcp_ms"] < 2500), metric(p["lcp_ms"])),
        _row("performance", 4, "Cumulative Layout Shift", F.lit("good"),
             F.when(p["cls"].isNotNull(), p["cls"].cast("string")).otherwise(F.lit("N/A"))),
        _row("performance", 5, "Speed Index", _gw(p["speed_index_ms"] < 3400), metric(p["speed_index_ms"])),
    ]
    seo_rows = [
        _row("seo", 0, "Page Title", _pf(seo["title"] != ""), _or(seo["title"], "Missing")),
        _row("seo", 1, "Meta Description", _pf(seo["meta_description"] != ""), _or(seo["meta_description"], "Missing")),
        _row("seo", 2, "Canonical URL", _pf(seo["canonical"] != ""), _or(seo["canonical"], "Missing")),
        _row("seo", 3, "Robots Meta", _pf(~seo["is_noindex"]), _or(seo["robots_meta"], "Not set (indexable by default)")),
        _row("seo", 4, "Open Graph", _pf(seo["has_og"]), F.when(seo["has_og"], F.lit("Present")).otherwise(F.lit("Missing"))),
        _row("seo", 5, "Twitter Cards", _pf(seo["has_twitter"]), F.when(seo["has_twitter"], F.lit("Present")).otherwise(F.lit("Missing"))),
        _row("seo", 6, "Schema.org", _pf(seo["has_schema"]),
             F.when(seo["has_schema"], F.concat(F.size(seo["schema"]).cast("string"), F.lit(" type(s)"))).otherwise(F.lit("Missing"))),
        _row("seo", 7, "H1 Tag", _pf(F.size(h1) > 0), _or(F.array_join(h1, ", "), "Missing")),
        _row("seo", 8, "robots.txt", _pf(rob["exists"]), F.when(rob["exists"], rob["url"]).otherwise(F.lit("Not found"))),
        _row("seo", 9, "sitemap.xml", _pf(smap["exists"]), F.when(smap["exists"], smap["url"]).otherwise(F.lit("Not found"))),
        _row("seo", 10, "HTTPS", _pf(http["https"]), F.when(http["https"], F.lit("Active")).otherwise(F.lit("Not active"))),
        _row("seo", 11, "Indexable", _pf(~seo["is_noindex"] & ~rob["blocks_all"]),
             F.when(seo["is_noindex"], F.lit("Blocked by noindex")).when(rob["blocks_all"], F.lit("Blocked by robots.txt")).otherwise(F.lit("Indexable"))),
    ]
    links = [
        _row("links", 0, "Internal Links", None, F.coalesce(seo["internal_links"], F.lit(0))),
        _row("links", 1, "External Links", None, F.coalesce(seo["external_links"], F.lit(0))),
        _row("links", 2, "Images", None, F.coalesce(seo["total_images"], F.lit(0))),
        _row("links", 3, "Missing Alt Text", F.when(seo["images_without_alt"] > 0, F.lit("warn")).otherwise(F.lit("good")),
             F.coalesce(seo["images_without_alt"], F.lit(0))),
    ]

    def not_set(v: Column) -> Column:
        return _or(v, "Not set")

    security = [
        _row("security", 0, "HTTPS", _pf(sec["https"]), F.when(sec["https"], F.lit("Active")).otherwise(F.lit("Not active"))),
        _row("security", 1, "HSTS", _pf(sec["has_hsts"]), not_set(sec["hsts"])),
        _row("security", 2, "Content Security Policy", _pf(sec["has_csp"]),
             F.when(sec["csp"] != "", F.concat(F.substring(sec["csp"], 1, 80), F.lit(ELLIPSIS))).otherwise(F.lit("Not set"))),
        _row("security", 3, "X-Frame-Options", _pf(sec["has_x_frame"]), not_set(sec["x_frame_options"])),
        _row("security", 4, "XSS Protection", _pf(sec["has_xss_prot"]), not_set(sec["xss_protection"])),
        _row("security", 5, "Referrer Policy", _pf(sec["has_referrer"]), not_set(sec["referrer_policy"])),
        _row("security", 6, "X-Content-Type-Options", _pf(sec["has_x_content"]), not_set(sec["x_content_type"])),
        _row("security", 7, "Permissions Policy", _pf(sec["permissions_policy"] != ""), not_set(sec["permissions_policy"])),
    ]
    mobile = [
        _row("mobile", 0, "Viewport meta tag", _pf(mob["has_viewport"]), _or(mob["viewport_content"], "Missing")),
        _row("mobile", 1, "Responsive design", _pf(mob["is_responsive"]),
             F.when(mob["is_responsive"], F.lit("Detected")).otherwise(F.lit("Not detected"))),
        _row("mobile", 2, "Touch-friendly", _pf(mob["touch_friendly"]),
             F.when(mob["touch_friendly"], F.lit("Likely yes")).otherwise(F.lit("Uncertain"))),
    ]
    comp = tech["has_gzip"] | tech["has_brotli"]
    technical = [
        _row("technical", 0, "HTTP Status", _pf(tech["status_code"] == 200), tech["status_code"]),
        _row("technical", 1, "HTTPS", _pf(tech["https"]), F.when(tech["https"], F.lit("Active")).otherwise(F.lit("Not active"))),
        _row("technical", 2, "Compression", _pf(comp),
             F.when(tech["has_brotli"], F.lit("Brotli")).when(tech["has_gzip"], F.lit("Gzip")).otherwise(F.lit("None"))),
        _row("technical", 3, "Cache-Control", _pw(tech["cache_control"] != ""), _or(tech["cache_control"], "Not set")),
        _row("technical", 4, "robots.txt", _pf(tech["robots_ok"]),
             F.when(tech["robots_ok"], F.lit("OK")).otherwise(F.lit("Missing or blocking all"))),
        _row("technical", 5, "Sitemap", _pw(tech["sitemap_ok"]), F.when(tech["sitemap_ok"], F.lit("Found")).otherwise(F.lit("Not found"))),
    ]
    server = [
        _row("server", 0, "Server", None, _or(hdr["server"], "Unknown")),
        _row("server", 1, "Content-Type", None, _or(hdr["content_type"], DASH)),
        _row("server", 2, "Page Size", None,
             F.concat(js_number(F.coalesce(F.col("html_meta")["page_size_kb"], F.lit(0.0))), F.lit(" KB"))),
    ]
    access = [
        _row("accessibility", 0, "Image alt texts", _pf(a11y["images_missing_alt"] == 0),
             F.concat(a11y["images_with_alt"].cast("string"), F.lit(" / "), a11y["total_images"].cast("string"), F.lit(" images with alt"))),
    ]
    return F.array(*(perf + seo_rows + links + security + mobile + technical + server + access))


def page_checks(reports: DataFrame, id_col: str = "page_id") -> DataFrame:
    """K1-K8 long form: ``id, tab, ord, label, status, detail``."""
    return reports.select(id_col, F.explode(check_rows()).alias("c")).select(id_col, "c.*")
