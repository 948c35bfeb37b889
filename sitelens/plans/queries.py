"""Registry of the engine's queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry reads the driver tables of ``sf_dir`` (or tables Spark derives from
them), runs one operator of SURVEY §2 over the whole input and ends in a
projection to oracle-comparable types (string, bigint, double, boolean).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.config import Params, clamp_rate_limit
from sitelens.operators import stats as st
from sitelens.sources.fixtures import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
P = Params()


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def ts_str(c: str = "created_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ------------------------------------------------------------- statistics


def _t1(period: str) -> QueryFn:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Tables(spark, sf_dir).statistics()
        return st.filter_period(s, period, P.as_of).select(
            "id", "domain", F.col("duration_ms").cast("bigint").alias("duration_ms"), "success", "user_id",
            ts_str().alias("created_at"),
        )

    return q


for _p in ("today", "week", "month", "year", "all"):
    register(f"t1_period_{_p}")(_t1(_p))


def _t2(page: int) -> QueryFn:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Tables(spark, sf_dir).statistics()
        return st.listing_page(s, "week", P.as_of, page).select(
            "id", "domain", F.col("duration_ms").cast("bigint").alias("duration_ms"), "success", "ip_address",
            "user_id", "user_agent", ts_str().alias("created_at"),
        )

    return q


for _pg in (1, 3):
    register(f"t2_listing_week_p{_pg}")(_t2(_pg))


@register("t3_count_week")
def t3(spark, sf_dir):
    return st.filtered_count(Tables(spark, sf_dir).statistics(), "week", P.as_of)


@register("t4_totals")
def t4(spark, sf_dir):
    return st.totals(Tables(spark, sf_dir).statistics(), P.as_of)


def _t5(period: str) -> QueryFn:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = st.daily_counts(Tables(spark, sf_dir).statistics(), period, P.as_of)
        return d.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count")

    return q


for _p in ("week", "all"):
    register(f"t5_daily_{_p}")(_t5(_p))


@register("t6_top_domains")
def t6(spark, sf_dir):
    return st.top_domains(Tables(spark, sf_dir).statistics(), 10)


@register("t7_bundle_summary_month")
def t7(spark, sf_dir):
    return st.bundle_summary(Tables(spark, sf_dir).statistics(), "month", P.as_of, 1)


@register("t8_total_pages_year")
def t8(spark, sf_dir):
    c = st.filtered_count(Tables(spark, sf_dir).statistics(), "year", P.as_of)
    return c.select(st.total_pages(F.col("total")).alias("total_pages"))


@register("t9_view_week_p1")
def t9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = st.listing_page(t.statistics(), "week", P.as_of, 1)
    return st.statistics_view(rows, t.users())


# ------------------------------------------------------------- page audit
from sitelens.functions.text import byte_length  # noqa: E402
from sitelens.operators import extract as ex  # noqa: E402
from sitelens.operators import scores as sc  # noqa: E402
from sitelens.plans import audit  # noqa: E402
from sitelens.sources.captures import normalize_crawl, normalize_robots  # noqa: E402


def _reports(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return audit.assemble_reports(t.crawl(), t.robots(), t.sitemaps())


def _scored(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return audit.page_scorecard(t.crawl(), t.robots(), t.sitemaps())


@register("s1_crawl_scan")
def s1(spark, sf_dir):
    c = normalize_crawl(Tables(spark, sf_dir).crawl())
    return c.select(
        "page_id", "url", F.col("status").cast("bigint").alias("status"), byte_length("body").alias("body_bytes"),
        F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("header_names"),
    )


@register("s2_robots_scan")
def s2(spark, sf_dir):
    r = normalize_robots(Tables(spark, sf_dir).robots())
    return r.select("robots_url", F.col("status").cast("bigint").alias("status"), byte_length("content").alias("content_bytes"))


@register("s3_sitemap_scan")
def s3(spark, sf_dir):
    return Tables(spark, sf_dir).sitemaps().select("sitemap_url", F.col("status").cast("bigint").alias("status"))


@register("h0_elements")
def h0(spark, sf_dir):
    return ex.extract_elements(normalize_crawl(Tables(spark, sf_dir).crawl()))


def _features(spark, sf_dir) -> DataFrame:
    return audit.page_features(Tables(spark, sf_dir).crawl())


@register("h1_h5_head_fields")
def h1_5(spark, sf_dir):
    s = F.col("seo")
    return _features(spark, sf_dir).select(
        "page_id", s["title"].alias("title"), s["meta_description"].alias("meta_description"),
        s["canonical"].alias("canonical"), s["robots_meta"].alias("robots_meta"), s["viewport"].alias("viewport"),
    )


@register("h6_headings")
def h6(spark, sf_dir):
    f = _features(spark, sf_dir)
    parts = [
        F.struct(F.lit(f"h{k}").alias("level"), F.col("seo.headings")[f"h{k}"].alias("texts")) for k in range(1, 7)
    ]
    x = f.select("page_id", F.explode(F.array(*parts)).alias("h"))
    return x.select(
        "page_id", F.col("h.level").alias("level"), F.size("h.texts").cast("bigint").alias("n"),
        F.array_join("h.texts", "|").alias("texts"),
    )


@register("h7_images")
def h7(spark, sf_dir):
    f = _features(spark, sf_dir)
    x = f.select("page_id", F.posexplode("seo.images").alias("pos", "img"))
    return x.select("page_id", F.col("pos").cast("bigint").alias("pos"), "img.src", "img.alt", "img.has_alt")


@register("h8_image_counts")
def h8(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "seo.total_images", "seo.images_without_alt")


def _map_long(field: str) -> QueryFn:
    def q(spark, sf_dir):
        f = _features(spark, sf_dir)
        return f.select("page_id", F.explode(F.col("seo")[field]).alias("key", "value"))

    return q


register("h9_open_graph")(_map_long("open_graph"))
register("h10_twitter_card")(_map_long("twitter_card"))


@register("h11_schema")
def h11(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select(
        "page_id", F.size("seo.schema").cast("bigint").alias("n_schema"), F.array_join("seo.schema", "\n").alias("schema_text"),
        F.col("seo.has_schema").alias("has_schema"),
    )


@register("h12_links")
def h12(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "seo.internal_links", "seo.external_links")


@register("h13_seo_record")
def h13(spark, sf_dir):
    s = F.col("seo")
    return _features(spark, sf_dir).select(
        "page_id", s["title"].alias("title"), s["title_length"].alias("title_length"),
        s["meta_description"].alias("meta_description"), s["meta_desc_length"].alias("meta_desc_length"),
        s["canonical"].alias("canonical"), s["robots_meta"].alias("robots_meta"), s["viewport"].alias("viewport"),
        F.size(s["headings"]["h1"]).cast("bigint").alias("h1_count"),
        s["images_without_alt"].alias("images_without_alt"), s["total_images"].alias("total_images"),
        s["has_og"].alias("has_og"), s["has_twitter"].alias("has_twitter"), s["has_schema"].alias("has_schema"),
        s["internal_links"].alias("internal_links"), s["external_links"].alias("external_links"),
        s["is_noindex"].alias("is_noindex"),
    )


@register("h14_page_size")
def h14(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "html_meta.page_size_bytes", "html_meta.page_size_kb")


@register("p1_http")
def p1(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "http.status_code", "http.status_ok", "http.is_redirect", "http.final_url", "http.https")


@register("p2_headers")
def p2(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "headers.*")


@register("p3_security")
def p3(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "security.*")


@register("p4_p5_robots")
def p4(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.select("page_id", F.col("robots.exists").alias("robots_exists"), F.col("robots.url").alias("robots_url"),
                    F.col("robots.content").alias("robots_content"), F.col("robots.blocks_all").alias("blocks_all"))


@register("p6_sitemap")
def p6(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.select("page_id", F.col("sitemap.exists").alias("sitemap_exists"), F.col("sitemap.url").alias("sitemap_url"))


@register("p8_performance")
def p8(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "performance.load_time_ms", "performance.ttfb_ms", "performance.fcp_ms",
                                          "performance.lcp_ms", "performance.speed_index_ms")


@register("p9_mobile")
def p9(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "mobile.*")


@register("p10_accessibility")
def p10(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "accessibility.total_images", "accessibility.images_with_alt",
                                          "accessibility.images_missing_alt", "accessibility.alt_text_score", "accessibility.notes")


@register("p11_technical")
def p11(spark, sf_dir):
    return _reports(spark, sf_dir).select("page_id", "technical.status_code", "technical.https", "technical.has_gzip",
                                          "technical.has_brotli", "technical.cache_control", "technical.server",
                                          "technical.page_size_kb", "technical.robots_ok", "technical.sitemap_ok")


@register("c8_page_scorecard")
def c8(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "page_id", "url", F.col("scores.overall").alias("overall"), F.col("scores.seo").alias("seo"),
        F.col("scores.security").alias("security"), F.col("scores.performance").alias("performance"),
        F.col("scores.mobile").alias("mobile"), F.col("scores.technical").alias("technical"),
        F.col("scores.accessibility").alias("accessibility"),
    )


@register("c9_bands")
def c9(spark, sf_dir):
    r = _scored(spark, sf_dir)
    return r.select("page_id", F.col("scores.overall").alias("overall"), sc.band(F.col("scores.overall")).alias("band"))


@register("c10_summary")
def c10(spark, sf_dir):
    r = _scored(spark, sf_dir)
    return r.select("page_id", sc.auto_summary(F.col("url"), F.col("scores")).alias("summary"))


@register("c11_score_cards")
def c11(spark, sf_dir):
    return sc.score_cards(_scored(spark, sf_dir))


# ------------------------------------------------------ checks, recommendations, exports
from sitelens.operators.checks import format_ms, page_checks  # noqa: E402
from sitelens.operators.recommend import recommendations  # noqa: E402
from sitelens.sources import exports  # noqa: E402


@register("k_page_checks")
def k_checks(spark, sf_dir):
    return page_checks(_scored(spark, sf_dir))


@register("k9_format_ms")
def k9(spark, sf_dir):
    r = _scored(spark, sf_dir)
    x = r.select("page_id", F.explode(F.array(
        F.col("performance.load_time_ms"), F.col("performance.fcp_ms"), F.col("performance.lcp_ms"),
        F.col("performance.speed_index_ms"))).alias("ms")).where(F.col("ms").isNotNull())
    return x.select("page_id", "ms", format_ms(F.col("ms")).alias("shown"))


@register("r1_r2_recommendations")
def r12(spark, sf_dir):
    return recommendations(_scored(spark, sf_dir))


@register("s9_report_json")
def s9(spark, sf_dir):
    return exports.report_json(_scored(spark, sf_dir).drop("timestamp"), pretty=True)


@register("s10_scores_csv")
def s10(spark, sf_dir):
    return exports.scores_csv_lines(_scored(spark, sf_dir))


# ------------------------------------------------------------- frontier and redirects
from sitelens.functions.url import domain_of  # noqa: E402
from sitelens.operators import frontier as fr  # noqa: E402


@register("u11_validate_frontier")
def u11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fr.validate_frontier(t.frontier(), t.dns())


@register("u12_domain")
def u12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ok, _ = fr.split_frontier(fr.validate_frontier(t.frontier(), t.dns()))
    return ok.select("request_id", domain_of(F.col("valid_url")).alias("domain"))


@register("u13_client_ip")
def u13(spark, sf_dir):
    r = Tables(spark, sf_dir).requests()
    return r.select("request_id", fr.client_ip(["cf_ip", "real_ip", "xff", "remote_addr"]).alias("client_ip"))


@register("d1_redirect_target")
def d1(spark, sf_dir):
    r = Tables(spark, sf_dir).redirects()
    return r.select("url", "location", fr.redirect_target(F.col("url"), F.col("location")).alias("target"))


@register("d2_resolve_redirects")
def d2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fr.resolve_redirects(t.redirect_start(), t.redirects(), t.dns())


def _redirected(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    return audit.redirected_scorecard(t.redirect_start(), t.redirects(), t.dns(), t.fetches(), t.robots(), t.sitemaps())


@register("p7_redirected_scorecard")
def p7(spark, sf_dir):
    cards = _redirected(spark, sf_dir)[0]
    kinds = ("overall", "seo", "security", "performance", "mobile", "technical", "accessibility")
    return cards.select("request_id", "submitted_url", "final_url", "redirects", "http.status_code", *[F.col(f"scores.{k}").alias(k) for k in kinds])


@register("p7_s6_outcomes")
def p7o(spark, sf_dir):
    return _redirected(spark, sf_dir)[1].select(
        "request_id", "submitted_url", F.col("duration_ms").cast("bigint").alias("duration_ms"), "success", "error"
    )


# ------------------------------------------------------------- model review batch
from sitelens.operators import review as rv  # noqa: E402


def _parsed(spark, sf_dir) -> DataFrame:
    return rv.parse_responses(Tables(spark, sf_dir).ai_responses())


def _merged(spark, sf_dir) -> DataFrame:
    return rv.merge_reviews(_scored(spark, sf_dir), _parsed(spark, sf_dir))


@register("a1_payload")
def a1(spark, sf_dir):
    p = rv.review_payload(_scored(spark, sf_dir))
    return p.select("page_id", F.size("payload.seo.images").cast("bigint").alias("payload_images"),
                    F.col("payload.seo.total_images").alias("total_images"))


@register("a2_prompt")
def a2(spark, sf_dir):
    return rv.review_requests(_scored(spark, sf_dir).drop("timestamp"))


@register("a3_parse_responses")
def a3(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    ai = rv.review_struct(F.col("text"))
    return p.select("page_id", "url", "ok", "error_message", ai["has_overall"].alias("has_overall"),
                    ai["overall_score"].alias("overall_score"), ai["summary"].alias("summary"),
                    ai["ratings"]["seo"].alias("rating_seo"), F.size(ai["recommendations"]).cast("bigint").alias("n_recommendations"))


@register("a4_merge_overall")
def a4(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.select("page_id", F.col("scores.overall").alias("overall"), F.col("ai").isNotNull().alias("has_review"))


@register("a5_summary")
def a5(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.select("page_id", rv.summary_with_review(sc.auto_summary(F.col("url"), F.col("scores"))).alias("summary"))


@register("a5_score_cards")
def a5c(spark, sf_dir):
    return sc.score_cards(_merged(spark, sf_dir))


@register("a6_issues")
def a6(spark, sf_dir):
    return rv.review_issues(_parsed(spark, sf_dir))


@register("a6_tips")
def a6t(spark, sf_dir):
    return rv.review_tips(_parsed(spark, sf_dir))


@register("a7_request_validity")
def a7(spark, sf_dir):
    """Request payloads: the report's JSON, and what a broken client would send instead."""
    p = rv.review_payload(_scored(spark, sf_dir).drop("timestamp"))
    n = F.col("page_id") % 6
    sent = (
        F.when(n == 1, F.lit("")).when(n == 2, F.lit("0")).when(n == 3, F.lit('"text"')).when(n == 4, F.lit("{broken"))
        .when(n == 5, F.lit("[]")).otherwise(F.to_json("payload"))
    )
    return p.select("page_id", rv.valid_review_request(sent).alias("valid"))


@register("r3_recommendations_ai")
def r3(spark, sf_dir):
    return recommendations(_merged(spark, sf_dir))


# ------------------------------------------------------------- rate limiting and streams
import uuid  # noqa: E402

from sitelens.session import shared_path  # noqa: E402
from sitelens.sources import captures  # noqa: E402
from sitelens.sources import statistics as usage  # noqa: E402
from sitelens.sources.statistics import outcomes_to_statistics  # noqa: E402
from sitelens.storage import written  # noqa: E402
from sitelens.streaming import admission as adm  # noqa: E402
from sitelens.streaming import ratelimit as rl  # noqa: E402
from sitelens.streaming import sinks  # noqa: E402


def _rl_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("request_id"), "key", "accepted", "count_in_window")


@register("w1_rate_limit_batch")
def w1(spark, sf_dir):
    r = Tables(spark, sf_dir).requests()
    return _rl_out(rl.rate_limit(r, F.col("event_type"), F.col("ts"), "request_id", 2))


@register("w2_rate_limit_refresh")
def w2(spark, sf_dir):
    r = Tables(spark, sf_dir).requests()
    return _rl_out(rl.rate_limit(r, F.col("event_type"), F.col("ts"), "request_id", 2, refresh_on_accept=True))


@register("w3_w4_admission")
def w34(spark, sf_dir):
    r = Tables(spark, sf_dir).requests()
    keyed = rl.admission_keys(r, fr.client_ip(["cf_ip", "real_ip", "xff", "remote_addr"]), clamp_rate_limit(P.max_per_hour), P.ai_max_per_hour)
    return _rl_out(rl.rate_limit(keyed, F.col("rl_key"), F.col("ts"), "request_id", F.col("rl_limit")))


def _outcome_out(df: DataFrame) -> DataFrame:
    return df.select("request_id", "outcome", "status", "reason", "is_ai", "client_ip", "url", "count_in_window")


def _settings() -> adm.Settings:
    return adm.Settings.of({"max_analyses_per_hour": P.max_per_hour, "gemini_api_key": "configured"})


@register("w4_admission")
def w4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _outcome_out(adm.admit(t.admissions(), t.admission_dns(), _settings()))


def _admission_job(spark, sf_dir) -> tuple[str, str]:
    """Run the streaming job to its end; the folders of outcomes and usage."""
    t = Tables(spark, sf_dir)
    run = uuid.uuid4().hex[:8]
    out, usage_path, ck = (shared_path(spark, "streams", f"admission-{run}", x) for x in ("outcomes", "usage", "checkpoint"))
    stream = _as_file_stream(spark, t.admissions(), "admissions")
    # every branch and batch reads the lookup tables: derived once
    dns, known = written(t.admission_dns(), "dns"), written(t.admission_captures(), "captures")
    outcomes = adm.admit_stream(stream, dns, _settings())
    adm.run_admission(outcomes, out, usage_path, known, ck).awaitTermination()
    return out, usage_path


@register("w4_admission_stream")
def w4s(spark, sf_dir):
    return _outcome_out(adm.read_outcomes(spark, _admission_job(spark, sf_dir)[0]))


@register("w4_s6_recorded_usage")
def w4u(spark, sf_dir):
    """Admission, outcome and record as one job: the usage rows of the accepted analyses."""
    return _stats_out(usage.read_statistics(spark, _admission_job(spark, sf_dir)[1]))


def _as_file_stream(spark, df: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, "sources", f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@register("w1_rate_limit_stream")
def w1s(spark, sf_dir):
    r = Tables(spark, sf_dir).requests().select("request_id", "ts", "event_type")
    stream = _as_file_stream(spark, r, "requests")
    out = rl.stream_rate_limit(stream, F.col("event_type"), "ts", "request_id", 2)
    return _rl_out(sinks.run_to_parquet(out, spark, "w1"))


def _outcomes(spark, sf_dir) -> DataFrame:
    c = Tables(spark, sf_dir).fetches()
    return c.select(F.col("page_id").alias("request_id"), F.col("url").alias("submitted_url"), "duration_ms",
                    F.col("error").isNull().alias("success"), "user_id", F.col("fetched_at").alias("created_at"))


def _stats_out(df: DataFrame) -> DataFrame:
    return df.select("id", "domain", F.col("duration_ms").cast("bigint").alias("duration_ms"), "success", "ip_address",
                     "user_id", "user_agent", ts_str().alias("created_at"))


@register("s6_outcomes_to_statistics")
def s6(spark, sf_dir):
    return _stats_out(outcomes_to_statistics(_outcomes(spark, sf_dir)))


@register("w5_stream_record")
def w5(spark, sf_dir):
    stream = _as_file_stream(spark, _outcomes(spark, sf_dir), "outcomes")
    run = uuid.uuid4().hex[:8]
    out, ck = shared_path(spark, "tables", f"statistics-{run}"), shared_path(spark, "streams", f"record-{run}")
    sinks.record_stream(stream, out, ck).awaitTermination()
    return _stats_out(spark.read.parquet(out))


@register("w6_stream_daily_counts")
def w6(spark, sf_dir):
    stream = _as_file_stream(spark, Tables(spark, sf_dir).statistics(), "statistics")
    run = uuid.uuid4().hex[:8]
    out, ck = shared_path(spark, "streams", f"w6-{run}", "out"), shared_path(spark, "streams", f"w6-{run}", "checkpoint")
    sinks.write_daily_counts(sinks.daily_counts_stream(stream), out, ck).awaitTermination()
    return sinks.read_daily_counts(spark, out)


@register("s4_s5_statistics_table")
def s45(spark, sf_dir):
    """Two appends to a usage table, then the typed read."""
    path = shared_path(spark, "tables", f"usage-{uuid.uuid4().hex[:8]}")
    usage.append_statistics(Tables(spark, sf_dir).statistics(), path)
    usage.append_statistics(outcomes_to_statistics(_outcomes(spark, sf_dir)), path)
    return _stats_out(usage.read_statistics(spark, path))


def _stored_usage(spark, sf_dir) -> DataFrame:
    """The usage table as stored: partitioned by date, so periods prune."""
    path = shared_path(spark, "tables", f"usage-{uuid.uuid4().hex[:8]}")
    usage.append_statistics(Tables(spark, sf_dir).statistics(), path)
    return usage.read_statistics(spark, path)


@register("s4_t1_stored_week")
def s4t1(spark, sf_dir):
    return st.filter_period(_stored_usage(spark, sf_dir), "week", P.as_of).select(
        "id", "domain", F.col("duration_ms").cast("bigint").alias("duration_ms"), "success", "user_id", ts_str().alias("created_at")
    )


@register("s4_t5_stored_daily_week")
def s4t5(spark, sf_dir):
    return _day(st.daily_counts(_stored_usage(spark, sf_dir), "week", P.as_of))


@register("s11_review_scan")
def s11(spark, sf_dir):
    path = shared_path(spark, "sources", f"answers-{uuid.uuid4().hex[:8]}")
    Tables(spark, sf_dir).ai_responses().write.parquet(path)
    got = captures.read_ai_responses(spark, path)
    text = F.get_json_object("body", "$.candidates[0].content.parts[0].text")
    return got.select("url", "status", "error", text.alias("text"))


def _day(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


@register("t7_bundle_rows_week")
def t7r(spark, sf_dir):
    return _stats_out(st.statistics_bundle(Tables(spark, sf_dir).statistics(), "week", P.as_of)["rows"])


@register("t7_bundle_chart_week")
def t7c(spark, sf_dir):
    return _day(st.statistics_bundle(Tables(spark, sf_dir).statistics(), "week", P.as_of)["chart"])


@register("t10_dashboard")
def t10(spark, sf_dir):
    d = st.dashboard(Tables(spark, sf_dir).statistics(), P.as_of)
    kinds = ("all", "today", "week", "month")
    totals = d["totals"].select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("count")) for k in kinds])).alias("r"))
    parts = [
        totals.select(F.lit("totals").alias("part"), "r.label", "r.count"),
        d["top_domains"].select(F.lit("top_domains").alias("part"), F.col("domain").alias("label"), "count"),
        _day(d["chart"]).select(F.lit("chart").alias("part"), F.col("date").alias("label"), "count"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------- roll-ups
from sitelens.operators import rollups as ru  # noqa: E402


@register("g1_check_pass_rates")
def g1(spark, sf_dir):
    return ru.check_pass_rates(page_checks(_scored(spark, sf_dir)))


@register("g2_host_scorecard")
def g2(spark, sf_dir):
    return ru.host_scorecard(_scored(spark, sf_dir))


@register("g3_recommendation_rollup")
def g3(spark, sf_dir):
    return ru.recommendation_rollup(recommendations(_scored(spark, sf_dir)))
