"""Input tables derived from the driver's read-only tables (FIXTURES.md).

The reference fetches pages, robots files, sitemaps, DNS records and LLM
answers over the network; the engine reads them as tables.  These builders
derive such tables deterministically from ``pages``, ``events`` and
``customer`` with narrow DataFrame transformations only (no shuffle except the
per-host ``distinct``), so they grow with the inputs.  The DuckDB twins in
``sitelens.plans.oracle`` are written independently from the same recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.url import url_host, url_path, url_scheme

FETCHED_AT = "2024-01-30 12:00:00"

# Fixed values of the fixture recipes (FIXTURES.md).
LOAD_MS_BY_P13 = [None, 0, 500, 800, 801, 1500, 1501, 3000, 3001, 5000, 5001, 10000, 10001]
TTFB_BY_P4 = [None, 0, 120, 350]
# Awkward markup by p % 16.
AWKWARD = {
    3: "<a href=/x title=it's>q</a><img src=\"/apos.png\" alt=\"pic\"><p>don't</p>",
    5: '<img alt="a > b" src=/gt.png><a-b href="/no">custom</a-b><img title="x alt=none"><img ALT=first alt=second>',
    7: "<h3>open <i>one</i><h4>next</h4><p>1 < 2 and <b>3</b></p>",
    11: '<script>var s = "<!--";</script><img src="/after.png" alt="x"><!-- <script> --><img src=/still.png>',
    13: "<h5 class='a>b'>five</h5 ><style>p > a { } <img></style><img src='/s.png' alt=''>",
    15: '<img src="/last.png" alt="last"><!-- never closed <img src="/no.png"> <h1>no</h1>',
}
LONG_CSP = (
    "default-src 'self'; script-src 'self' https://cdn.example.com; "
    "style-src 'self' 'unsafe-inline'; img-src *"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def _cat(*parts) -> Column:
    return F.concat(*[_s(p) if not isinstance(p, str) else F.lit(p) for p in parts])


def _if(cond: Column, *parts) -> Column:
    return F.when(cond, _cat(*parts)).otherwise(F.lit(""))


def _pick(idx: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def crawl_from_pages(pages: DataFrame) -> DataFrame:
    """``crawl`` rows: enriched body, status, header map, timings."""
    p = F.col("page_id")
    u = F.col("url")
    html = F.col("html")
    body = F.when(p % 9 == 0, F.replace(F.replace(html, F.lit("<h1>"), F.lit('<div class="h">')), F.lit("</h1>"), F.lit("</div>"))).otherwise(html)
    new_title = (
        F.when(p % 11 == 0, F.lit(""))
        .when(p % 11 == 1, F.lit("Short"))
        .when(p % 11 == 2, F.repeat(F.lit("x"), 9))
        .when(p % 11 == 3, F.repeat(F.lit("x"), 10))
        .when(p % 11 == 4, F.repeat(F.lit("x"), 70))
        .when(p % 11 == 5, F.repeat(F.lit("x"), 71))
    )
    body = F.when(
        new_title.isNotNull(),
        F.regexp_replace(body, F.lit("<title>[^<]*</title>"), F.concat(F.lit("<title>"), new_title, F.lit("</title>"))),
    ).otherwise(body)
    head = F.concat(
        _if(p % 2 == 0, '<meta name="description" content=" Description of page ', p, ' ">'),
        _if(p % 4 == 3, '<meta name="Description" content="wrong case">'),
        _if(p % 3 != 0, '<link rel="canonical" href="', u, '">'),
        _if(p % 7 == 0, '<meta name="robots" content="NOINDEX, follow">'),
        _if(p % 3 == 0, '<meta name="viewport" content="width=device-width, initial-scale=1">'),
        _if(p % 3 == 1, '<meta name="viewport" content="width=1024">'),
        _if(p % 4 == 0, '<meta property="og:title" content="OG ', p, '"><meta property="og:type" content="article">'),
        _if(p % 8 == 0, '<meta property="og:title" content="OG2 ', p, '">'),
        _if(p % 5 == 0, '<meta name="twitter:card" content="summary">'),
        _if(p % 6 == 0, '<script type="application/ld+json">{"@type":"Article","id":', p, "}</script>"),
        _if(p % 6 == 1, '<script type="application/ld+json">{}</script>'),
        _if(p % 6 == 2, '<script type="application/ld+json">{bad</script>'),
    )
    art = F.concat(
        _if(p % 5 >= 1, '<img src="/i', p, '.png" alt="img">'),
        _if(p % 5 >= 2, '<img src="/j', p, '.png">'),
        _if(p % 5 >= 3, '<img src="/k', p, '.png" alt="">'),
        _if(p % 5 >= 4, '<img src="/l', p, '.png" alt=" ">'),
        _if(p % 12 == 5, '<img src="/m.png">' * 6),
        _if(p % 4 == 1, "<h2>Sub <b>", p, "</b></h2>"),
        _if(
            p % 3 == 1,
            '<a href="https://ext.example.com/', p, '">x</a><a href="//cdn.example.com/a">c</a>'
            '<a href="mailto:a@b.c">m</a><a href="">e</a><a name="n">none</a>',
        ),
        _if(p % 3 == 2, '<a href="', u, '">self</a>'),
        *[_if(p % 16 == k, text) for k, text in AWKWARD.items()],
    )
    body = F.replace(body, F.lit("</head>"), F.concat(head, F.lit("</head>")))
    body = F.replace(body, F.lit("</article>"), F.concat(art, F.lit("</article>")))
    body = F.when(p % 13 == 0, F.lit("")).otherwise(body)

    status = F.when(p % 10 == 9, 404).when(p % 10 == 8, 204).otherwise(200).cast("int")
    csp = F.when(p % 9 == 3, F.lit("")).when(p % 6 == 0, F.lit(LONG_CSP)).otherwise(F.lit("default-src 'self'"))
    entries = F.array(
        F.struct(F.lit("content-type").alias("k"), F.lit("text/html; charset=utf-8").alias("v")),
        F.when(p % 6 == 3, F.struct(F.lit("content-encoding").alias("k"), F.lit("GZIP").alias("v")))
        .when(p % 3 == 0, F.struct(F.lit("content-encoding").alias("k"), F.lit("gzip").alias("v")))
        .when(p % 3 == 1, F.struct(F.lit("content-encoding").alias("k"), F.lit("br").alias("v"))),
        F.when(p % 5 != 0, F.struct(F.lit("cache-control").alias("k"), F.lit("max-age=3600").alias("v"))),
        F.struct(F.lit("server").alias("k"), F.when(p % 2 == 0, F.lit("nginx")).otherwise(F.lit("Apache")).alias("v")),
        F.when(p % 2 == 0, F.struct(F.lit("strict-transport-security").alias("k"), F.lit("max-age=31536000").alias("v"))),
        F.when(p % 3 == 0, F.struct(F.lit("content-security-policy").alias("k"), csp.alias("v"))),
        F.when(p % 4 != 0, F.struct(F.lit("x-frame-options").alias("k"), F.lit("SAMEORIGIN").alias("v"))),
        F.when(p % 5 == 0, F.struct(F.lit("x-xss-protection").alias("k"), F.lit("1; mode=block").alias("v"))),
        F.when(p % 4 == 0, F.struct(F.lit("referrer-policy").alias("k"), F.lit("strict-origin-when-cross-origin").alias("v"))),
        F.when(p % 3 != 1, F.struct(F.lit("x-content-type-options").alias("k"), F.lit("nosniff").alias("v"))),
        F.when(p % 7 == 0, F.struct(F.lit("permissions-policy").alias("k"), F.lit("geolocation=()").alias("v"))),
    )
    headers = F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
    return pages.select(
        p.alias("page_id"),
        u.alias("url"),
        status.alias("status"),
        headers.alias("headers"),
        body.alias("body"),
        F.lit(None).cast("string").alias("error"),
        F.to_timestamp(F.lit(FETCHED_AT)).alias("fetched_at"),
        ((p * 37) % 2000).cast("int").alias("duration_ms"),
        _pick(p % 13, LOAD_MS_BY_P13).alias("load_ms"),
        _pick(p % 4, TTFB_BY_P4).alias("nav_ttfb_ms"),
        (p % 5).cast("bigint").alias("user_id"),
    )


def site_bases(pages: DataFrame) -> DataFrame:
    """Distinct ``scheme://host`` of the pages with ``L = length(host)``."""
    return (
        pages.select(url_scheme("url").alias("scheme"), url_host("url").alias("host"))
        .distinct()
        .select(F.concat("scheme", F.lit("://"), "host").alias("base"), F.length("host").alias("L"))
    )


def robots_from_pages(pages: DataFrame) -> DataFrame:
    """``robots(robots_url, status, content)``, one row per site (``L%5=4`` has none)."""
    b = site_bases(pages)
    m = F.col("L") % 5
    return b.where(m != 4).select(
        F.concat("base", F.lit("/robots.txt")).alias("robots_url"),
        F.when(m == 0, 404).otherwise(200).cast("int").alias("status"),
        F.when(m == 0, F.lit("<html><body>Not Found</body></html>"))
        .when(m == 1, F.lit("User-agent: *\nDisallow: /"))
        .when(m == 2, F.lit("User-agent: *\nDisallow:\n"))
        .otherwise(F.lit("User-agent: *\nDisallow: /private"))
        .alias("content"),
    )


def sitemaps_from_pages(pages: DataFrame) -> DataFrame:
    """``sitemaps(sitemap_url, status)``."""
    b = site_bases(pages)
    m = F.col("L") % 4
    rows = F.when(m == 0, F.array(F.struct(F.lit("/sitemap.xml").alias("path"), F.lit(200).alias("status")))).when(
        m == 1,
        F.array(
            F.struct(F.lit("/sitemap.xml").alias("path"), F.lit(404).alias("status")),
            F.struct(F.lit("/sitemap_index.xml").alias("path"), F.lit(200).alias("status")),
        ),
    ).when(
        m == 2,
        F.array(
            F.struct(F.lit("/sitemap-index.xml").alias("path"), F.lit(200).alias("status")),
            F.struct(F.lit("/sitemap_index.xml").alias("path"), F.lit(301).alias("status")),
        ),
    )
    return (
        b.where(m != 3)
        .select("base", F.explode(rows).alias("r"))
        .select(F.concat("base", "r.path").alias("sitemap_url"), F.col("r.status").cast("int").alias("status"))
    )


def redirect_start(pages: DataFrame) -> DataFrame:
    """Submitted URL per page: the head of its redirect chain, or the page URL."""
    p = F.col("page_id")
    base = F.concat(url_scheme("url"), F.lit("://"), url_host("url"))
    start = F.when((p % 8 > 0) | (p % 17 == 0), F.concat(base, F.lit("/r/"), p.cast("string"), F.lit("/0"))).otherwise(F.col("url"))
    return pages.select(p.alias("request_id"), start.alias("submitted_url"), F.col("url").alias("page_url"))


def redirects_from_pages(pages: DataFrame) -> DataFrame:
    """``redirects(url, status, location)``: ``p%8`` hops per page."""
    p = F.col("page_id")
    scheme, host = url_scheme("url"), url_host("url")
    base = F.concat(scheme, F.lit("://"), host)
    hops = F.when((p % 8 == 0) & (p % 17 == 0), F.lit(1)).otherwise(p % 8)
    x = pages.select(p.alias("p"), F.col("url").alias("u"), base.alias("base"), scheme.alias("scheme"), host.alias("host"), hops.alias("h"))
    x = x.where(F.col("h") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("k"))
    p, k = F.col("p"), F.col("k")
    nxt = (k + 1).cast("string")
    last = k == F.col("h") - 1
    form = (p + k) % 4
    mid = (
        F.when(form == 0, F.concat("base", F.lit("/r/"), p.cast("string"), F.lit("/"), nxt))
        .when(form == 1, F.concat(F.lit("//"), "host", F.lit("/r/"), p.cast("string"), F.lit("/"), nxt))
        .when(form == 2, F.concat(F.lit("/r/"), p.cast("string"), F.lit("/"), nxt))
        .otherwise(nxt)
    )
    fin = (
        F.when(form == 1, F.concat(F.lit("//"), F.expr("substring(u, length(scheme) + 4)")))
        .when(form == 2, F.expr("substring(u, length(base) + 1)"))
        .otherwise(F.col("u"))
    )
    loc = F.when((p % 17 == 0) & (k == 0), F.lit("")).when(last, fin).otherwise(mid)
    status = F.when(k % 3 == 0, 301).when(k % 3 == 1, 302).otherwise(308).cast("int")
    return x.select(
        F.concat("base", F.lit("/r/"), p.cast("string"), F.lit("/"), k.cast("string")).alias("url"),
        status.alias("status"),
        loc.alias("location"),
    )


# Literal frontier rows and the outcome each one tests.
FRONTIER_LITERALS = [
    "",
    "   ",
    "example.com",
    "HTTP://Example.com/x",
    "https://a.example.com:443/",
    "http://8.8.8.8",
    "http://172.32.0.1",
    "https://u:p@a.example.com",
    "https://a.example.com:8080",
    "http://localhost",
    "http://x.local",
    "http://y.internal.",
    "http://127.0.0.1",
    "http://10.0.0.1",
    "http://172.16.0.1",
    "http://192.168.1.1",
    "http://169.254.1.1",
    "http://0.0.0.1",
    "http://240.0.0.1",
    "https://",
    "https:///x",
    "ftp://a.example.com",
    "https://exa mple.com",
    "http://a_b.example.com/",
]


def frontier_from_pages(pages: DataFrame) -> DataFrame:
    """``frontier(request_id, raw_url)``: page URLs plus literal edge cases."""
    spark = pages.sparkSession
    lits = spark.createDataFrame(
        [(1_000_000 + i, u) for i, u in enumerate(FRONTIER_LITERALS)], "request_id bigint, raw_url string"
    )
    return pages.select(F.col("page_id").alias("request_id"), F.col("url").alias("raw_url")).unionByName(lits)


def dns_from_frontier(frontier: DataFrame) -> DataFrame:
    """``dns(host, ip)`` for every non-IP host of the frontier, by ``length(host)%6``."""
    from sitelens.operators.frontier import normalize_frontier  # avoid import cycle

    hosts = normalize_frontier(frontier).select("host").where((F.col("host") != "") & ~F.col("host").rlike(r"^[0-9.]+$")).distinct()
    m = F.length("host") % 6
    ips = F.when(m == 1, F.array(F.lit("10.0.0.5"))).when(m == 2, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.5"))).when(
        m >= 3, F.array(F.lit("93.184.216.34"))
    )
    return hosts.where(m != 0).select("host", F.explode(ips).alias("ip"))


def statistics_from_events(events: DataFrame) -> DataFrame:
    """The usage table (S4 schema) from ``events``."""
    uid = F.col("user_id")
    return events.select(
        F.col("event_id").cast("bigint").alias("id"),
        F.concat(F.lit("site"), (uid % 20).cast("string"), F.lit(".example.com")).alias("domain"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"),
        F.lit("").alias("ip_address"),
        F.when(uid % 3 == 0, F.lit(0)).otherwise(uid).cast("bigint").alias("user_id"),
        F.lit("").alias("user_agent"),
        F.col("ts").alias("created_at"),
    )


def users_from_customer(customer: DataFrame) -> DataFrame:
    return customer.where(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_name").alias("user_login")
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    """``requests`` with the four client-address fields."""
    m = F.col("user_id") % 4
    addr = F.concat(F.lit("203.0.113."), (F.col("user_id") % 250).cast("string"))
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("event_type"),
        F.when(m == 0, addr).when(m == 1, F.lit("bad")).otherwise(F.lit("")).alias("cf_ip"),
        F.when(m == 1, addr).otherwise(F.lit("")).alias("real_ip"),
        F.when(m == 2, F.lit("198.51.100.7, 10.0.0.1")).otherwise(F.lit("")).alias("xff"),
        F.concat(F.lit("192.0.2."), (F.col("user_id") % 250).cast("string")).alias("remote_addr"),
        (F.col("event_type") == "signup").alias("is_ai"),
    )


def admissions_from_events(events: DataFrame) -> DataFrame:
    """Submitted requests: two busy hours a day, one client with a third of them, URLs that
    fail every rule, reviews by others than administrators and with unusable payloads."""
    i, u = F.col("event_id"), F.col("user_id")
    day, part = 86_400_000_000, 7_200_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    literal = F.get(F.array(*[F.lit(x) for x in FRONTIER_LITERALS]), (F.floor(i / 6) % len(FRONTIER_LITERALS)).cast("int"))
    site = F.concat(F.lit("https://site"), (u % 20).cast("string"), F.lit(".example.com/p/"), (i % 100).cast("string"))
    sent = F.when(i % 6 == 1, F.lit("")).when(i % 6 == 2, F.lit("0")).when(i % 6 == 3, F.lit('"text"')).when(i % 6 == 4, F.lit("{broken"))
    return events.select(
        i.alias("request_id"),
        F.timestamp_micros(us - F.pmod(us, F.lit(day)) + F.pmod(us, F.lit(part))).alias("ts"),
        F.when(i % 6 == 0, literal).otherwise(site).alias("raw_url"),
        F.when(u % 3 == 0, F.lit("203.0.113.7")).when(u % 4 == 1, F.lit("bad")).otherwise(F.lit("")).alias("cf_ip"),
        F.when(u % 4 == 1, F.concat(F.lit("203.0.113."), (u % 250).cast("string"))).otherwise(F.lit("")).alias("real_ip"),
        F.when(u % 4 == 2, F.lit("198.51.100.7, 10.0.0.1")).otherwise(F.lit("")).alias("xff"),
        F.concat(F.lit("192.0.2."), (u % 250).cast("string")).alias("remote_addr"),
        (F.col("event_type") == "signup").alias("is_ai"),
        (u % 7 != 0).alias("is_admin"),
        sent.otherwise(F.lit('{"url":"x"}')).alias("payload"),
        u.cast("bigint").alias("user_id"),
    )


def admission_captures(requests: DataFrame) -> DataFrame:
    """``url, duration_ms, error`` by the URL's length ``L``: none where ``L%7=0``, a timeout where ``L%5=0``."""
    n = F.length("url")
    urls = requests.select(F.col("raw_url").alias("url")).filter(F.col("url").startswith("https://site")).distinct()
    return urls.filter(n % 7 != 0).select("url", (n * 37 % 2000).cast("int").alias("duration_ms"), F.when(n % 5 == 0, F.lit("timeout")).alias("error"))


def _review_text(p: Column, variant: int) -> Column:
    """Inner JSON text of a model answer (variants 0, 1, 2)."""
    s = p.cast("string")
    score = {0: (p % 101).cast("string"), 1: F.lit("null"), 2: None}[variant]
    parts = [F.lit("{")]
    if score is not None:
        parts += [F.lit('"overall_score":'), score, F.lit(",")]
    parts += [
        F.lit('"summary":"Review of page '), s, F.lit('",'),
        F.lit('"ratings":{"performance":'), (p % 50 + 50).cast("string"),
        F.lit(',"seo":'), (p % 40 + 30).cast("string"),
        F.lit(',"security":'), (p % 30 + 60).cast("string"),
        F.lit(',"mobile":'), (p % 20 + 40).cast("string"),
        F.lit(',"accessibility":'), (p % 10 + 85).cast("string"),
        F.lit(',"technical":'), (p % 60 + 20).cast("string"), F.lit("},"),
        F.lit('"critical_issues":[{"issue":"Slow server","description":"TTFB high","priority":"high"},'
              '{"issue":"No CSP","description":"Add a policy"}],'),
        F.lit('"seo_report":{"assessment":"Fair","strengths":["titles"],"weaknesses":["links"]},'),
        F.lit('"performance_tips":["Cache assets","Compress images"],'),
        F.lit('"content_analysis":"Readable",'),
    ]
    if variant == 2:
        parts += [F.lit('"recommendations":[],')]
    else:
        parts += [
            F.lit('"recommendations":[{"title":"Tune cache","description":"Set max-age","priority":"low","category":"performance"},'
                  '{"title":"Add CSP","description":"Set a policy","priority":"critical","category":"security"},'
                  '{"title":"Odd one","description":"Unknown level","priority":"urgent","category":"seo"}],'),
        ]
    parts += [F.lit('"ai_notes":"none"}')]
    return F.concat(*parts)


def _envelope(text: Column) -> Column:
    return F.to_json(
        F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    )


def ai_responses_from_pages(pages: DataFrame) -> DataFrame:
    """``ai_responses(url, status, body, error)`` by ``p%7``."""
    p = F.col("page_id")
    m = p % 7
    body = (
        F.when(m == 0, _envelope(_review_text(p, 0)))
        .when(m == 1, _envelope(_review_text(p, 1)))
        .when(m == 2, _envelope(_review_text(p, 2)))
        .when(m == 3, F.lit('{"error":{"message":"quota"}}'))
        .when(m == 4, F.lit("{}"))
        .when(m == 5, _envelope(F.lit("")))
        .otherwise(_envelope(F.lit("not json")))
    )
    status = F.when(m == 3, 429).when(m == 4, 500).otherwise(200).cast("int")
    err = F.when(p % 13 == 12, F.lit("timeout")).otherwise(F.lit(None).cast("string"))
    return pages.where(p % 11 != 10).select(
        p.alias("page_id"), F.col("url"), status.alias("status"), body.alias("body"), err.alias("error")
    )


class Tables:
    """Lazily derived inputs of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def crawl(self) -> DataFrame:
        return crawl_from_pages(self.raw("pages"))

    def fetches(self) -> DataFrame:
        """The crawl with failed fetches: ``p%23=22`` timed out."""
        p = F.col("page_id")
        return self.crawl().withColumn("error", F.when(p % 23 == 22, F.lit("timeout")))

    def robots(self) -> DataFrame:
        return robots_from_pages(self.raw("pages"))

    def sitemaps(self) -> DataFrame:
        return sitemaps_from_pages(self.raw("pages"))

    def redirects(self) -> DataFrame:
        return redirects_from_pages(self.raw("pages"))

    def redirect_start(self) -> DataFrame:
        return redirect_start(self.raw("pages"))

    def frontier(self) -> DataFrame:
        return frontier_from_pages(self.raw("pages"))

    def dns(self) -> DataFrame:
        return dns_from_frontier(self.frontier())

    def statistics(self) -> DataFrame:
        return statistics_from_events(self.raw("events"))

    def users(self) -> DataFrame:
        return users_from_customer(self.raw("customer"))

    def requests(self) -> DataFrame:
        return requests_from_events(self.raw("events"))

    def admissions(self) -> DataFrame:
        return admissions_from_events(self.raw("events"))

    def admission_dns(self) -> DataFrame:
        return dns_from_frontier(self.admissions().select("request_id", "raw_url"))

    def admission_captures(self) -> DataFrame:
        return admission_captures(self.admissions())

    def ai_responses(self) -> DataFrame:
        return ai_responses_from_pages(self.raw("pages"))
