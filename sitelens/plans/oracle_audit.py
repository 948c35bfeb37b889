"""DuckDB twins of the page-audit queries (S1-S3, H*, P*, C*, K*, R*).

The crawl fixture and the per-page features are rebuilt in SQL from FIXTURES.md
and the rule text; header values are plain columns here (no map), and element
lists are parsed per matched tag with RE2.
"""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
NBSP = "chr(160)"


def php_trim(x: str) -> str:
    return f"trim({x}, {TRIM})"


def decode(x: str) -> str:
    pairs = [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&#039;", "''''"),
             ("&apos;", "''''"), ("&nbsp;", NBSP), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")]
    for ent, ch in pairs:
        x = f"replace({x}, {lit(ent)}, {ch})"
    return x


def text_of(x: str) -> str:
    return php_trim(decode(f"regexp_replace({x}, '<[a-zA-Z/!?][^>]*(?:>|\\z)', '', 'g')"))


# Tags here: an opener is matched as far as it goes; it is a tag if a bracket follows.
REST = r"""(?:[^>=]|=\s*(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z)|[^\s>"'][^\s>]*)?)*"""


def opener(names: str) -> str:
    return rf"<(?:{names})(?:[\s/]{REST})?"


def raw_element(name: str) -> str:
    return rf"({opener(name)}(?:>|\z)).*?(</{name}\s*>|\z)"


RAW = lit(rf"(?is)<!--.*?(?:-->|\z)|{raw_element('script')}|{raw_element('style')}")


def masked(body: str) -> str:
    return f"regexp_replace({body}, {RAW}, '\\1\\2\\3\\4', 'g')"


def tags_of(x: str, names: str) -> str:
    """List of (tag, a) of the closed tags ``names`` in ``x``."""
    found = f"regexp_extract_all({x}, {lit(rf'(?i){opener(names)}(?:>|\z)')})"
    parts = f"list_transform({found}, lambda t: {{'t': t, 'o': regexp_extract(t, {lit(rf'(?i){opener(names)}')}), 'n': length(regexp_extract(t, '^<([A-Za-z]+)', 1))}})"
    whole = f"list_filter({parts}, lambda t: t.t <> t.o)"
    return f"list_transform({whole}, lambda t: {{'tag': lower(substr(t.o, 2, t.n)), 'a': substr(t.o, 2 + t.n)}})"


# whole attributes, one after the other; the first of a name counts
ATTR_RE = lit(r"""(?s)[^\s"'=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
ATTR_NAME = lit(r"""^[^\s"'=>/]+""")
ATTR_VALUE = lit(r"""(?s)^[^\s"'=>/]+\s*=\s*(.*)$""")


def _named(a: str, name: str) -> str:
    return f"list_filter(regexp_extract_all({a}, {ATTR_RE}), lambda q: lower(regexp_extract(q, {ATTR_NAME})) = '{name}')"


def attr(a: str, name: str) -> str:
    value = f"[regexp_extract({_named(a, name)}[1], {ATTR_VALUE}, 1)]"
    quotes = lit('"') + ", " + lit("'")
    return decode(f"coalesce(list_transform({value}, lambda w: CASE WHEN w[1] IN ({quotes}) THEN substr(w, 2, length(w) - 2) ELSE w END)[1], '')")


def has_attr(a: str, name: str) -> str:
    return f"(len({_named(a, name)}) > 0)"


URL_RE = lit(
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
HAS_AUTH = lit(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")


def host(u: str) -> str:
    return f"(CASE WHEN regexp_matches({u}, {HAS_AUTH}) THEN regexp_extract({u}, {URL_RE}, 3) ELSE '' END)"


def scheme(u: str) -> str:
    return f"regexp_extract({u}, {URL_RE}, 1)"


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# Fixed values of the fixture recipe: awkward markup by p % 16.
AWKWARD = {
    3: "<a href=/x title=it's>q</a><img src=\"/apos.png\" alt=\"pic\"><p>don't</p>",
    5: '<img alt="a > b" src=/gt.png><a-b href="/no">custom</a-b><img title="x alt=none"><img ALT=first alt=second>',
    7: "<h3>open <i>one</i><h4>next</h4><p>1 < 2 and <b>3</b></p>",
    11: '<script>var s = "<!--";</script><img src="/after.png" alt="x"><!-- <script> --><img src=/still.png>',
    13: "<h5 class='a>b'>five</h5 ><style>p > a { } <img></style><img src='/s.png' alt=''>",
    15: '<img src="/last.png" alt="last"><!-- never closed <img src="/no.png"> <h1>no</h1>',
}
LONG_CSP = "default-src 'self'; script-src 'self' https://cdn.example.com; style-src 'self' 'unsafe-inline'; img-src *"


def _if(cond: str, *parts: str) -> str:
    return f"(CASE WHEN {cond} THEN {' || '.join(parts)} ELSE '' END)"


HEAD = " || ".join([
    _if("p % 2 = 0", lit('<meta name="description" content=" Description of page '), s("p"), lit(' ">')),
    _if("p % 4 = 3", lit('<meta name="Description" content="wrong case">')),
    _if("p % 3 <> 0", lit('<link rel="canonical" href="'), "u", lit('">')),
    _if("p % 7 = 0", lit('<meta name="robots" content="NOINDEX, follow">')),
    _if("p % 3 = 0", lit('<meta name="viewport" content="width=device-width, initial-scale=1">')),
    _if("p % 3 = 1", lit('<meta name="viewport" content="width=1024">')),
    _if("p % 4 = 0", lit('<meta property="og:title" content="OG '), s("p"), lit('"><meta property="og:type" content="article">')),
    _if("p % 8 = 0", lit('<meta property="og:title" content="OG2 '), s("p"), lit('">')),
    _if("p % 5 = 0", lit('<meta name="twitter:card" content="summary">')),
    _if("p % 6 = 0", lit('<script type="application/ld+json">{"@type":"Article","id":'), s("p"), lit("}</script>")),
    _if("p % 6 = 1", lit('<script type="application/ld+json">{}</script>')),
    _if("p % 6 = 2", lit('<script type="application/ld+json">{bad</script>')),
])

ARTICLE = " || ".join([
    _if("p % 5 >= 1", lit('<img src="/i'), s("p"), lit('.png" alt="img">')),
    _if("p % 5 >= 2", lit('<img src="/j'), s("p"), lit('.png">')),
    _if("p % 5 >= 3", lit('<img src="/k'), s("p"), lit('.png" alt="">')),
    _if("p % 5 >= 4", lit('<img src="/l'), s("p"), lit('.png" alt=" ">')),
    _if("p % 12 = 5", "repeat(" + lit('<img src="/m.png">') + ", 6)"),
    _if("p % 4 = 1", lit("<h2>Sub <b>"), s("p"), lit("</b></h2>")),
    _if("p % 3 = 1", lit('<a href="https://ext.example.com/'), s("p"),
        lit('">x</a><a href="//cdn.example.com/a">c</a><a href="mailto:a@b.c">m</a><a href="">e</a><a name="n">none</a>')),
    _if("p % 3 = 2", lit('<a href="'), "u", lit('">self</a>')),
    *[_if(f"p % 16 = {k}", lit(text)) for k, text in AWKWARD.items()],
])

CRAWL_CTE = f"""
cr0 AS (
  SELECT page_id AS p, url AS u,
         CASE WHEN page_id % 9 = 0 THEN replace(replace(html, '<h1>', '<div class="h">'), '</h1>', '</div>') ELSE html END AS b1,
         CASE page_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'Short' WHEN 2 THEN repeat('x', 9) WHEN 3 THEN repeat('x', 10)
              WHEN 4 THEN repeat('x', 70) WHEN 5 THEN repeat('x', 71) END AS nt
  FROM pages
),
cr1 AS (
  SELECT p, u, CASE WHEN nt IS NULL THEN b1
                    ELSE split_part(b1, '<title>', 1) || '<title>' || nt || '</title>' || split_part(b1, '</title>', 2) END AS b2
  FROM cr0
),
crawl AS (
  SELECT p, u,
    CASE WHEN p % 13 = 0 THEN ''
         ELSE replace(replace(b2, '</head>', {HEAD} || '</head>'), '</article>', {ARTICLE} || '</article>') END AS body,
    CASE WHEN p % 10 = 9 THEN 404 WHEN p % 10 = 8 THEN 204 ELSE 200 END AS status,
    'text/html; charset=utf-8' AS h_content_type,
    CASE WHEN p % 6 = 3 THEN 'GZIP' WHEN p % 3 = 0 THEN 'gzip' WHEN p % 3 = 1 THEN 'br' END AS h_content_encoding,
    CASE WHEN p % 5 <> 0 THEN 'max-age=3600' END AS h_cache_control,
    CASE WHEN p % 2 = 0 THEN 'nginx' ELSE 'Apache' END AS h_server,
    CASE WHEN p % 2 = 0 THEN 'max-age=31536000' END AS h_hsts,
    CASE WHEN p % 3 = 0 THEN (CASE WHEN p % 9 = 3 THEN '' WHEN p % 6 = 0 THEN {lit(LONG_CSP)} ELSE {lit("default-src 'self'")} END) END AS h_csp,
    CASE WHEN p % 4 <> 0 THEN 'SAMEORIGIN' END AS h_xfo,
    CASE WHEN p % 5 = 0 THEN '1; mode=block' END AS h_xss,
    CASE WHEN p % 4 = 0 THEN 'strict-origin-when-cross-origin' END AS h_referrer,
    CASE WHEN p % 3 <> 1 THEN 'nosniff' END AS h_xcto,
    CASE WHEN p % 7 = 0 THEN 'geolocation=()' END AS h_pp,
    ([NULL, 0, 500, 800, 801, 1500, 1501, 3000, 3001, 5000, 5001, 10000, 10001]::DOUBLE[])[p % 13 + 1] AS load_ms,
    ([NULL, 0, 120, 350]::DOUBLE[])[p % 4 + 1] AS nav_ttfb_ms
  FROM cr1
)"""

SITES_CTE = f"""
sites0 AS (
  SELECT DISTINCT {scheme('url')} || '://' || {host('url')} AS base, length({host('url')}) AS L FROM pages
),
robots AS (
  SELECT base || '/robots.txt' AS robots_url,
         CASE WHEN L % 5 = 0 THEN 404 ELSE 200 END AS status,
         CASE L % 5 WHEN 0 THEN '<html><body>Not Found</body></html>' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /'
              WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) ELSE 'User-agent: *' || chr(10) || 'Disallow: /private' END AS content
  FROM sites0 WHERE L % 5 <> 4
),
sitemaps AS (
  SELECT base || '/sitemap.xml' AS sitemap_url, 200 AS status FROM sites0 WHERE L % 4 = 0
  UNION ALL SELECT base || '/sitemap.xml', 404 FROM sites0 WHERE L % 4 = 1
  UNION ALL SELECT base || '/sitemap_index.xml', 200 FROM sites0 WHERE L % 4 = 1
  UNION ALL SELECT base || '/sitemap-index.xml', 200 FROM sites0 WHERE L % 4 = 2
  UNION ALL SELECT base || '/sitemap_index.xml', 301 FROM sites0 WHERE L % 4 = 2
),
robots_site AS (
  SELECT robots_url,
         status = 200 AS r_exists,
         {php_trim("regexp_replace(content, '<[^>]*>', '', 'g')")} AS r_content,
         status = 200 AND regexp_matches(content, '(?is)User-agent:\\s*\\*.*?Disallow:\\s*/') AS r_blocks
  FROM robots
),
sitemap_site AS (
  SELECT prefix AS base, arg_min(sitemap_url, rnk) AS s_url
  FROM (
    SELECT sitemap_url,
           CASE WHEN suffix(sitemap_url, '/sitemap.xml') THEN 0 WHEN suffix(sitemap_url, '/sitemap_index.xml') THEN 1
                WHEN suffix(sitemap_url, '/sitemap-index.xml') THEN 2 END AS rnk,
           regexp_replace(sitemap_url, '/(sitemap\\.xml|sitemap_index\\.xml|sitemap-index\\.xml)$', '') AS prefix
    FROM sitemaps WHERE status = 200
  ) WHERE rnk IS NOT NULL GROUP BY prefix
)"""

FALSY = "['{}', '[]', '0', '0.0', '-0', '\"\"', '\"0\"', 'false', 'null']"

H0_OPEN = lit(rf"(?i)^<[a-z][a-z0-9:_.\-]*{REST}")
H0_RE = lit(rf"(?i)<[a-z][a-z0-9:_.\-]*{REST}(?:>[^<]*|\z)")
TITLE_RE = lit(rf"(?is){opener('title')}(?:>|\z)(.*?)(?:</title\s*>|\z)")
TITLE_TEXT = text_of(f"regexp_extract(masked, {TITLE_RE}, 1)")
FEATURES_CTE = f"""
fb AS (
  SELECT *, {masked('body')} AS masked FROM crawl
),
fc AS (
  SELECT p, u, status, body, h_content_type, h_content_encoding, h_cache_control, h_server, h_hsts, h_csp, h_xfo, h_xss,
         h_referrer, h_xcto, h_pp, load_ms, nav_ttfb_ms,
         {tags_of('masked', 'meta|link|img|a')} AS tags,
         list_transform(list_filter(list_transform(
             list_filter(string_split(regexp_replace(masked, {lit(r'(?i)(<h[1-6][\s/>])')}, chr(1) || '\\1', 'g'), chr(1)),
                         lambda h: regexp_matches(h, {lit(r'(?i)^<h[1-6][\s/>]')})),
             lambda h: {{'h': h, 'o': regexp_extract(h, {lit(rf"(?i)^{opener('h[1-6]')}")})}}), lambda h: length(h.h) > length(h.o)),
             lambda h: {{'level': lower(substr(h.h, 2, 2)),
                        'text': {text_of("regexp_extract(substr(h.h, length(h.o) + 2), '(?is)^(.*?)(?:</h[1-6][ \\t\\r\\n]*>|\\z)', 1)")}}}) AS heads,
         list_transform(list_transform(
             list_filter(regexp_extract_all(body, {RAW}), lambda x: starts_with(lower(x), '<script')),
             lambda x: {{'x': x, 'o': regexp_extract(x, {lit(rf"(?i)^{opener('script')}")})}}),
             lambda x: {{'type': {attr("substr(x.o, 8)", 'type')},
                        'text': regexp_replace(substr(x.x, length(x.o) + 2), '(?is)</script\\s*>\\z', '')}}) AS scripts,
         {TITLE_TEXT} AS title,
         CAST(strlen(body) AS BIGINT) AS page_size_bytes,
         {host('u')} AS page_host
  FROM fb
),
fd AS (
  SELECT *,
    list_transform(list_filter(tags, lambda t: t.tag = 'meta'),
        lambda t: {{'name': {attr('t.a', 'name')}, 'property': {attr('t.a', 'property')}, 'content': {attr('t.a', 'content')},
                   'has_content': {has_attr('t.a', 'content')}}}) AS metas,
    list_transform(list_filter(tags, lambda t: t.tag = 'link'),
        lambda t: {{'rel': {attr('t.a', 'rel')}, 'href': {attr('t.a', 'href')}, 'has_href': {has_attr('t.a', 'href')}}}) AS links,
    list_transform(list_filter(tags, lambda t: t.tag = 'img'),
        lambda t: {{'src': {attr('t.a', 'src')}, 'alt': {attr('t.a', 'alt')}}}) AS imgs,
    list_transform(list_filter(tags, lambda t: t.tag = 'a' AND {has_attr('t.a', 'href')}),
        lambda t: {host(attr('t.a', 'href'))}) AS hrefs
  FROM fc
),
feat AS (
  SELECT p, u, status, h_content_type, h_content_encoding, h_cache_control, h_server, h_hsts, h_csp, h_xfo, h_xss,
         h_referrer, h_xcto, h_pp, load_ms, nav_ttfb_ms, page_size_bytes, metas, heads, imgs,
         title,
         CAST(length(title) AS BIGINT) AS title_length,
         coalesce({php_trim("list_filter(metas, lambda m: m.name = 'description' AND m.has_content)[1].content")}, '') AS meta_description,
         coalesce({php_trim("list_filter(links, lambda l: l.rel = 'canonical' AND l.has_href)[1].href")}, '') AS canonical,
         coalesce({php_trim("list_filter(metas, lambda m: m.name = 'robots' AND m.has_content)[1].content")}, '') AS robots_meta,
         coalesce({php_trim("list_filter(metas, lambda m: m.name = 'viewport' AND m.has_content)[1].content")}, '') AS viewport,
         list_transform(list_filter(heads, lambda h: h.level = 'h1'), lambda h: h.text) AS h1,
         CAST(len(list_filter(imgs, lambda i: i.alt = '')) AS BIGINT) AS images_without_alt,
         CAST(len(imgs) AS BIGINT) AS total_images,
         CAST(len(list_filter(imgs, lambda i: i.alt <> '')) AS BIGINT) AS images_with_alt,
         len(list_filter(metas, lambda m: starts_with(m.property, 'og:'))) > 0 AS has_og,
         len(list_filter(metas, lambda m: starts_with(m.name, 'twitter:'))) > 0 AS has_twitter,
         list_transform(list_filter(scripts, lambda x: x.type = 'application/ld+json' AND json_valid(x.text)
                          AND NOT list_contains({FALSY}, regexp_replace(x.text, '\\s', '', 'g'))), lambda x: x.text) AS schema,
         CAST(len(list_filter(hrefs, lambda h: h = '' OR h = page_host)) AS BIGINT) AS internal_links,
         CAST(len(list_filter(hrefs, lambda h: h <> '' AND h <> page_host)) AS BIGINT) AS external_links
  FROM fd
),
feat2 AS (
  SELECT *, len(schema) > 0 AS has_schema, contains(lower(robots_meta), 'noindex') AS is_noindex,
         {scheme('u')} || '://' || {host('u')} AS base
  FROM feat
)"""

REPORT_CTE = f"""
rep0 AS (
  SELECT f.*, r.robots_url IS NOT NULL AND r.r_exists AS robots_exists,
         r.robots_url AS robots_url, coalesce(r.r_content, '') AS robots_content, coalesce(r.r_blocks, false) AS blocks_all,
         sm.s_url IS NOT NULL AS sitemap_exists, coalesce(sm.s_url, '') AS sitemap_url
  FROM feat2 f
  LEFT JOIN robots_site r ON r.robots_url = f.base || '/robots.txt'
  LEFT JOIN sitemap_site sm ON sm.base = f.base
),
rep AS (
  SELECT *,
    CAST(status AS BIGINT) AS status_code,
    starts_with(u, 'https://') AS https,
    lower(coalesce(h_content_encoding, '')) AS content_encoding,
    contains(lower(coalesce(h_content_encoding, '')), 'gzip') AS has_gzip,
    contains(lower(coalesce(h_content_encoding, '')), 'br') AS has_brotli,
    round(page_size_bytes / 1024.0, 2)::DOUBLE AS page_size_kb,
    CASE WHEN coalesce(load_ms, 0) <> 0 THEN CAST(floor(load_ms + 0.5) AS BIGINT) ELSE 0 END AS load_time_ms,
    CASE WHEN coalesce(load_ms, 0) <> 0 THEN CAST(floor(load_ms * 0.15::DOUBLE + 0.5) AS BIGINT)
         WHEN coalesce(nav_ttfb_ms, 0) <> 0 THEN CAST(floor(nav_ttfb_ms + 0.5) AS BIGINT) END AS ttfb_ms,
    CASE WHEN coalesce(load_ms, 0) <> 0 THEN CAST(floor(load_ms * 0.30::DOUBLE + 0.5) AS BIGINT) END AS fcp_ms,
    CASE WHEN coalesce(load_ms, 0) <> 0 THEN CAST(floor(load_ms * 0.55::DOUBLE + 0.5) AS BIGINT) END AS lcp_ms,
    CASE WHEN coalesce(load_ms, 0) <> 0 THEN CAST(floor(load_ms * 0.60::DOUBLE + 0.5) AS BIGINT) END AS speed_index_ms,
    viewport <> '' AS has_viewport,
    contains(viewport, 'width=device-width') AS is_responsive,
    CASE WHEN total_images > 0 THEN CAST(floor(images_with_alt / total_images * 100.0 + 0.5) AS BIGINT) ELSE 100 END AS alt_text_score,
    h_hsts IS NOT NULL AS has_hsts, h_csp IS NOT NULL AS has_csp, h_xfo IS NOT NULL AS has_x_frame,
    h_xss IS NOT NULL AS has_xss_prot, h_referrer IS NOT NULL AS has_referrer, h_xcto IS NOT NULL AS has_x_content
  FROM rep0
),
sc0 AS (
  SELECT *,
    robots_exists AND NOT blocks_all AS robots_ok,
    CAST(greatest(0, 100
      - (CASE WHEN title = '' THEN 20 WHEN title_length < 10 OR title_length > 70 THEN 10 ELSE 0 END)
      - (CASE WHEN meta_description = '' THEN 15 ELSE 0 END)
      - (CASE WHEN canonical = '' THEN 5 ELSE 0 END)
      - (CASE WHEN NOT has_og THEN 5 ELSE 0 END)
      - (CASE WHEN NOT has_schema THEN 5 ELSE 0 END)
      - (CASE WHEN is_noindex THEN 30 ELSE 0 END)
      - (CASE WHEN images_without_alt > 0 THEN least(15, images_without_alt * 3) ELSE 0 END)
      - (CASE WHEN len(h1) = 0 THEN 10 ELSE 0 END)
      - (CASE WHEN NOT robots_exists THEN 5 ELSE 0 END)
      - (CASE WHEN NOT sitemap_exists THEN 5 ELSE 0 END)) AS BIGINT) AS s_seo,
    CAST(greatest(0, 100 - (CASE WHEN NOT https THEN 30 ELSE 0 END) - (CASE WHEN NOT has_hsts THEN 15 ELSE 0 END)
      - (CASE WHEN NOT has_csp THEN 15 ELSE 0 END) - (CASE WHEN NOT has_x_frame THEN 10 ELSE 0 END)
      - (CASE WHEN NOT has_x_content THEN 10 ELSE 0 END) - (CASE WHEN NOT has_referrer THEN 5 ELSE 0 END)
      - (CASE WHEN NOT has_xss_prot THEN 5 ELSE 0 END)) AS BIGINT) AS s_security,
    CAST(greatest(0, 100 - (CASE WHEN NOT has_viewport THEN 40 ELSE 0 END) - (CASE WHEN NOT is_responsive THEN 30 ELSE 0 END)) AS BIGINT) AS s_mobile,
    alt_text_score AS s_accessibility,
    CAST(CASE WHEN load_time_ms > 10000 THEN 20 WHEN load_time_ms > 5000 THEN 40 WHEN load_time_ms > 3000 THEN 60
              WHEN load_time_ms > 1500 THEN 75 WHEN load_time_ms > 800 THEN 90 ELSE 100 END AS BIGINT) AS s_performance
  FROM rep
),
scored0 AS (
  SELECT *,
    CAST(greatest(0, 100 - (CASE WHEN status_code <> 200 THEN 30 ELSE 0 END) - (CASE WHEN NOT https THEN 15 ELSE 0 END)
      - (CASE WHEN NOT has_gzip AND NOT has_brotli THEN 10 ELSE 0 END) - (CASE WHEN NOT robots_ok THEN 10 ELSE 0 END)
      - (CASE WHEN NOT sitemap_exists THEN 5 ELSE 0 END)) AS BIGINT) AS s_technical
  FROM sc0
),
scored AS (
  SELECT *,
    CAST(floor(s_seo * 0.25::DOUBLE + s_security * 0.20::DOUBLE + s_performance * 0.20::DOUBLE + s_mobile * 0.15::DOUBLE
               + s_technical * 0.12::DOUBLE + s_accessibility * 0.08::DOUBLE + 0.5) AS BIGINT) AS s_overall
  FROM scored0
)"""

BASE = f"WITH {CRAWL_CTE},{SITES_CTE},{FEATURES_CTE},{REPORT_CTE}"
FEAT_ONLY = f"WITH {CRAWL_CTE},{FEATURES_CTE}"

PERF_NOTE = "Metrics are estimated via iframe load timing. For precise metrics, use Lighthouse in Chrome DevTools."


def band(x: str) -> str:
    return f"(CASE WHEN {x} >= 80 THEN 'green' WHEN {x} >= 60 THEN 'amber' ELSE 'red' END)"


def audit_sql() -> dict[str, str]:
    q = {}
    q["s1_crawl_scan"] = f"""WITH {CRAWL_CTE}
SELECT p AS page_id, u AS url, CAST(status AS BIGINT) AS status, CAST(strlen(body) AS BIGINT) AS body_bytes,
  array_to_string(list_sort(list_filter(['content-type', CASE WHEN h_content_encoding IS NOT NULL THEN 'content-encoding' END,
     CASE WHEN h_cache_control IS NOT NULL THEN 'cache-control' END, 'server',
     CASE WHEN h_hsts IS NOT NULL THEN 'strict-transport-security' END, CASE WHEN h_csp IS NOT NULL THEN 'content-security-policy' END,
     CASE WHEN h_xfo IS NOT NULL THEN 'x-frame-options' END, CASE WHEN h_xss IS NOT NULL THEN 'x-xss-protection' END,
     CASE WHEN h_referrer IS NOT NULL THEN 'referrer-policy' END, CASE WHEN h_xcto IS NOT NULL THEN 'x-content-type-options' END,
     CASE WHEN h_pp IS NOT NULL THEN 'permissions-policy' END], lambda x: x IS NOT NULL)), ',') AS header_names
FROM crawl"""
    q["s2_robots_scan"] = f"""WITH {SITES_CTE}
SELECT robots_url, CAST(status AS BIGINT) AS status, CAST(strlen(content) AS BIGINT) AS content_bytes FROM robots"""
    q["s3_sitemap_scan"] = f"WITH {SITES_CTE} SELECT sitemap_url, CAST(status AS BIGINT) AS status FROM sitemaps"
    q["h0_elements"] = f"""WITH {CRAWL_CTE},
m AS (SELECT p, {masked('body')} AS masked FROM crawl),
t AS (
  SELECT p, unnest(regexp_extract_all(masked, {H0_RE})) AS e, generate_subscripts(regexp_extract_all(masked, {H0_RE}), 1) AS i FROM m
),
o AS (SELECT *, regexp_extract(e, {H0_OPEN}) AS o, regexp_extract(e, '^<([A-Za-z][A-Za-z0-9:_.\\-]*)', 1) AS name FROM t)
SELECT p AS page_id, CAST(i - 1 AS BIGINT) AS pos, lower(name) AS tag, substr(o, length(name) + 2) AS attrs, substr(e, length(o) + 2) AS text
FROM o WHERE length(e) > length(o)"""
    q["h1_h5_head_fields"] = f"{FEAT_ONLY} SELECT p AS page_id, title, meta_description, canonical, robots_meta, viewport FROM feat"
    q["h6_headings"] = f"""{FEAT_ONLY},
lv AS (SELECT unnest(['h1','h2','h3','h4','h5','h6']) AS level)
SELECT f.p AS page_id, lv.level,
       CAST(len(list_filter(f.heads, lambda h: h.level = lv.level)) AS BIGINT) AS n,
       array_to_string(list_transform(list_filter(f.heads, lambda h: h.level = lv.level), lambda h: h.text), '|') AS texts
FROM feat f, lv"""
    q["h7_images"] = f"""{FEAT_ONLY},
x AS (SELECT p, unnest(imgs) AS img, generate_subscripts(imgs, 1) AS i FROM feat)
SELECT p AS page_id, CAST(i - 1 AS BIGINT) AS pos, img.src AS src, img.alt AS alt, img.alt <> '' AS has_alt FROM x"""
    q["h8_image_counts"] = f"{FEAT_ONLY} SELECT p AS page_id, total_images, images_without_alt FROM feat"
    for name, fld, pre in (("h9_open_graph", "property", "og:"), ("h10_twitter_card", "name", "twitter:")):
        q[name] = f"""{FEAT_ONLY},
x AS (SELECT p, unnest(list_filter(metas, lambda m: starts_with(m.{fld}, '{pre}'))) AS m,
             generate_subscripts(list_filter(metas, lambda m: starts_with(m.{fld}, '{pre}')), 1) AS i FROM feat),
y AS (SELECT p, m.{fld} AS key, m.content AS value, row_number() OVER (PARTITION BY p, m.{fld} ORDER BY i DESC) AS rn FROM x)
SELECT p AS page_id, key, value FROM y WHERE rn = 1"""
    q["h11_schema"] = f"""{FEAT_ONLY}
SELECT p AS page_id, CAST(len(schema) AS BIGINT) AS n_schema, array_to_string(schema, chr(10)) AS schema_text,
       len(schema) > 0 AS has_schema FROM feat"""
    q["h12_links"] = f"{FEAT_ONLY} SELECT p AS page_id, internal_links, external_links FROM feat"
    q["h13_seo_record"] = f"""{FEAT_ONLY}
SELECT p AS page_id, title, title_length, meta_description, CAST(length(meta_description) AS BIGINT) AS meta_desc_length,
       canonical, robots_meta, viewport, CAST(len(h1) AS BIGINT) AS h1_count, images_without_alt, total_images,
       has_og, has_twitter, len(schema) > 0 AS has_schema, internal_links, external_links,
       contains(lower(robots_meta), 'noindex') AS is_noindex
FROM feat"""
    q["h14_page_size"] = f"""{FEAT_ONLY}
SELECT p AS page_id, page_size_bytes, round(page_size_bytes / 1024.0, 2)::DOUBLE AS page_size_kb FROM feat"""
    q["p1_http"] = f"""{BASE}
SELECT p AS page_id, status_code, status_code BETWEEN 200 AND 299 AS status_ok, status_code BETWEEN 300 AND 399 AS is_redirect,
       u AS final_url, https FROM rep"""
    q["p2_headers"] = f"""{BASE}
SELECT p AS page_id, h_content_type AS content_type, content_encoding, has_gzip, has_brotli,
       coalesce(h_cache_control, '') AS cache_control, '' AS etag, '' AS last_modified, '' AS x_powered_by,
       h_server AS server, '' AS content_length FROM rep"""
    q["p3_security"] = f"""{BASE}
SELECT p AS page_id, https, coalesce(h_hsts, '') AS hsts, coalesce(h_csp, '') AS csp, coalesce(h_xfo, '') AS x_frame_options,
       coalesce(h_xss, '') AS xss_protection, coalesce(h_referrer, '') AS referrer_policy, coalesce(h_xcto, '') AS x_content_type,
       coalesce(h_pp, '') AS permissions_policy, has_hsts, has_csp, has_x_frame, has_xss_prot, has_referrer, has_x_content FROM rep"""
    q["p4_p5_robots"] = f"""{BASE}
SELECT p AS page_id, robots_exists, robots_url, robots_content, blocks_all FROM rep"""
    q["p6_sitemap"] = f"{BASE} SELECT p AS page_id, sitemap_exists, sitemap_url FROM rep"
    q["p8_performance"] = f"{BASE} SELECT p AS page_id, load_time_ms, ttfb_ms, fcp_ms, lcp_ms, speed_index_ms FROM rep"
    q["p9_mobile"] = f"""{BASE}
SELECT p AS page_id, has_viewport, is_responsive, viewport AS viewport_content, is_responsive AS touch_friendly,
       CASE WHEN is_responsive THEN 'Responsive viewport detected.'
            ELSE 'No responsive viewport meta tag found. Mobile users may experience issues.' END AS notes FROM rep"""
    q["p10_accessibility"] = f"""{BASE}
SELECT p AS page_id, total_images, images_with_alt, total_images - images_with_alt AS images_missing_alt, alt_text_score,
       CASE WHEN total_images - images_with_alt > 0 THEN CAST(total_images - images_with_alt AS VARCHAR) || ' image(s) missing alt text.'
            ELSE 'All images have alt text.' END AS notes FROM rep"""
    q["p11_technical"] = f"""{BASE}
SELECT p AS page_id, status_code, https, has_gzip, has_brotli, coalesce(h_cache_control, '') AS cache_control, h_server AS server,
       page_size_kb, robots_exists AND NOT blocks_all AS robots_ok, sitemap_exists AS sitemap_ok FROM rep"""
    q["c8_page_scorecard"] = f"""{BASE}
SELECT p AS page_id, u AS url, s_overall AS overall, s_seo AS seo, s_security AS security, s_performance AS performance,
       s_mobile AS mobile, s_technical AS technical, s_accessibility AS accessibility FROM scored"""
    q["c9_bands"] = f"{BASE} SELECT p AS page_id, s_overall AS overall, {band('s_overall')} AS band FROM scored"
    q["c10_summary"] = f"""{BASE},
w AS (
  SELECT p, regexp_replace(regexp_replace(u, '^https?://', ''), '/$', '') AS shown, s_overall,
         list_filter([CASE WHEN s_security < 60 THEN 'security headers' END, CASE WHEN s_seo < 60 THEN 'SEO metadata' END,
                      CASE WHEN s_mobile < 70 THEN 'mobile optimisation' END, CASE WHEN s_performance < 60 THEN 'performance' END],
                     lambda x: x IS NOT NULL) AS weak
  FROM scored
)
SELECT p AS page_id,
  CASE WHEN len(weak) = 0 THEN shown || ' scores ' || CAST(s_overall AS VARCHAR) || '/100 overall and looks healthy across all categories.'
       ELSE shown || ' scores ' || CAST(s_overall AS VARCHAR) || '/100. Key areas for improvement: ' || array_to_string(weak, ', ') || '.' END AS summary
FROM w"""
    q["c11_score_cards"] = f"""{BASE},
cards AS (
  SELECT p, 0 AS ord, 'performance' AS key, 'Performance' AS label, s_performance AS score FROM scored
  UNION ALL SELECT p, 1, 'seo', 'SEO', s_seo FROM scored
  UNION ALL SELECT p, 2, 'security', 'Security', s_security FROM scored
  UNION ALL SELECT p, 3, 'mobile', 'Mobile', s_mobile FROM scored
  UNION ALL SELECT p, 4, 'technical', 'Technical', s_technical FROM scored
  UNION ALL SELECT p, 5, 'accessibility', 'Accessibility', s_accessibility FROM scored
)
SELECT p AS page_id, CAST(ord AS BIGINT) AS ord, key, label, CAST(score AS BIGINT) AS score, {band('score')} AS band FROM cards"""
    return q


def fmt_ms(x: str) -> str:
    # printf rounds by the double's exact value too, but exact ties (n * 125 ms) to even
    return (f"(CASE WHEN {x} >= 1000 AND {x} % 125 = 0 AND {x} % 10 = 5 THEN printf('%.2fs', ({x} + 5) // 10 / 100.0) "
            f"WHEN {x} >= 1000 THEN printf('%.2fs', {x} / 1000.0) ELSE CAST({x} AS VARCHAR) || 'ms' END)")


def _metric(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, 0) <> 0 THEN {fmt_ms(x)} ELSE '—' END)"


def _pf(c: str) -> str:
    return f"(CASE WHEN coalesce({c}, false) THEN 'pass' ELSE 'fail' END)"


def _or(v: str, fb: str) -> str:
    return f"(CASE WHEN coalesce({v}, '') <> '' THEN {v} ELSE {lit(fb)} END)"


def checks_sql() -> dict[str, str]:
    good = lambda c: f"(CASE WHEN coalesce({c}, true) THEN 'good' ELSE 'warn' END)"
    na = "NULL"
    rows = [
        ("performance", 0, "Load Time", good("load_time_ms < 2000"), _metric("load_time_ms")),
        ("performance", 1, "TTFB", good("ttfb_ms < 200"), _metric("ttfb_ms")),
        ("performance", 2, "First Contentful Paint", good("fcp_ms < 1800"), _metric("fcp_ms")),
        ("performance", 3, "Largest Contentful Paint", good("lcp_ms < 2500"), _metric("lcp_ms")),
        ("performance", 4, "Cumulative Layout Shift", "'good'", "'N/A'"),
        ("performance", 5, "Speed Index", good("speed_index_ms < 3400"), _metric("speed_index_ms")),
        ("seo", 0, "Page Title", _pf("title <> ''"), _or("title", "Missing")),
        ("seo", 1, "Meta Description", _pf("meta_description <> ''"), _or("meta_description", "Missing")),
        ("seo", 2, "Canonical URL", _pf("canonical <> ''"), _or("canonical", "Missing")),
        ("seo", 3, "Robots Meta", _pf("NOT is_noindex"), _or("robots_meta", "Not set (indexable by default)")),
        ("seo", 4, "Open Graph", _pf("has_og"), "(CASE WHEN has_og THEN 'Present' ELSE 'Missing' END)"),
        ("seo", 5, "Twitter Cards", _pf("has_twitter"), "(CASE WHEN has_twitter THEN 'Present' ELSE 'Missing' END)"),
        ("seo", 6, "Schema.org", _pf("has_schema"), "(CASE WHEN has_schema THEN CAST(len(schema) AS VARCHAR) || ' type(s)' ELSE 'Missing' END)"),
        ("seo", 7, "H1 Tag", _pf("len(h1) > 0"), _or("array_to_string(h1, ', ')", "Missing")),
        ("seo", 8, "robots.txt", _pf("robots_exists"), "(CASE WHEN robots_exists THEN robots_url ELSE 'Not found' END)"),
        ("seo", 9, "sitemap.xml", _pf("sitemap_exists"), "(CASE WHEN sitemap_exists THEN sitemap_url ELSE 'Not found' END)"),
        ("seo", 10, "HTTPS", _pf("https"), "(CASE WHEN https THEN 'Active' ELSE 'Not active' END)"),
        ("seo", 11, "Indexable", _pf("NOT is_noindex AND NOT blocks_all"),
         "(CASE WHEN is_noindex THEN 'Blocked by noindex' WHEN blocks_all THEN 'Blocked by robots.txt' ELSE 'Indexable' END)"),
        ("links", 0, "Internal Links", na, "CAST(internal_links AS VARCHAR)"),
        ("links", 1, "External Links", na, "CAST(external_links AS VARCHAR)"),
        ("links", 2, "Images", na, "CAST(total_images AS VARCHAR)"),
        ("links", 3, "Missing Alt Text", "(CASE WHEN images_without_alt > 0 THEN 'warn' ELSE 'good' END)", "CAST(images_without_alt AS VARCHAR)"),
        ("security", 0, "HTTPS", _pf("https"), "(CASE WHEN https THEN 'Active' ELSE 'Not active' END)"),
        ("security", 1, "HSTS", _pf("has_hsts"), _or("h_hsts", "Not set")),
        ("security", 2, "Content Security Policy", _pf("has_csp"),
         "(CASE WHEN coalesce(h_csp, '') <> '' THEN substr(h_csp, 1, 80) || '…' ELSE 'Not set' END)"),
        ("security", 3, "X-Frame-Options", _pf("has_x_frame"), _or("h_xfo", "Not set")),
        ("security", 4, "XSS Protection", _pf("has_xss_prot"), _or("h_xss", "Not set")),
        ("security", 5, "Referrer Policy", _pf("has_referrer"), _or("h_referrer", "Not set")),
        ("security", 6, "X-Content-Type-Options", _pf("has_x_content"), _or("h_xcto", "Not set")),
        ("security", 7, "Permissions Policy", _pf("coalesce(h_pp, '') <> ''"), _or("h_pp", "Not set")),
        ("mobile", 0, "Viewport meta tag", _pf("has_viewport"), _or("viewport", "Missing")),
        ("mobile", 1, "Responsive design", _pf("is_responsive"), "(CASE WHEN is_responsive THEN 'Detected' ELSE 'Not detected' END)"),
        ("mobile", 2, "Touch-friendly", _pf("is_responsive"), "(CASE WHEN is_responsive THEN 'Likely yes' ELSE 'Uncertain' END)"),
        ("technical", 0, "HTTP Status", _pf("status_code = 200"), "CAST(status_code AS VARCHAR)"),
        ("technical", 1, "HTTPS", _pf("https"), "(CASE WHEN https THEN 'Active' ELSE 'Not active' END)"),
        ("technical", 2, "Compression", _pf("has_gzip OR has_brotli"),
         "(CASE WHEN has_brotli THEN 'Brotli' WHEN has_gzip THEN 'Gzip' ELSE 'None' END)"),
        ("technical", 3, "Cache-Control", "(CASE WHEN coalesce(h_cache_control, '') <> '' THEN 'pass' ELSE 'warn' END)",
         _or("h_cache_control", "Not set")),
        ("technical", 4, "robots.txt", _pf("robots_ok"), "(CASE WHEN robots_ok THEN 'OK' ELSE 'Missing or blocking all' END)"),
        ("technical", 5, "Sitemap", "(CASE WHEN sitemap_exists THEN 'pass' ELSE 'warn' END)",
         "(CASE WHEN sitemap_exists THEN 'Found' ELSE 'Not found' END)"),
        ("server", 0, "Server", na, _or("h_server", "Unknown")),
        ("server", 1, "Content-Type", na, _or("h_content_type", "—")),
        ("server", 2, "Page Size", na,
         "(CASE WHEN page_size_kb = floor(page_size_kb) THEN CAST(CAST(page_size_kb AS BIGINT) AS VARCHAR) "
         "ELSE CAST(page_size_kb AS VARCHAR) END) || ' KB'"),
        ("accessibility", 0, "Image alt texts", _pf("total_images - images_with_alt = 0"),
         "CAST(images_with_alt AS VARCHAR) || ' / ' || CAST(total_images AS VARCHAR) || ' images with alt'"),
    ]
    parts = [
        f"SELECT p AS page_id, {lit(t)} AS tab, CAST({o} AS BIGINT) AS ord, {lit(lb)} AS label, CAST({st} AS VARCHAR) AS status, "
        f"CAST({d} AS VARCHAR) AS detail FROM scored"
        for t, o, lb, st, d in rows
    ]
    q = {"k_page_checks": BASE + "\n" + "\nUNION ALL ".join(parts)}
    q["k9_format_ms"] = f"""{BASE},
x AS (SELECT p, unnest([load_time_ms, fcp_ms, lcp_ms, speed_index_ms]) AS ms FROM scored)
SELECT p AS page_id, ms, {fmt_ms('ms')} AS shown FROM x WHERE ms IS NOT NULL"""
    return q


RULES_SQL = [
    ("title = ''", "'Add a page title'", "Every page needs a descriptive title tag (30–70 characters).", "critical", "seo"),
    ("meta_description = ''", "'Add a meta description'", "Meta descriptions (120–160 chars) improve click-through rates in search results.", "high", "seo"),
    ("NOT https", "'Enable HTTPS'", "HTTPS is required for security and is a ranking signal for Google.", "critical", "security"),
    ("NOT has_hsts", "'Add HSTS header'", "Strict-Transport-Security header prevents protocol downgrade attacks.", "high", "security"),
    ("NOT has_csp", "'Add Content Security Policy'", "CSP header reduces XSS attack surface significantly.", "high", "security"),
    ("NOT is_responsive", "'Add responsive viewport'",
     'Missing viewport meta tag will cause poor mobile experience. Add <meta name="viewport" content="width=device-width, initial-scale=1">.',
     "critical", "mobile"),
    ("NOT has_og", "'Add Open Graph tags'", "OG tags control how your page appears when shared on social networks.", "medium", "seo"),
    ("NOT has_schema", "'Add Schema.org markup'", "Structured data helps search engines understand your content and enables rich results.", "medium", "seo"),
    ("NOT has_gzip AND NOT has_brotli", "'Enable compression'", "Enable Gzip or Brotli compression to reduce page size and improve load times.", "high", "technical"),
    ("images_without_alt > 0", "'Fix ' || CAST(images_without_alt AS VARCHAR) || ' missing alt texts'",
     "Alt text improves accessibility and helps search engines understand image content.", "medium", "seo"),
    ("NOT sitemap_exists", "'Add a sitemap'", "A sitemap.xml helps search engines discover and crawl all your pages.", "medium", "seo"),
]
PRANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def recs_sql() -> dict[str, str]:
    parts = [
        f"SELECT p, {i} AS ord, {PRANK[pr]} AS prank, {title} AS title, {lit(desc)} AS description, {lit(pr)} AS priority, "
        f"{lit(cat)} AS category FROM scored WHERE {cond}"
        for i, (cond, title, desc, pr, cat) in enumerate(RULES_SQL)
    ]
    q = {}
    q["r1_r2_recommendations"] = f"""{BASE},
recs AS ({' UNION ALL '.join(parts)})
SELECT p AS page_id, CAST(row_number() OVER (PARTITION BY p ORDER BY prank, ord) - 1 AS BIGINT) AS rank,
       title, description, priority, category, 'rules' AS source
FROM recs"""
    csv = [("Overall", "s_overall"), ("SEO", "s_seo"), ("Security", "s_security"), ("Performance", "s_performance"),
           ("Mobile", "s_mobile"), ("Technical", "s_technical"), ("Accessibility", "s_accessibility")]
    lines = [f"SELECT p AS page_id, CAST(0 AS BIGINT) AS ord, '\"Category\",\"Score\"' AS line FROM scored"] + [
        f"SELECT p, CAST({i + 1} AS BIGINT), '\"{lab}\",\"' || replace(coalesce(CAST({col} AS VARCHAR), ''), '\"', '\"\"') || '\"' FROM scored"
        for i, (lab, col) in enumerate(csv)
    ]
    q["s10_scores_csv"] = BASE + "\n" + "\nUNION ALL ".join(lines)
    return q


def rollup_sql() -> dict[str, str]:
    q = {}
    checks = checks_sql()["k_page_checks"]
    q["g1_check_pass_rates"] = f"""WITH ck AS ({checks})
SELECT tab, ord, label, count(*) AS pages, avg(CASE WHEN status IN ('pass', 'good') THEN 1.0 ELSE 0.0 END)::DOUBLE AS pass_rate
FROM ck WHERE status IS NOT NULL GROUP BY tab, ord, label"""
    q["g2_host_scorecard"] = f"""{BASE}
SELECT {host('u')} AS host, count(*) AS pages, avg(s_overall)::DOUBLE AS avg_overall, min(s_overall) AS min_overall, max(s_overall) AS max_overall
FROM scored GROUP BY 1"""
    recs = recs_sql()["r1_r2_recommendations"]
    q["g3_recommendation_rollup"] = f"""WITH rr AS ({recs})
SELECT priority, category, count(*) AS n, CAST(grouping(priority, category) AS BIGINT) AS level
FROM rr GROUP BY ROLLUP (priority, category)"""
    return q
