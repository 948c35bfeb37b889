"""DuckDB twins of frontier validation, client IP and redirect resolution."""

from __future__ import annotations

from sitelens.plans.oracle_audit import URL_RE, host, lit, php_trim, scheme

LITERALS = [
    "", "   ", "example.com", "HTTP://Example.com/x", "https://a.example.com:443/", "http://8.8.8.8", "http://172.32.0.1",
    "https://u:p@a.example.com", "https://a.example.com:8080", "http://localhost", "http://x.local", "http://y.internal.",
    "http://127.0.0.1", "http://10.0.0.1", "http://172.16.0.1", "http://192.168.1.1", "http://169.254.1.1", "http://0.0.0.1",
    "http://240.0.0.1", "https://", "https:///x", "ftp://a.example.com", "https://exa mple.com", "http://a_b.example.com/",
]
OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = lit(rf"^{OCT}\.{OCT}\.{OCT}\.{OCT}$")
AUTH_OK = lit(r"^(?:[^@/?#\s]*@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._~%!$&'()*+,;=\-]+)(?::[0-9]+)?$")


def is_v4(x):
    return f"regexp_matches({x}, {IPV4})"


def is_v6(x):
    return f"(regexp_matches({x}, '^[0-9A-Fa-f:.]+$') AND contains({x}, ':') AND len(string_split({x}, '::')) <= 2)"


def is_ip(x):
    return f"({is_v4(x)} OR {is_v6(x)})"


def public_v4(x):
    a, b = f"TRY_CAST(split_part({x}, '.', 1) AS INTEGER)", f"TRY_CAST(split_part({x}, '.', 2) AS INTEGER)"
    priv = (f"({a} = 0 OR {a} = 10 OR {a} = 127 OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) "
            f"OR ({a} = 192 AND {b} = 168) OR {a} >= 240)")
    return f"({is_v4(x)} AND NOT {priv})"


def public_v6(x):
    lx = f"lower({x})"
    priv = (f"({lx} IN ('::', '::1') OR regexp_matches({lx}, '^f[cd][0-9a-f]{{0,2}}:') OR regexp_matches({lx}, '^fe[89ab][0-9a-f]?:') "
            f"OR starts_with({lx}, '::ffff:') OR starts_with({lx}, '2001:db8:'))")
    return f"({is_v6(lx)} AND NOT {priv})"


def public_ip(x):
    return f"({public_v4(x)} OR {public_v6(x)})"


def empty(x):
    return f"({x} IS NULL OR {x} = '' OR {x} = '0')"


def norm_url(raw):
    t = php_trim(f"coalesce({raw}, '')")
    return f"(CASE WHEN regexp_matches({t}, '(?i)^https?://') THEN {t} ELSE 'https://' || {t} END)"


def norm_host(url):
    return f"lower(rtrim({host(url)}, '.'))"


def syntax_err(url, raw):
    t = php_trim(f"coalesce({raw}, '')")
    auth = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    port = f"regexp_extract({url}, {URL_RE}, 4)"
    h = norm_host(url)
    blocked = (f"({h} IN ('localhost', 'localhost.localdomain') OR suffix({h}, '.local') OR suffix({h}, '.localhost') "
               f"OR suffix({h}, '.internal') OR ({is_ip(h)} AND NOT {public_ip(h)}))")
    return f"""(CASE WHEN {t} = '' THEN 'wa_empty_url'
  WHEN regexp_matches({url}, '\\s') OR NOT regexp_matches({auth}, {AUTH_OK}) OR {scheme(url)} = '' OR {host(url)} = '' THEN 'wa_invalid_url'
  WHEN lower({scheme(url)}) NOT IN ('http', 'https') THEN 'wa_invalid_scheme'
  WHEN NOT {empty(f"regexp_extract({url}, {URL_RE}, 2)")} THEN 'wa_credentials_url'
  WHEN NOT {empty(port)} AND NOT coalesce(TRY_CAST({port} AS INTEGER) IN (80, 443), false) THEN 'wa_blocked_port'
  WHEN {blocked} THEN 'wa_blocked_host' END)"""


FRONTIER_CTE = f"""
frontier AS (
  SELECT page_id AS request_id, url AS raw_url FROM pages
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({1000000 + i}, {lit(u)})" for i, u in enumerate(LITERALS))}) v(request_id, raw_url)
),
fn AS (SELECT request_id, raw_url, {norm_url('raw_url')} AS url FROM frontier),
dns_hosts AS (
  SELECT DISTINCT {norm_host('url')} AS host FROM fn
  WHERE {norm_host('url')} <> '' AND NOT regexp_matches({norm_host('url')}, '^[0-9.]+$')
),
dns AS (
  SELECT host, '10.0.0.5' AS ip FROM dns_hosts WHERE length(host) % 6 = 1
  UNION ALL SELECT host, '8.8.8.8' FROM dns_hosts WHERE length(host) % 6 = 2
  UNION ALL SELECT host, '10.0.0.5' FROM dns_hosts WHERE length(host) % 6 = 2
  UNION ALL SELECT host, '93.184.216.34' FROM dns_hosts WHERE length(host) % 6 >= 3
),
dns_facts AS (
  SELECT lower(rtrim(host, '.')) AS host, bool_and({public_ip('ip')}) AS all_public FROM dns WHERE trim(ip) <> '' GROUP BY 1
)"""


def verr(url_col, raw_col, host_col="h"):
    return f"""coalesce({syntax_err(url_col, raw_col)},
      CASE WHEN NOT {is_ip(host_col)} AND d.host IS NULL THEN 'wa_dns_failed' END,
      CASE WHEN {is_ip(host_col)} AND NOT {public_ip(host_col)} THEN 'wa_private_target' END,
      CASE WHEN NOT {is_ip(host_col)} AND NOT coalesce(d.all_public, true) THEN 'wa_private_target' END)"""


def frontier_sql() -> dict[str, str]:
    q = {}
    validated = f"""WITH {FRONTIER_CTE},
fh AS (SELECT *, {norm_host('url')} AS h FROM fn),
v AS (SELECT fh.request_id, fh.raw_url, fh.url, fh.h AS host, {verr('fh.url', 'fh.raw_url')} AS error_code
      FROM fh LEFT JOIN dns_facts d ON d.host = fh.h)"""
    q["u11_validate_frontier"] = f"""{validated}
SELECT request_id, raw_url, url, host, error_code, CASE WHEN error_code IS NULL THEN url END AS valid_url FROM v"""
    q["u12_domain"] = f"""{validated}
SELECT request_id, CASE WHEN {host('url')} <> '' THEN {host('url')} ELSE url END AS domain FROM v WHERE error_code IS NULL"""
    reqs = """
req AS (
  SELECT event_id AS request_id,
    CASE user_id % 4 WHEN 0 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) WHEN 1 THEN 'bad' ELSE '' END AS cf_ip,
    CASE WHEN user_id % 4 = 1 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) ELSE '' END AS real_ip,
    CASE WHEN user_id % 4 = 2 THEN '198.51.100.7, 10.0.0.1' ELSE '' END AS xff,
    '192.0.2.' || CAST(user_id % 250 AS VARCHAR) AS remote_addr
  FROM events
)"""

    def cand(c):
        v = f"(CASE WHEN contains({c}, ',') THEN {php_trim(f'split_part({c}, chr(44), 1)')} ELSE {c} END)"
        return f"CASE WHEN NOT {empty(c)} AND {is_ip(v)} THEN {v} END"

    q["u13_client_ip"] = f"""WITH {reqs}
SELECT request_id, coalesce({cand('cf_ip')}, {cand('real_ip')}, {cand('xff')}, {cand('remote_addr')}, '0.0.0.0') AS client_ip FROM req"""
    q["d1_redirect_target"] = f"""WITH {REDIRECTS_CTE}
SELECT url, location, {target('url', 'location')} AS target FROM redirects"""
    q["d2_resolve_redirects"] = d2_sql()
    return q


REDIRECTS_CTE = f"""
rp AS (
  SELECT page_id AS p, url AS u, {scheme('url')} AS sch, {host('url')} AS hst,
         {scheme('url')} || '://' || {host('url')} AS base,
         CASE WHEN page_id % 8 = 0 AND page_id % 17 = 0 THEN 1 ELSE page_id % 8 END AS h
  FROM pages
),
rk AS (SELECT rp.*, k FROM rp, range(0, 8) t(k) WHERE k < h),
redirects AS (
  SELECT base || '/r/' || CAST(p AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS url,
         CASE k % 3 WHEN 0 THEN 301 WHEN 1 THEN 302 ELSE 308 END AS status,
         CASE WHEN p % 17 = 0 AND k = 0 THEN ''
              WHEN k = h - 1 THEN (CASE (p + k) % 4 WHEN 1 THEN '//' || substr(u, length(sch) + 4)
                                                    WHEN 2 THEN substr(u, length(base) + 1) ELSE u END)
              ELSE (CASE (p + k) % 4 WHEN 0 THEN base || '/r/' || CAST(p AS VARCHAR) || '/' || CAST(k + 1 AS VARCHAR)
                                     WHEN 1 THEN '//' || hst || '/r/' || CAST(p AS VARCHAR) || '/' || CAST(k + 1 AS VARCHAR)
                                     WHEN 2 THEN '/r/' || CAST(p AS VARCHAR) || '/' || CAST(k + 1 AS VARCHAR)
                                     ELSE CAST(k + 1 AS VARCHAR) END) END AS location
  FROM rk
)"""


def target(base, loc):
    lt = php_trim(loc)
    sch = f"(CASE WHEN {scheme(base)} = '' THEN 'https' ELSE {scheme(base)} END)"
    path = f"regexp_extract({base}, {URL_RE}, 5)"
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    directory = f"regexp_replace({path}, '/[^/]*$', '/')"
    return f"""(CASE WHEN regexp_matches({lt}, '(?i)^https?://') THEN {lt}
  WHEN starts_with({lt}, '//') THEN {sch} || ':' || {lt}
  WHEN starts_with({lt}, '/') THEN {sch} || '://' || {host(base)} || {lt}
  ELSE {sch} || '://' || {host(base)} || {directory} || {lt} END)"""


def d2_sql() -> str:
    ctes = [FRONTIER_CTE.strip(), REDIRECTS_CTE.strip(), f"""
s0 AS (
  SELECT page_id AS request_id,
         CASE WHEN page_id % 8 > 0 OR page_id % 17 = 0
              THEN {scheme('url')} || '://' || {host('url')} || '/r/' || CAST(page_id AS VARCHAR) || '/0' ELSE url END AS submitted_url
  FROM pages
),
r0 AS (SELECT request_id, submitted_url, submitted_url AS cur, CAST(NULL AS VARCHAR) AS final_url,
              CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS redirects FROM s0)"""]
    for i in range(6):
        last = "true" if i == 5 else "false"
        ctes.append(f"""
a{i} AS (
  SELECT r.*, {norm_url('r.cur')} AS vurl0, final_url IS NULL AND error IS NULL AS active FROM r{i} r
),
b{i} AS (
  SELECT a.*, {norm_host('a.vurl0')} AS h FROM a{i} a
),
c{i} AS (
  SELECT b.*, CASE WHEN b.active THEN {verr('b.vurl0', 'b.cur')} END AS verr_
  FROM b{i} b LEFT JOIN dns_facts d ON d.host = b.h
),
e{i} AS (
  SELECT c.*, x.status AS hs, x.location AS hl
  FROM c{i} c LEFT JOIN (SELECT * FROM redirects WHERE status BETWEEN 300 AND 399) x
    ON c.active AND c.verr_ IS NULL AND x.url = c.vurl0
),
r{i + 1} AS (
  SELECT request_id, submitted_url,
    CASE WHEN active AND verr_ IS NULL AND hs IS NOT NULL AND coalesce(hl, '') NOT IN ('', '0') THEN {target('vurl0', 'hl')} ELSE cur END AS cur,
    CASE WHEN NOT active THEN final_url WHEN verr_ IS NULL AND hs IS NULL THEN vurl0 END AS final_url,
    CASE WHEN NOT active THEN error WHEN verr_ IS NOT NULL THEN verr_
         WHEN hs IS NOT NULL AND (coalesce(hl, '') IN ('', '0') OR {last}) THEN 'Too many redirects.' END AS error,
    redirects + CASE WHEN active AND verr_ IS NULL AND hs IS NOT NULL AND coalesce(hl, '') NOT IN ('', '0') THEN 1 ELSE 0 END AS redirects
  FROM e{i}
)""")
    return "WITH " + ",".join(ctes) + "\nSELECT request_id, submitted_url, final_url, error, CAST(redirects AS BIGINT) AS redirects FROM r6"
