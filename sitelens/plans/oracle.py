"""DuckDB twins of the registered queries (the correctness gate).

Written from the rule text and FIXTURES.md, independently of the Spark code:
fixture tables are rebuilt here as CTEs over the driver's pre-registered views.
Only string, bigint, double and boolean columns are returned.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"

# ---------------------------------------------------------------- fixtures
STATISTICS_CTE = """
stats AS (
  SELECT CAST(event_id AS BIGINT) AS id,
         'site' || CAST(user_id % 20 AS VARCHAR) || '.example.com' AS domain,
         CAST(floor(value * 10) AS INTEGER) AS duration_ms,
         event_type <> 'error' AS success,
         '' AS ip_address,
         CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS BIGINT) AS user_id,
         '' AS user_agent,
         ts AS created_at
  FROM events
)"""

USERS_CTE = """
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS user_login FROM customer WHERE c_custkey % 2 = 0
)"""

TS_FMT = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')"


def _period(period: str) -> str:
    if period == "today":
        return "CAST(created_at AS DATE) = DATE '2024-01-30'"
    days = {"week": 7, "month": 30, "year": 365}.get(period)
    if days:
        return f"created_at >= {AS_OF} - INTERVAL {days} DAY"
    return "TRUE"


def stats_sql() -> dict[str, str]:
    q = {}
    for period in ("today", "week", "month", "year", "all"):
        q[f"t1_period_{period}"] = f"""
WITH {STATISTICS_CTE}
SELECT id, domain, CAST(duration_ms AS BIGINT) AS duration_ms, success, user_id, {TS_FMT} AS created_at
FROM stats WHERE {_period(period)}"""
    for page in (1, 3):
        q[f"t2_listing_week_p{page}"] = f"""
WITH {STATISTICS_CTE}
SELECT id, domain, CAST(duration_ms AS BIGINT) AS duration_ms, success, ip_address, user_id, user_agent,
       {TS_FMT} AS created_at
FROM stats WHERE {_period('week')}
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET {(page - 1) * 50}"""
    q["t3_count_week"] = f"WITH {STATISTICS_CTE} SELECT count(*) AS total FROM stats WHERE {_period('week')}"
    q["t4_totals"] = f"""
WITH {STATISTICS_CTE}
SELECT count(*) AS "all",
       count(*) FILTER (WHERE {_period('today')}) AS today,
       count(*) FILTER (WHERE {_period('week')}) AS week,
       count(*) FILTER (WHERE {_period('month')}) AS month
FROM stats"""
    for period in ("week", "all"):
        q[f"t5_daily_{period}"] = f"""
WITH {STATISTICS_CTE}
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS count
FROM stats WHERE {_period(period)} GROUP BY CAST(created_at AS DATE)"""
    q["t6_top_domains"] = f"""
WITH {STATISTICS_CTE}
SELECT domain, count(*) AS count FROM stats GROUP BY domain ORDER BY count DESC, domain LIMIT 10"""
    q["t7_bundle_rows_week"] = q["t2_listing_week_p1"]
    q["t7_bundle_chart_week"] = q["t5_daily_week"]
    q["t10_dashboard"] = f"""
SELECT 'totals' AS part, label, count FROM (SELECT * FROM ({q["t4_totals"]})) UNPIVOT (count FOR label IN ("all", today, week, month))
UNION ALL SELECT 'top_domains', domain, count FROM ({q["t6_top_domains"]})
UNION ALL SELECT 'chart', date, count FROM ({q["t5_daily_week"]})"""
    q["t7_bundle_summary_month"] = f"""
WITH {STATISTICS_CTE}
SELECT count(*) FILTER (WHERE {_period('month')}) AS total,
       CAST(1 AS BIGINT) AS page, CAST(50 AS BIGINT) AS per_page,
       CAST(ceil(count(*) FILTER (WHERE {_period('month')}) / 50.0) AS BIGINT) AS total_pages,
       count(*) AS "all",
       count(*) FILTER (WHERE {_period('today')}) AS today,
       count(*) FILTER (WHERE {_period('week')}) AS week,
       count(*) FILTER (WHERE {_period('month')}) AS month
FROM stats"""
    q["t8_total_pages_year"] = f"""
WITH {STATISTICS_CTE}
SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM stats WHERE {_period('year')}"""
    q["t9_view_week_p1"] = f"""
WITH {STATISTICS_CTE}, {USERS_CTE},
page AS (
  SELECT * FROM stats WHERE {_period('week')} ORDER BY created_at DESC, id DESC LIMIT 50
)
SELECT p.id,
       strftime(p.created_at, '%Y-%m-%d') AS date,
       strftime(p.created_at, '%H:%M:%S') AS time,
       p.domain,
       format('{{:,}}', p.duration_ms) || ' ms' AS duration,
       CASE WHEN p.success THEN 'Success' ELSE 'Error' END AS status,
       CASE WHEN p.user_id > 0 AND u.user_login IS NOT NULL THEN u.user_login ELSE 'Guest' END AS "user",
       CASE WHEN length(p.user_agent) > 40 THEN substr(p.user_agent, 1, 40) || '…' ELSE p.user_agent END AS browser
FROM page p LEFT JOIN users u ON u.user_id = p.user_id"""
    return q


def oracle_sql() -> dict[str, str]:
    from sitelens.plans.oracle_audit import audit_sql, checks_sql, recs_sql, rollup_sql

    out = {}
    out.update(stats_sql())
    out.update(audit_sql())
    out.update(checks_sql())
    out.update(recs_sql())
    out.update(rollup_sql())
    from sitelens.plans.oracle_frontier import frontier_sql

    out.update(frontier_sql())
    from sitelens.plans.oracle_review import review_sql

    out.update(review_sql())
    from sitelens.plans.oracle_stream import stream_sql

    out.update(stream_sql())
    out["s4_t1_stored_week"], out["s4_t5_stored_daily_week"] = out["t1_period_week"], out["t5_daily_week"]
    d2, c8 = out["d2_resolve_redirects"], out["c8_page_scorecard"]
    out["p7_redirected_scorecard"] = f"""SELECT r.request_id, r.submitted_url, r.final_url, r.redirects,
  CAST(CASE WHEN s.page_id % 10 = 9 THEN 404 WHEN s.page_id % 10 = 8 THEN 204 ELSE 200 END AS BIGINT) AS status_code,
  s.overall, s.seo, s.security, s.performance, s.mobile, s.technical, s.accessibility
FROM ({d2}) r JOIN ({c8}) s ON s.url = r.final_url WHERE r.error IS NULL AND s.page_id % 23 <> 22"""
    out["p7_s6_outcomes"] = f"""SELECT r.request_id, r.submitted_url, CAST(coalesce(p.page_id * 37 % 2000, 0) AS BIGINT) AS duration_ms,
  r.error IS NULL AND p.page_id IS NOT NULL AND p.page_id % 23 <> 22 AS success,
  CASE WHEN r.error IS NOT NULL THEN r.error WHEN p.page_id IS NULL OR p.page_id % 23 = 22 THEN 'fetch failed' END AS error
FROM ({d2}) r LEFT JOIN pages p ON p.url = r.final_url"""
    return out
