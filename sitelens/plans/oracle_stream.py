"""DuckDB twins of the rate limiter (recursive SQL) and the streaming sinks."""

from __future__ import annotations

from sitelens.plans.oracle import STATISTICS_CTE, TS_FMT
from sitelens.plans.oracle_frontier import empty, is_ip
from sitelens.plans.oracle_audit import php_trim

WIN = 3600 * 1000000


def limiter(source_cte: str, refresh: bool) -> str:
    """Events ``(id, k, t, lim)`` processed one by one per key, in (t, id) order."""
    new_exp = f"CASE WHEN e.t >= r.expiry OR r.cnt = 0 THEN e.t + {WIN} " + (
        f"WHEN r.cnt < e.lim THEN e.t + {WIN} " if refresh else "") + "ELSE r.expiry END"
    return f"""WITH RECURSIVE {source_cte},
ev AS (SELECT id, k, t, lim, row_number() OVER (PARTITION BY k ORDER BY t, id) AS rn FROM src),
r AS (
  SELECT id, k, rn, t + {WIN} AS expiry, CAST(1 AS BIGINT) AS cnt, true AS accepted FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.id, e.k, e.rn,
    CASE WHEN e.t >= r.expiry THEN e.t + {WIN} WHEN r.cnt < e.lim THEN {"e.t + " + str(WIN) if refresh else "r.expiry"} ELSE r.expiry END,
    CASE WHEN e.t >= r.expiry THEN 1 WHEN r.cnt < e.lim THEN r.cnt + 1 ELSE r.cnt END,
    e.t >= r.expiry OR r.cnt < e.lim
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1
)
SELECT id AS request_id, k AS key, accepted, cnt AS count_in_window FROM r"""


REQ_CTE = """
src AS (SELECT event_id AS id, event_type AS k, epoch_us(ts) AS t, 2 AS lim FROM events)"""


def admission_cte() -> str:
    def cand(c):
        v = f"(CASE WHEN contains({c}, ',') THEN {php_trim(f'split_part({c}, chr(44), 1)')} ELSE {c} END)"
        return f"CASE WHEN NOT {empty(c)} AND {is_ip(v)} THEN {v} END"

    return f"""
req AS (
  SELECT event_id, ts, event_type = 'signup' AS is_ai,
    CASE user_id % 4 WHEN 0 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) WHEN 1 THEN 'bad' ELSE '' END AS cf_ip,
    CASE WHEN user_id % 4 = 1 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) ELSE '' END AS real_ip,
    CASE WHEN user_id % 4 = 2 THEN '198.51.100.7, 10.0.0.1' ELSE '' END AS xff,
    '192.0.2.' || CAST(user_id % 250 AS VARCHAR) AS remote_addr
  FROM events
),
req2 AS (SELECT *, coalesce({cand('cf_ip')}, {cand('real_ip')}, {cand('xff')}, {cand('remote_addr')}, '0.0.0.0') AS ip FROM req),
src AS (
  SELECT event_id AS id, CASE WHEN is_ai THEN 'ai-' || ip ELSE ip END AS k, epoch_us(ts) AS t,
         CASE WHEN is_ai THEN 5 ELSE 10 END AS lim FROM req2
)"""


def admission_sql(tail: str) -> str:
    """The gates in the reference's order; the limiter runs over what passes the first ones."""
    from sitelens.plans.oracle_frontier import LITERALS, norm_host, norm_url, public_ip, verr
    from sitelens.plans.oracle_audit import lit

    def cand(c):
        v = f"(CASE WHEN contains({c}, ',') THEN {php_trim(f'split_part({c}, chr(44), 1)')} ELSE {c} END)"
        return f"CASE WHEN NOT {empty(c)} AND {is_ip(v)} THEN {v} END"

    ctes = f"""
req AS (
  SELECT event_id AS request_id, epoch_us(ts) - epoch_us(ts) % 86400000000 + epoch_us(ts) % 7200000000 AS t,
    CASE WHEN event_id % 6 = 0 THEN [{", ".join(lit(u) for u in LITERALS)}][(event_id // 6) % {len(LITERALS)} + 1]
         ELSE 'https://site' || CAST(user_id % 20 AS VARCHAR) || '.example.com/p/' || CAST(event_id % 100 AS VARCHAR) END AS raw_url,
    CASE WHEN user_id % 3 = 0 THEN '203.0.113.7' WHEN user_id % 4 = 1 THEN 'bad' ELSE '' END AS cf_ip,
    CASE WHEN user_id % 4 = 1 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) ELSE '' END AS real_ip,
    CASE WHEN user_id % 4 = 2 THEN '198.51.100.7, 10.0.0.1' ELSE '' END AS xff,
    '192.0.2.' || CAST(user_id % 250 AS VARCHAR) AS remote_addr,
    event_type = 'signup' AS is_ai, user_id % 7 <> 0 AS is_admin, user_id
  FROM events
),
addressed AS (
  SELECT *, coalesce({cand('cf_ip')}, {cand('real_ip')}, {cand('xff')}, {cand('remote_addr')}, '0.0.0.0') AS client_ip,
         {norm_url('raw_url')} AS nurl FROM req
),
hosted AS (SELECT *, {norm_host('nurl')} AS h FROM addressed),
hosts AS (SELECT DISTINCT h AS host FROM hosted WHERE h <> '' AND NOT regexp_matches(h, '^[0-9.]+$')),
dns AS (
  SELECT host, '10.0.0.5' AS ip FROM hosts WHERE length(host) % 6 IN (1, 2)
  UNION ALL SELECT host, '8.8.8.8' FROM hosts WHERE length(host) % 6 = 2
  UNION ALL SELECT host, '93.184.216.34' FROM hosts WHERE length(host) % 6 >= 3
),
dns_facts AS (SELECT host, bool_and({public_ip('ip')}) AS all_public FROM dns GROUP BY 1),
gated AS (
  SELECT a.*, {verr('a.nurl', 'a.raw_url', 'a.h')} AS code FROM hosted a LEFT JOIN dns_facts d ON d.host = a.h
),
src AS (
  SELECT request_id AS id, CASE WHEN is_ai THEN 'ai-' || client_ip ELSE client_ip END AS k, t, CASE WHEN is_ai THEN 5 ELSE 10 END AS lim
  FROM gated WHERE CASE WHEN is_ai THEN is_admin ELSE code IS NULL END
)"""
    rows = limiter(ctes.strip(), False).replace("WITH RECURSIVE", "", 1)
    i = rows.rindex("SELECT id AS request_id")
    bad = "CASE g.request_id % 6 WHEN 1 THEN 'no_data' WHEN 2 THEN 'no_data' WHEN 3 THEN 'invalid_data' WHEN 4 THEN 'invalid_data' END"
    return f"""WITH RECURSIVE {rows[:i]}, verdicts AS ({rows[i:]}),
outcomes AS (
  SELECT g.request_id, g.t, g.user_id, g.is_ai, g.client_ip, CASE WHEN NOT g.is_ai AND g.code IS NULL THEN g.nurl END AS url,
    CASE WHEN v.request_id IS NULL THEN 'rejected' WHEN NOT v.accepted THEN 'limited' WHEN g.is_ai AND {bad} IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
    CAST(CASE WHEN v.request_id IS NULL THEN (CASE WHEN g.is_ai THEN 403 ELSE 400 END) WHEN NOT v.accepted THEN 429
         WHEN g.is_ai AND {bad} IS NOT NULL THEN 400 ELSE 200 END AS BIGINT) AS status,
    CASE WHEN v.request_id IS NULL THEN (CASE WHEN g.is_ai THEN 'forbidden' ELSE g.code END)
         WHEN NOT v.accepted THEN (CASE WHEN g.is_ai THEN 'ai_rate_limit' ELSE 'rate_limit' END) WHEN g.is_ai THEN {bad} END AS reason,
    CAST(coalesce(v.count_in_window, 0) AS BIGINT) AS count_in_window
  FROM gated g LEFT JOIN verdicts v USING (request_id)
)
{tail}"""


OUTCOMES = """
outcomes AS (
  SELECT page_id AS request_id, url AS submitted_url, CAST((page_id * 37) % 2000 AS INTEGER) AS duration_ms,
         page_id % 23 <> 22 AS success,  -- only a failed fetch fails; an HTTP error is a finding
         CAST(page_id % 5 AS BIGINT) AS user_id, TIMESTAMP '2024-01-30 12:00:00' AS created_at
  FROM pages
)"""


def stream_sql() -> dict[str, str]:
    from sitelens.plans.oracle_audit import host

    q = {
        "w1_rate_limit_batch": limiter(REQ_CTE.strip(), False),
        "w2_rate_limit_refresh": limiter(REQ_CTE.strip(), True),
        "w3_w4_admission": limiter(admission_cte().strip(), False),
        "w1_rate_limit_stream": limiter(REQ_CTE.strip(), False),
    }
    q["w4_admission"] = admission_sql("SELECT request_id, outcome, status, reason, is_ai, client_ip, url, count_in_window FROM outcomes")
    q["w4_admission_stream"] = q["w4_admission"]
    q["w4_s6_recorded_usage"] = admission_sql(f"""SELECT request_id AS id, CASE WHEN {host('url')} <> '' THEN {host('url')} ELSE url END AS domain,
  CAST(CASE WHEN NOT starts_with(url, 'https://site') OR length(url) % 7 = 0 THEN 0 ELSE length(url) * 37 % 2000 END AS BIGINT) AS duration_ms,
  starts_with(url, 'https://site') AND length(url) % 7 <> 0 AND length(url) % 5 <> 0 AS success, '' AS ip_address, abs(user_id) AS user_id, '' AS user_agent,
  strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM outcomes WHERE outcome = 'accepted' AND NOT is_ai""")
    s6 = f"""WITH {OUTCOMES}
SELECT CAST(request_id AS BIGINT) AS id, CASE WHEN {host('submitted_url')} <> '' THEN {host('submitted_url')} ELSE submitted_url END AS domain,
       CAST(abs(duration_ms) AS BIGINT) AS duration_ms, coalesce(success, true) AS success, '' AS ip_address, abs(user_id) AS user_id,
       '' AS user_agent, {TS_FMT} AS created_at
FROM outcomes"""
    q["s6_outcomes_to_statistics"] = s6
    q["w5_stream_record"] = s6
    q["s4_s5_statistics_table"] = f"""SELECT * FROM ({s6})
UNION ALL BY NAME
SELECT * FROM (WITH {STATISTICS_CTE}
SELECT id, domain, CAST(duration_ms AS BIGINT) AS duration_ms, success, '' AS ip_address, CAST(user_id AS BIGINT) AS user_id,
       '' AS user_agent, {TS_FMT} AS created_at FROM stats)"""
    q["w6_stream_daily_counts"] = f"""WITH {STATISTICS_CTE}
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS count FROM stats GROUP BY CAST(created_at AS DATE)"""
    return q
