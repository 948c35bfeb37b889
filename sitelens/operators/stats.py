"""Usage statistics: period filter, listing, counts, daily chart, top domains.

One scan of the usage table serves every figure: conditional counts replace the
reference's repeated COUNT(*) statements, and date predicates are sargable so
they reach the Parquet scan (and, on a ``created_date``-partitioned table, the
partition filter).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import STATS_PER_PAGE, TOP_DOMAINS

# Rolling period lengths in days; any other period means "all".
PERIOD_DAYS = {"week": 7, "month": 30, "year": 365}


def period_predicate(period: str, as_of: datetime, ts: str = "created_at", date_col: str | None = None) -> Column:
    """Row predicate of a period; ``as_of`` replaces NOW()/CURDATE() (UTC)."""
    c = F.col(ts)
    if period == "today":
        day = as_of.date()
        pred = (c >= F.lit(datetime(day.year, day.month, day.day))) & (
            c < F.lit(datetime(day.year, day.month, day.day) + timedelta(days=1))
        )
        if date_col:
            pred = pred & (F.col(date_col) == F.lit(day))
        return pred
    if period in PERIOD_DAYS:
        start = as_of - timedelta(days=PERIOD_DAYS[period])
        pred = c >= F.lit(start)
        if date_col:  # lets Spark prune partitions; it does not derive this itself
            pred = pred & (F.col(date_col) >= F.lit(start.date()))
        return pred
    return F.lit(True)


def filter_period(stats: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """T1."""
    date_col = "created_date" if "created_date" in stats.columns else None
    return stats.where(period_predicate(period, as_of, date_col=date_col))


def listing_page(stats: DataFrame, period: str, as_of: datetime, page: int = 1, per_page: int = STATS_PER_PAGE) -> DataFrame:
    """Newest first, ``per_page`` rows of page ``page`` (pages < 1 clamp to 1).

    ORDER BY + OFFSET/LIMIT plans as a TakeOrderedAndProject: each task keeps
    its own top (offset+limit) rows, so only a bounded set reaches the driver.
    """
    page = max(1, int(page))
    cols = ["id", "domain", "duration_ms", "success", "ip_address", "user_id", "user_agent", "created_at"]
    return (
        filter_period(stats, period, as_of)
        .select(*cols)
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .offset((page - 1) * per_page)
        .limit(per_page)
    )


def listing_after(
    stats: DataFrame, period: str, as_of: datetime, after: tuple[datetime, int] | None, per_page: int = STATS_PER_PAGE
) -> DataFrame:
    """T2 by key: the ``per_page`` rows that follow ``after = (created_at, id)``.

    Costs the same on any page: every task keeps its own ``per_page`` rows, whereas
    an offset keeps all rows before the page as well."""
    cols = ["id", "domain", "duration_ms", "success", "ip_address", "user_id", "user_agent", "created_at"]
    rows = filter_period(stats, period, as_of).select(*cols)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(int(after[1]))
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last)))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(per_page)


def filtered_count(stats: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """T3."""
    return filter_period(stats, period, as_of).agg(F.count(F.lit(1)).alias("total"))


def totals(stats: DataFrame, as_of: datetime) -> DataFrame:
    """T4: all / today / week / month in one pass."""
    return stats.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(period_predicate("today", as_of)).alias("today"),
        F.count_if(period_predicate("week", as_of)).alias("week"),
        F.count_if(period_predicate("month", as_of)).alias("month"),
    )


def daily_counts(stats: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """T5: one row per date with rows, ascending; empty days absent."""
    return (
        filter_period(stats, period, as_of)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("date")
    )


def top_domains(stats: DataFrame, n: int = TOP_DOMAINS) -> DataFrame:
    """Most analysed domains (period ignored); ties broken by domain."""
    return (
        stats.groupBy("domain")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("domain"))
        .limit(n)
    )


def total_pages(total: Column, per_page: int = STATS_PER_PAGE) -> Column:
    """T8."""
    return F.ceil(total / F.lit(float(per_page))).cast("bigint")


def bundle_summary(stats: DataFrame, period: str, as_of: datetime, page: int = 1, per_page: int = STATS_PER_PAGE) -> DataFrame:
    """Scalar part of T7 in one scan: filtered total, pages and the totals."""
    total = F.count_if(period_predicate(period, as_of))
    return stats.agg(
        total.alias("total"),
        F.lit(max(1, int(page))).cast("bigint").alias("page"),
        F.lit(per_page).cast("bigint").alias("per_page"),
        total_pages(total, per_page).alias("total_pages"),
        F.count(F.lit(1)).alias("all"),
        F.count_if(period_predicate("today", as_of)).alias("today"),
        F.count_if(period_predicate("week", as_of)).alias("week"),
        F.count_if(period_predicate("month", as_of)).alias("month"),
    )


def statistics_bundle(stats: DataFrame, period: str, as_of: datetime, page: int = 1) -> dict[str, DataFrame]:
    """The reference's statistics response as lazy DataFrames."""
    return {
        "rows": listing_page(stats, period, as_of, page),
        "summary": bundle_summary(stats, period, as_of, page),
        "totals": totals(stats, as_of),
        "chart": daily_counts(stats, period, as_of),
        "top_domains": top_domains(stats, TOP_DOMAINS),
    }


def dashboard(stats: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """Totals, top 10 domains and the week chart."""
    return {
        "totals": totals(stats, as_of),
        "top_domains": top_domains(stats, TOP_DOMAINS),
        "chart": daily_counts(stats, "week", as_of),
    }


def excerpt(c: Column, n: int = 40, more: str = "…") -> Column:
    """``wp_html_excerpt``: tags stripped, cut at ``n`` characters, marker when cut."""
    t = F.regexp_replace(c, r"<[^>]*>", "")
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(more))).otherwise(t)


def statistics_view(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Display columns of listing rows.

    ``rows`` is a listing page (at most ``per_page`` rows, a proven bound).  It is
    the broadcast side of an inner join that picks the page's users, so the users
    table is only scanned, never shuffled; the page then meets those few rows.
    """
    u = users.select(F.col("user_id").alias("u_id"), "user_login")
    wanted = rows.where(F.col("user_id") > 0).select(F.col("user_id").alias("w_id")).distinct()
    some = u.join(F.broadcast(wanted), F.col("u_id") == F.col("w_id"), "inner").groupBy("u_id").agg(F.min("user_login").alias("user_login"))
    joined = rows.join(F.broadcast(some), F.col("u_id") == F.col("user_id"), "left")
    return joined.select(
        "id",
        F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        F.date_format("created_at", "HH:mm:ss").alias("time"),
        "domain",
        F.concat(F.format_number(F.col("duration_ms").cast("long"), 0), F.lit(" ms")).alias("duration"),
        F.when(F.col("success"), F.lit("Success")).otherwise(F.lit("Error")).alias("status"),
        F.coalesce(F.col("user_login"), F.lit("Guest")).alias("user"),
        excerpt(F.coalesce(F.col("user_agent"), F.lit(""))).alias("browser"),
    )
