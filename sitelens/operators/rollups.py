"""Corpus roll-ups over per-page outputs (G1-G3): plain group-bys with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.url import url_host


def check_pass_rates(checks: DataFrame) -> DataFrame:
    """G1: share of pages passing each check (rows with a pass/fail style status)."""
    c = checks.where(F.col("status").isNotNull())
    return c.groupBy("tab", "ord", "label").agg(
        F.count(F.lit(1)).alias("pages"),
        F.avg(F.col("status").isin("pass", "good").cast("double")).alias("pass_rate"),
    )


def host_scorecard(scored: DataFrame) -> DataFrame:
    """Per-host score summary (a hot host is pre-aggregated map-side)."""
    return scored.groupBy(url_host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.avg("scores.overall").alias("avg_overall"),
        F.min("scores.overall").cast("bigint").alias("min_overall"),
        F.max("scores.overall").cast("bigint").alias("max_overall"),
    )


def recommendation_rollup(recs: DataFrame) -> DataFrame:
    """Recommendation counts by priority and category with subtotals (ROLLUP)."""
    return recs.rollup("priority", "category").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")
    )
