"""Capture tables: crawl, robots, sitemaps, LLM responses.

The reference fetches over HTTP with response-size limits.  A table has its bodies
already, so they are read whole; a caller that wants a limit passes ``body_cap``
or ``cap`` (bytes, cut between characters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import truncate_bytes


def normalize_crawl(crawl: DataFrame, body_cap: int | None = None) -> DataFrame:
    """S1 semantics on a DataFrame: null bodies empty, header names lower-cased."""
    body = F.coalesce(F.col("body"), F.lit(""))
    out = crawl.withColumn("body", body if body_cap is None else truncate_bytes(body, body_cap))
    if "headers" in crawl.columns:
        # of names that differ in case the last value wins, whatever the session's map policy
        names = F.map_keys("headers")
        lower = F.array_distinct(F.transform(names, F.lower))
        pairs = F.map_entries("headers")
        last = F.transform(lower, lambda k: F.element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == k), -1)["value"])
        out = out.withColumn("headers", F.map_from_arrays(lower, last))
    return out


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """``url, status, headers, body, error, fetched_at, ...`` from Parquet."""
    return normalize_crawl(spark.read.parquet(path))


def normalize_robots(robots: DataFrame, cap: int | None = None) -> DataFrame:
    """Null contents empty."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return robots.withColumn("content", content if cap is None else truncate_bytes(content, cap))


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return normalize_robots(spark.read.parquet(path))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``sitemap_url, status``."""
    return spark.read.parquet(path).select("sitemap_url", F.col("status").cast("int"))


def read_ai_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``url, status, body, error`` (Parquet or JSON lines)."""
    return spark.read.format(fmt).load(path).select("url", F.col("status").cast("int"), "body", "error")
