"""The usage table: schema, read, append, clear, drop.

Stored as Parquet partitioned by an explicit ``created_date`` column; period
filters add the matching ``created_date`` predicate so partitions are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.url import domain_of

STATISTICS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("domain", T.StringType(), False),
        T.StructField("duration_ms", T.IntegerType(), False),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("ip_address", T.StringType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_agent", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)


def with_defaults(df: DataFrame) -> DataFrame:
    """Apply the column defaults ('' / 0 / true) and the fixed column order."""
    defaults = {"domain": "", "duration_ms": 0, "success": True, "ip_address": "", "user_id": 0, "user_agent": ""}
    cols = []
    for f in STATISTICS_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c.cast(f.dataType), F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name == "created_at":
            c = F.coalesce(c.cast(f.dataType), F.current_timestamp())
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Typed read; the partition column ``created_date`` stays available for pruning."""
    schema = T.StructType(STATISTICS_SCHEMA.fields + [T.StructField("created_date", T.DateType(), True)])
    return spark.read.schema(schema).parquet(path)


def outcomes_to_statistics(results: DataFrame) -> DataFrame:
    """One usage row per analysis outcome (success and failure alike).

    ``results`` has ``request_id, submitted_url, duration_ms, success, user_id``
    and optionally ``created_at``; rejected URLs and rate-limited calls must be
    filtered out before (they are not recorded).  The domain is the host of the
    submitted URL, else the URL.
    """
    created = F.col("created_at") if "created_at" in results.columns else F.current_timestamp()
    return results.select(
        F.col("request_id").cast("bigint").alias("id"),
        domain_of("submitted_url").alias("domain"),
        F.abs(F.round(F.col("duration_ms")).cast("int")).alias("duration_ms"),
        F.coalesce(F.col("success"), F.lit(True)).alias("success"),
        F.lit("").alias("ip_address"),
        F.abs(F.coalesce(F.col("user_id").cast("bigint"), F.lit(0))).alias("user_id"),
        F.lit("").alias("user_agent"),
        created.alias("created_at"),
    )


def append_statistics(rows: DataFrame, path: str) -> None:
    """Append rows (defaults applied, ip and agent blanked) to the table."""
    out = with_defaults(rows).withColumn("ip_address", F.lit("")).withColumn("user_agent", F.lit(""))
    out = out.withColumn("created_date", F.to_date("created_at"))
    out.write.mode("append").partitionBy("created_date").parquet(path)


def clear_statistics(spark: SparkSession, path: str) -> None:
    """Empty the table, keep its schema."""
    empty = spark.createDataFrame([], STATISTICS_SCHEMA).withColumn("created_date", F.to_date("created_at"))
    empty.write.mode("overwrite").partitionBy("created_date").parquet(path)


def drop_statistics(spark: SparkSession, path: str) -> None:
    """Remove the table if it exists (Hadoop FileSystem, works on any shared store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)
