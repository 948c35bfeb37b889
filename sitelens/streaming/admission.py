"""Request admission (W4): URL and rights checks, client address, rate limit, split, record.

One job takes submitted requests through the reference's gates in its order:

* an analysis is refused with 400 when its URL fails U11; a model review with 403
  when the user is no administrator;
* what passes is counted against the client's limit (``ip``, or ``ai-`` and ``ip``
  for reviews); beyond it the answer is 429;
* an admitted review is refused with 400 without an API key or a usable report.

Every request gets one row with its outcome (``accepted``, ``rejected``,
``limited``).  On a stream the rows of a micro-batch go to three sinks, one folder
each, and the accepted analyses are looked up in the captures and recorded in the
usage table; both under the batch's id, so a replayed batch replaces itself.

Defined cases: null flags are false, null texts empty; a request without a time is
limited (W1); an accepted URL without a capture is recorded as a failure of 0 ms.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.config import AI_MAX_PER_HOUR, MAX_ANALYSES_PER_HOUR, clamp_rate_limit
from sitelens.functions.text import php_empty
from sitelens.operators.frontier import client_ip, validate_frontier
from sitelens.operators.lookup import lookup_join, one_per_key
from sitelens.operators.review import valid_review_request
from sitelens.sources.statistics import outcomes_to_statistics
from sitelens.streaming.ratelimit import rate_limit, stream_rate_limit

ADDRESS_FIELDS = ["cf_ip", "real_ip", "xff", "remote_addr"]
# What the reference's answers distinguish.
FORBIDDEN, LIMITED, AI_LIMITED = "forbidden", "rate_limit", "ai_rate_limit"
NO_KEY, NO_DATA, BAD_DATA = "no_api_key", "no_data", "invalid_data"

CARRY = ["ts", "is_ai", "user_id", "client_ip", "url", "review_error"]
OUTCOME = (
    "request_id bigint, outcome string, status bigint, reason string, is_ai boolean, client_ip string, url string, "
    "count_in_window bigint, user_id bigint, ts timestamp"
)


@dataclass(frozen=True)
class Settings:
    """The options that admission reads, clamped as the reference stores them."""

    max_per_hour: int = MAX_ANALYSES_PER_HOUR
    ai_per_hour: int = AI_MAX_PER_HOUR
    has_api_key: bool = True

    @classmethod
    def of(cls, options: Mapping) -> Settings:
        per_hour = abs(int(options.get("max_analyses_per_hour", MAX_ANALYSES_PER_HOUR)))
        return cls(clamp_rate_limit(per_hour), AI_MAX_PER_HOUR, options.get("gemini_api_key", "") not in ("", "0"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def gates(requests: DataFrame, dns: DataFrame, settings: Settings) -> DataFrame:
    """What is known of a request before it is counted: ``gate_status`` and ``gate_reason``
    of a refusal (else null), the limit's key, and the refusal that would follow it."""
    checked = validate_frontier(requests, dns)
    ai = _flag("is_ai")
    review_error = (
        F.when(F.lit(not settings.has_api_key), F.lit(NO_KEY)).when(php_empty("payload"), F.lit(NO_DATA))
        .when(~F.coalesce(valid_review_request(F.col("payload")), F.lit(False)), F.lit(BAD_DATA))
    )
    ip = client_ip(ADDRESS_FIELDS)
    return checked.select(
        F.col("request_id").cast("bigint").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), ai.alias("is_ai"),
        F.col("user_id").cast("bigint").alias("user_id"), ip.alias("client_ip"), F.when(~ai, F.col("valid_url")).alias("url"),
        F.when(ai & ~_flag("is_admin"), 403).when(~ai & F.col("error_code").isNotNull(), 400).alias("gate_status"),
        F.when(ai & ~_flag("is_admin"), F.lit(FORBIDDEN)).when(~ai, F.col("error_code")).alias("gate_reason"),
        F.when(ai, review_error).alias("review_error"),
        F.when(ai, F.concat(F.lit("ai-"), ip)).otherwise(ip).alias("rl_key"),
        F.when(ai, settings.ai_per_hour).otherwise(settings.max_per_hour).alias("rl_limit"),
    )


def _refused(gated: DataFrame) -> DataFrame:
    return gated.filter("gate_status IS NOT NULL").select(
        "request_id", F.lit("rejected").alias("outcome"), F.col("gate_status").cast("bigint").alias("status"), F.col("gate_reason").alias("reason"),
        "is_ai", "client_ip", "url", F.lit(0).cast("bigint").alias("count_in_window"), "user_id", "ts",
    )


def _counted(limited: DataFrame) -> DataFrame:
    fails = F.col("review_error").isNotNull()
    # rows that a gate has refused may stand among them, uncounted
    refused, status, reason = F.lit(False), F.lit(None), F.lit(None)
    if "gate_status" in limited.columns:
        refused, status, reason = F.col("gate_status").isNotNull(), F.col("gate_status").cast("bigint"), F.col("gate_reason")
    return limited.select(
        F.col("id").alias("request_id"),
        F.when(refused, F.lit("rejected")).when(~F.col("accepted"), F.lit("limited")).when(fails, F.lit("rejected"))
        .otherwise(F.lit("accepted")).alias("outcome"),
        F.when(refused, status).when(~F.col("accepted"), 429).when(fails, 400).otherwise(200).cast("bigint").alias("status"),
        F.when(refused, reason).when(~F.col("accepted"), F.when(F.col("is_ai"), F.lit(AI_LIMITED)).otherwise(F.lit(LIMITED)))
        .otherwise(F.col("review_error")).alias("reason"),
        "is_ai", "client_ip", "url", "count_in_window", "user_id", "ts",
    )


def admit(requests: DataFrame, dns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """W4 batch: one row of ``OUTCOME`` a request.

    ``requests``: ``request_id, ts, raw_url, is_ai, is_admin, payload, user_id`` and the
    four address fields."""
    gated = gates(requests, dns, settings)
    passed = gated.filter("gate_status IS NULL")
    limited = rate_limit(passed, F.col("rl_key"), F.col("ts"), "request_id", F.col("rl_limit"), carry=CARRY)
    return _counted(limited).unionByName(_refused(gated))


def admit_stream(requests: DataFrame, dns: DataFrame, settings: Settings = Settings(), watermark: str = "2 hours") -> DataFrame:
    """W4 on a stream of requests; ``dns`` is a static table.

    Refused requests go with the uncounted ones, so the gates run for two branches, not
    three; they have no time to count at and so do not move the watermark."""
    gated = gates(requests, dns, settings).withColumns(
        {"gate_status": F.col("gate_status").cast("string"), "counted_at": F.when(F.col("gate_status").isNull(), F.col("ts"))}
    )
    limited = stream_rate_limit(
        gated, F.col("rl_key"), "counted_at", "request_id", F.col("rl_limit"), watermark=watermark, carry=[*CARRY, "gate_status", "gate_reason"]
    )
    return _counted(limited)


def usage_of(outcomes: DataFrame, captures: DataFrame) -> DataFrame:
    """Usage rows (S6) of the accepted analyses: success and duration of their captures
    (``url, duration_ms, error``)."""
    known = one_per_key(captures.select("url", "duration_ms", F.col("error").isNull().alias("success")), ["url"])
    done = outcomes.filter("outcome = 'accepted' AND NOT is_ai")
    looked = lookup_join(done, known, ["url"], ["request_id"])
    return outcomes_to_statistics(
        looked.select(
            "request_id", F.col("url").alias("submitted_url"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
            F.coalesce("success", F.lit(False)).alias("success"), "user_id", F.col("ts").alias("created_at"),
        )
    )


def admission_writer(out: str, usage: str, captures: DataFrame):
    """``foreachBatch`` function: outcomes to ``out`` (a folder an outcome), usage to ``usage``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        here = f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").partitionBy("outcome").parquet(here)
        # read back, so that the stateful plan runs once
        rows = batch.sparkSession.read.schema(OUTCOME).parquet(here)
        recorded = usage_of(rows, captures).withColumn("created_date", F.to_date("created_at"))
        recorded.write.mode("overwrite").partitionBy("created_date").parquet(f"{usage}/batch={batch_id}")

    return write


def run_admission(outcomes: DataFrame, out: str, usage: str, captures: DataFrame, checkpoint: str, available_now: bool = True):
    """Start the admission job on the streaming ``outcomes`` of ``admit_stream``."""
    w = outcomes.writeStream.outputMode("append").foreachBatch(admission_writer(out, usage, captures)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_outcomes(spark: SparkSession, out: str, outcome: str | None = None) -> DataFrame:
    """All outcomes written so far, or those of one sink (only its folders are read)."""
    rows = spark.read.schema(f"{OUTCOME}, batch bigint").option("basePath", out).parquet(out)
    return rows if outcome is None else rows.filter(F.col("outcome") == outcome)
