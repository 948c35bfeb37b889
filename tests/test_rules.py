"""Boundary and property tests on small literal inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelens.operators import frontier as fr
from sitelens.operators.checks import format_ms
from sitelens.operators.http import performance
from sitelens.operators.scores import band, performance_score
from sitelens.streaming import ratelimit as rl


def test_format_ms(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 999, 1000, 1500, 1501, 1651, 10000)], "ms long")
    got = dict(rows.select("ms", format_ms(F.col("ms")).alias("s")).collect())
    assert got == {0: "0ms", 999: "999ms", 1000: "1.00s", 1500: "1.50s", 1501: "1.50s", 1651: "1.65s", 10000: "10.00s"}


@pytest.mark.parametrize(
    "load,score",
    [(None, 100), (0, 100), (800, 100), (801, 90), (1500, 90), (1501, 75), (3000, 75), (3001, 60), (5000, 60), (5001, 40),
     (10000, 40), (10001, 20)],
)
def test_performance_thresholds(spark, load, score):
    df = spark.createDataFrame([(None if load is None else float(load), None)], "load_ms double, nav double")
    p = df.select(performance(F.col("load_ms"), F.col("nav")).alias("p"))
    assert p.select(performance_score(F.col("p"))).first()[0] == score


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (59, 60, 79, 80)], "s long")
    assert [r[0] for r in df.select(band(F.col("s"))).collect()] == ["red", "amber", "amber", "green"]


EXPECTED = {
    "": "wa_empty_url", "   ": "wa_empty_url", "https://u:p@a.example.com": "wa_credentials_url",
    "https://a.example.com:8080": "wa_blocked_port", "http://localhost": "wa_blocked_host", "http://x.local": "wa_blocked_host",
    "http://y.internal.": "wa_blocked_host", "http://127.0.0.1": "wa_blocked_host", "http://10.0.0.1": "wa_blocked_host",
    "http://172.16.0.1": "wa_blocked_host", "http://192.168.1.1": "wa_blocked_host", "http://169.254.1.1": "wa_blocked_host",
    "http://0.0.0.1": "wa_blocked_host", "http://240.0.0.1": "wa_blocked_host", "https://": "wa_invalid_url",
    "https:///x": "wa_invalid_url", "ftp://a.example.com": "wa_invalid_url", "https://exa mple.com": "wa_invalid_url",
    "http://8.8.8.8": None, "http://172.32.0.1": None, "example.com": None, "https://a.example.com:443/": None,
}


def test_frontier_rules(spark):
    f = spark.createDataFrame([(i, u) for i, u in enumerate(EXPECTED)], "request_id long, raw_url string")
    dns = spark.createDataFrame([("example.com", "93.184.216.34"), ("a.example.com", "93.184.216.34")], "host string, ip string")
    got = {r.raw_url: r.error_code for r in fr.validate_frontier(f, dns).collect()}
    assert got == EXPECTED


def test_dns_private_and_missing(spark):
    f = spark.createDataFrame([(1, "https://a.test"), (2, "https://bb.test"), (3, "https://ccc.test")], "request_id long, raw_url string")
    dns = spark.createDataFrame([("a.test", "10.0.0.5"), ("bb.test", "8.8.8.8"), ("bb.test", " ")], "host string, ip string")
    got = {r.request_id: r.error_code for r in fr.validate_frontier(f, dns).collect()}
    assert got == {1: "wa_private_target", 2: None, 3: "wa_dns_failed"}


def test_redirect_target(spark):
    cases = [("https://h.example/a/b?q", "/x", "https://h.example/x"), ("https://h.example/a/b", "c", "https://h.example/a/c"),
             ("http://h.example:8080/a", "//o.example/z", "http://o.example/z"), ("https://h.example", "y", "https://h.example/y"),
             ("https://h.example/a", " HTTP://Z.example/ ", "HTTP://Z.example/")]
    df = spark.createDataFrame(cases, "base string, loc string, want string")
    for r in df.select(fr.redirect_target(F.col("base"), F.col("loc")).alias("got"), "want").collect():
        assert r.got == r.want


def _burst(spark):
    t0 = datetime(2024, 1, 1)
    secs = [0, 1, 3599, 3600, 3601, 3602, 7300]
    rows = [(i, "k", datetime.fromtimestamp(t0.timestamp() + s)) for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "id long, key string, ts timestamp")


def test_rate_limit_window_edges(spark):
    out = rl.rate_limit(_burst(spark), F.col("key"), F.col("ts"), "id", 2).orderBy("id")
    assert [r.accepted for r in out.collect()] == [True, True, False, True, True, False, True]


def test_rate_limit_refresh(spark):
    out = rl.rate_limit(_burst(spark), F.col("key"), F.col("ts"), "id", 3, refresh_on_accept=True).orderBy("id")
    # each accept restarts the hour: 0, 1, 3599 fill the window (expiry 7199); 3600..3602 rejected; 7300 opens a new one
    assert [r.accepted for r in out.collect()] == [True, True, True, False, False, False, True]


def test_stream_equals_batch_across_batches(spark, tmp_path):
    """Files arrive in time order, one per micro-batch: state carries across batches."""
    import time

    from sitelens.streaming.sinks import run_to_parquet

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("id"), "ts", "event_type")
    days = [r[0] for r in ev.select(F.to_date("ts")).distinct().orderBy(1).collect()]
    src = str(tmp_path / "src")
    for i, d in enumerate(days[:6]):
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    subset = spark.read.parquet(src)
    batch = {r.id: r.accepted for r in rl.rate_limit(subset, F.col("event_type"), F.col("ts"), "id", 2).collect()}
    stream = spark.readStream.schema(subset.schema).option("maxFilesPerTrigger", 1).parquet(src)
    res = run_to_parquet(rl.stream_rate_limit(stream, F.col("event_type"), "ts", "id", 2), spark, "test-w1")
    assert {r.id: r.accepted for r in res.collect()} == batch


def test_properties(spark):
    import __spark_entry__ as E

    q = E.queries()
    sf = "/root/testdata/sf0.001"
    s = q["c8_page_scorecard"](spark, sf)
    for c in ("overall", "seo", "security", "performance", "mobile", "technical", "accessibility"):
        assert s.where((F.col(c) < 0) | (F.col(c) > 100)).count() == 0
    k = q["k_page_checks"](spark, sf).where(~F.col("tab").isin("links", "server"))
    per_page = {r[1] for r in k.groupBy("page_id").count().collect()}
    assert per_page == {36}
    recs = q["r1_r2_recommendations"](spark, sf)
    assert recs.groupBy("page_id").count().where("count > 11").count() == 0
    assert q["c8_page_scorecard"](spark, sf).repartition(7).count() == s.count()
