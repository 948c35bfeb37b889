"""Cases that the derived fixtures do not hold: IPv6, repeated captures, odd model answers, rounding."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelens.functions.ip import expand_ipv6, is_ip, is_public_ip
from sitelens.operators import frontier as fr
from sitelens.operators import review as rv
from sitelens.operators.checks import format_ms
from sitelens.operators.http import robots_by_site
from sitelens.operators.scores import auto_summary
from sitelens.operators.stats import listing_after, listing_page

IPS = {
    "2606:4700::1": True, "2001:4860:4860:0:0:0:0:8888": True, "::": False, "::1": False, "0::1": False, "0:0:0:0:0:0:0:1": False,
    "0:0:0:0:0:ffff:a00:1": False, "::ffff:8.8.8.8": False, "fd12::1": False, "fe80::1": False, "2001:db8::1": False, "2001:DB8:0::5": False,
    "8.8.8.8": True, "10.0.0.1": False, "172.32.0.1": True, "240.1.1.1": False,
}
NOT_IPS = ["1:2", ":::", "a:b:c", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "::1.2.3", "1.2.3.4:80", "", "fe80::1%eth0", "1.2.3.256", "::256.1.1.1", "1:2:3:4:5:6:7::8"]


def test_ip_predicates(spark):
    df = spark.createDataFrame([(x,) for x in [*IPS, *NOT_IPS, None]], "ip string")
    got = {r["ip"]: (r["ok"], r["pub"]) for r in df.select("ip", is_ip("ip").alias("ok"), is_public_ip("ip").alias("pub")).collect()}
    for ip, public in IPS.items():
        assert got[ip] == (True, public), ip
    for ip in NOT_IPS[:-1]:
        assert got[ip] == (False, False), ip
    one = spark.createDataFrame([("1::8.8.4.4",)], "ip string").select(expand_ipv6("ip").alias("x")).first()["x"]
    assert one == "0001" + "0000" * 5 + "08080404"


def test_frontier_and_redirects_with_aaaa_records(spark, tmp_path):
    dns = [("v6.test", "2606:4700::1"), ("loop.test", "0:0:0:0:0:0:0:1"), ("mixed.test", "8.8.8.8"), ("mixed.test", "fd00::1"), ("v6.test", "8.8.8.8")]
    spark.createDataFrame(dns, "host string, ip string").write.parquet(f"{tmp_path}/dns")
    dns = spark.read.parquet(f"{tmp_path}/dns")
    urls = ["v6.test", "loop.test", "mixed.test", "[2606:4700::1]", "[::1]", "none.test"]
    df = spark.createDataFrame(list(enumerate(urls)), "request_id int, raw_url string")
    got = {r["raw_url"]: r["error_code"] for r in fr.validate_frontier(df, dns).collect()}
    assert got["v6.test"] is None and got["loop.test"] == got["mixed.test"] == fr.E_PRIVATE and got["none.test"] == fr.E_DNS
    starts = spark.createDataFrame([(1, "https://v6.test/a"), (2, "https://v6.test/z")], "request_id int, submitted_url string")
    hop = ("https://v6.test/a", 301, "/b")
    for times in (1, 2):  # a capture that is there twice changes nothing
        r = spark.createDataFrame([hop] * times + [("https://v6.test/b", 302, "https://loop.test/")], "url string, status int, location string")
        out = {x["request_id"]: x for x in fr.resolve_redirects(starts, r, dns).collect()}
        assert len(out) == 2 and out[1]["error"] == fr.E_PRIVATE and out[1]["redirects"] == 2
        assert out[2]["final_url"] == "https://v6.test/z" and out[2]["redirects"] == 0


def test_redirect_limit_and_loops(spark):
    dns = spark.createDataFrame([("h.test", "8.8.8.8")], "host string, ip string")
    hops = [(f"https://h.test/{k}", 302, f"/{k + 1}") for k in range(8)] + [("https://h.test/l", 301, "/l"), ("https://h.test/e", 302, "")]
    r = spark.createDataFrame(hops, "url string, status int, location string")
    starts = spark.createDataFrame([(k, f"https://h.test/{u}") for k, u in enumerate(["0", "2", "3", "l", "e", "8"])], "request_id int, submitted_url string")
    got = {x["request_id"]: (x["final_url"], x["error"], x["redirects"]) for x in fr.resolve_redirects(starts, r, dns).collect()}
    too_many = fr.TOO_MANY_REDIRECTS
    assert got == {
        0: (None, too_many, 6), 1: (None, too_many, 6), 2: ("https://h.test/8", None, 5), 3: (None, too_many, 6), 4: (None, too_many, 0), 5: ("https://h.test/8", None, 0),
    }


def test_robots_captured_twice_keep_one_row_a_site(spark):
    rows = [("https://a.test/robots.txt", 200, "User-agent: *\nDisallow: /", 1), ("https://a.test/robots.txt", 404, "", 2), ("https://b.test/robots.txt", 200, "x", 1)]
    df = spark.createDataFrame(rows, "robots_url string, status int, content string, fetched_at int")
    got = {r["base"]: r["robots_exists"] for r in robots_by_site(df).collect()}
    assert got == {"https://a.test": False, "https://b.test": True}


def answer(**fields):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": json.dumps(fields)}]}}]})


def test_answers_with_fractions_strings_and_repeats(spark):
    bodies = [
        ("u1", answer(overall_score=87.6, summary="s", ratings={"seo": 87.5, "security": "70", "mobile": None})),
        ("u1", answer(overall_score=87.6, summary="s", ratings={"seo": 87.5, "security": "70", "mobile": None})),
        ("u2", answer(overall_score=None, summary="", ratings={"seo": "n/a"})),
    ]
    parsed = rv.parse_responses(spark.createDataFrame([(u, 200, b, None) for u, b in bodies], "url string, status int, body string, error string"))
    score = "struct<overall:bigint,seo:bigint,security:bigint,performance:bigint,mobile:bigint>"
    pages = spark.createDataFrame([(i, u, (50, 10, 20, 90, 90)) for i, u in enumerate(["u1", "u2", "u3"])], f"page_id int, url string, scores {score}")
    rows = {r["url"]: r for r in rv.merge_reviews(pages, parsed).withColumn("summary", rv.summary_with_review(auto_summary(F.col("url"), F.col("scores")))).collect()}
    assert len(rows) == 3
    assert rows["u1"]["scores"]["overall"] == 88 and rows["u1"]["ai"]["ratings"]["seo"] == 88 and rows["u1"]["ai"]["ratings"]["security"] == 70
    assert rows["u2"]["scores"]["overall"] is None and rows["u2"]["ai"]["ratings"]["seo"] is None
    assert rows["u2"]["summary"].startswith("u2 scores null/100.") and rows["u3"]["scores"]["overall"] == 50


@pytest.mark.parametrize("ms,shown", [(999, "999ms"), (1000, "1.00s"), (1004, "1.00s"), (1005, "1.00s"), (1006, "1.01s"), (1015, "1.01s"), (1025, "1.02s"), (1045, "1.04s"), (1125, "1.13s"), (1375, "1.38s"), (8345, "8.35s"), (10005, "10.01s"), (59995, "59.99s")])
def test_seconds_round_like_to_fixed(spark, ms, shown):
    exact = spark.createDataFrame([(ms,)], "ms bigint").select(format_ms(F.col("ms"))).first()[0]
    from decimal import ROUND_HALF_UP, Decimal

    want = f"{ms}ms" if ms < 1000 else str(Decimal(ms / 1000).quantize(Decimal("0.01"), ROUND_HALF_UP)) + "s"
    assert exact == want
    if ms < 8000:
        assert exact == shown


def test_pages_by_key_follow_pages_by_offset(spark):
    rows = [(i, "d", 1, True, "", 0, "", datetime(2024, 1, 29, 0, i % 7)) for i in range(45)]
    df = spark.createDataFrame(rows, "id bigint, domain string, duration_ms int, success boolean, ip_address string, user_id bigint, user_agent string, created_at timestamp")
    as_of, after = datetime(2024, 1, 30), None
    for page in range(1, 7):
        want = [r["id"] for r in listing_page(df, "week", as_of, page, 10).collect()]
        got = listing_after(df, "week", as_of, after, 10).collect()
        assert [r["id"] for r in got] == want
        after = (got[-1]["created_at"], got[-1]["id"]) if got else after


def test_late_and_idle_keys_do_not_stop_the_stream(spark, tmp_path):
    import os

    from sitelens.streaming.ratelimit import stream_rate_limit

    batches = [
        [(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 10:00:01"), (3, "a", "2024-01-01 10:00:02")],
        [(4, "b", "2024-01-01 20:00:00")],  # the watermark rises to 18:00
        [(5, "a", "2024-01-01 09:00:00"), (6, "b", "2024-01-01 20:00:01")],  # 5 is too late
        [(7, "a", "2024-01-01 21:00:00"), (8, "b", "2024-01-01 20:00:02"), (9, "b", "2024-01-01 21:30:00")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id int, k string, t string").selectExpr("id", "k", "to_timestamp(t) ts").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        part = next(f for f in os.listdir(f"{tmp_path}/in{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/src", exist_ok=True)
        os.rename(f"{tmp_path}/in{i}/{part}", f"{tmp_path}/src/{i}.parquet")
        os.utime(f"{tmp_path}/src/{i}.parquet", (1e9 + i, 1e9 + i))

    def run():  # availableNow ends by itself; a second run resumes from the checkpoint
        src = spark.readStream.schema("id int, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
        q = stream_rate_limit(src, F.col("k"), "ts", "id", 2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return {r["id"]: r["accepted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    got = run()
    assert {k: v for k, v in got.items() if k != 5} == {1: True, 2: True, 3: False, 4: True, 6: True, 7: True, 8: False, 9: True}
    assert run() == got
