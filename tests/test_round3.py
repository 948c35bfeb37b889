"""Report JSON in the reference's forms, redirected reports, pruned statistics."""

import json
import uuid

from pyspark.sql import functions as F

from sitelens.config import Params
from sitelens.functions.json import pretty_json
from sitelens.operators import review as rv
from sitelens.operators import stats as st
from sitelens.operators.lookup import lookup_join
from sitelens.plans import audit
from sitelens.plans.queries import QUERIES
from sitelens.session import shared_path
from sitelens.sources import exports
from sitelens.sources import statistics as usage
from sitelens.sources.fixtures import Tables
from tests.conftest import SF_SMALL

SCHEMA = (
    "page_id int, url string, http struct<status_code:bigint,https:boolean,note:string>, "
    "seo struct<title:string,images:array<struct<src:string,alt:string>>,og:map<string,string>,tags:array<string>,total_images:bigint>, kb double"
)
ROWS = [
    (1, "https://s.test/a", (200, True, None), ("Caf\u00e9 \"x\" \U0001f600", [("/i.png", "")], {"og:a": "1/2"}, ["t\tab"], 1), 12.5),
    (2, "https://s.test/b", (404, False, "line\nbreak \x01 \\ end"), ("", [], {}, [], 0), 3.0),
]
# what JSON_PRETTY_PRINT prints of the first report
PHP_FIRST = """{
    "url": "https:\\/\\/s.test\\/a",
    "http": {
        "status_code": 200,
        "https": true,
        "note": null
    },
    "seo": {
        "title": "Caf\\u00e9 \\"x\\" \\ud83d\\ude00",
        "images": [
            {
                "src": "\\/i.png",
                "alt": ""
            }
        ],
        "og": {
            "og:a": "1\\/2"
        },
        "tags": [
            "t\\tab"
        ],
        "total_images": 1
    },
    "kb": 12.5
}"""
# what JSON.stringify(.., null, 2) prints of the second
JS_SECOND = """{
  "url": "https://s.test/b",
  "http": {
    "status_code": 404,
    "https": false,
    "note": "line\\nbreak \\u0001 \\\\ end"
  },
  "seo": {
    "title": "",
    "images": [],
    "og": [],
    "tags": [],
    "total_images": 0
  },
  "kb": 3
}"""


def test_download_form(spark, tmp_path):
    reports = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["page_id"]: r["json"] for r in exports.report_json(reports, pretty=True).collect()}
    assert got[2] == JS_SECOND
    assert json.loads(got[1])["seo"]["title"] == ROWS[0][3][0]
    exports.write_reports_json(reports.filter("page_id = 2"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()] == [JS_SECOND + "\n"]


def test_prompt_is_the_template_around_the_report(spark):
    out = {r["page_id"]: r["prompt"] for r in rv.review_requests(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    before, after = out[1].split(PHP_FIRST)
    assert before == (
        "You are an expert website analyst. Analyze the following website data and provide a comprehensive assessment.\n\n"
        "IMPORTANT: Use ONLY the provided data. Do not make assumptions beyond what is given.\n\nWebsite Data:\n"
    )
    assert after.startswith("\n\nRespond ONLY with a valid JSON object (no markdown, no preamble) with this exact structure:\n{\n")


def test_strings_like_the_library(spark):
    texts = ["", "a/b", "\u2028\u00ff", "\x00\x1f", '\\"\b\f\r', "\U0001f469\u200d\U0001f680"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kind = df.schema["t"].dataType
    got = df.select(pretty_json(F.col("t"), kind).alias("p"), pretty_json(F.col("t"), kind, php=False).alias("j")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r["p"] == json.dumps(t).replace("/", "\\/") and r["j"] == json.dumps(t, ensure_ascii=False)


def test_every_request_has_an_outcome_and_bodies_stay(spark):
    t = Tables(spark, SF_SMALL)
    some = t.fetches().filter("page_id % 4 <> 1")  # the other pages were never captured
    cards, outcomes = audit.redirected_scorecard(t.redirect_start(), t.redirects(), t.dns(), some, t.robots(), t.sitemaps())
    n = t.redirect_start().count()
    assert outcomes.count() == n == outcomes.select("request_id").distinct().count()
    assert cards.count() == outcomes.filter("success").count() and cards.filter("submitted_url <> final_url AND redirects > 0").count() > 0
    kinds = {r["error"] for r in outcomes.select("error").distinct().collect()}
    assert {None, "fetch failed", "Too many redirects."} <= kinds
    recorded = usage.outcomes_to_statistics(outcomes.withColumn("created_at", F.coalesce("created_at", F.lit("2024-01-30").cast("timestamp"))))
    assert recorded.filter("NOT success").count() == outcomes.filter("NOT success").count()
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "html#" in line]


def test_many_captures_of_a_page_give_one_report(spark):
    t = Tables(spark, SF_SMALL)
    twice = t.fetches().unionByName(t.fetches().withColumn("fetched_at", F.lit("2024-01-29").cast("timestamp")).withColumn("status", F.lit(500)))
    cards, outcomes = audit.redirected_scorecard(t.redirect_start(), t.redirects(), t.dns(), twice, t.robots(), t.sitemaps())
    assert outcomes.count() == t.redirect_start().count()
    assert cards.filter("http.status_code = 500").count() == 0 and cards.count() == cards.select("request_id").distinct().count()


def test_periods_prune_the_stored_table(spark):
    path = shared_path(spark, "tables", f"usage-{uuid.uuid4().hex}")
    usage.append_statistics(Tables(spark, SF_SMALL).statistics(), path)
    table = usage.read_statistics(spark, path)
    for df in (st.filter_period(table, "week", Params().as_of), st.daily_counts(table, "week", Params().as_of)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        part = plan[plan.index("PartitionFilters: ["):]
        assert "created_date" in part[: part.index("]")]
    assert QUERIES["s4_t1_stored_week"](spark, SF_SMALL).count() == QUERIES["t1_period_week"](spark, SF_SMALL).count()


def test_a_hot_key_is_split_where_it_is_measured(spark):
    """Half of the facts have one key: its partition is split, and nothing is replicated beforehand."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 997)
        facts = spark.range(0, 200_000, 1, 8).select("id", key.alias("host"), F.md5(F.col("id").cast("string")).alias("pad"))
        sites = spark.range(997).select(F.col("id").alias("host"), (F.col("id") * 2).alias("site"))
        out = lookup_join(facts, sites, ["host"], ["id"])
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        placed = out.withColumn("p", F.spark_partition_id())
        tasks = placed.groupBy("p").agg(F.count_if(F.col("host") == 0).alias("hot"), F.max("pad")).filter("hot > 0").collect()
        assert len(tasks) >= 4 and max(t["hot"] for t in tasks) < 50_000
        assert out.filter("site = host * 2").count() == 200_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
