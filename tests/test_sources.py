"""Usage-table source and sinks: append, read with partition pruning, clear, drop; CSV/JSON sinks."""

import os

from pyspark.sql import functions as F

from sitelens.config import Params
from sitelens.operators import stats as st
from sitelens.session import shared_path
from sitelens.sources import statistics as S
from sitelens.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def test_statistics_round_trip(spark):
    path = shared_path(spark, "tables", "stats-roundtrip")
    rows = Tables(spark, SF).statistics()
    S.append_statistics(rows, path)
    back = S.read_statistics(spark, path)
    assert back.count() == rows.count()
    assert back.where(F.col("ip_address") != "").count() == 0
    week = st.filter_period(back, "week", Params().as_of)
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "created_date" in plan
    assert week.count() == st.filter_period(rows, "week", Params().as_of).count()
    S.clear_statistics(spark, path)
    assert S.read_statistics(spark, path).count() == 0
    S.drop_statistics(spark, path)
    assert not os.path.exists(path)


def test_csv_and_json_sinks(spark):
    import __spark_entry__ as E
    from sitelens.plans import audit
    from sitelens.sources import exports

    t = Tables(spark, SF)
    scored = audit.page_scorecard(t.crawl(), t.robots(), t.sitemaps())
    out = shared_path(spark, "exports", "scores-csv")
    exports.write_scores_csv(scored, out)
    text = spark.read.text(out).where(F.col("value").startswith('"1",')).limit(1).collect()
    assert text and text[0][0].count('"') == 6
    lines = E.queries()["s10_scores_csv"](spark, SF)
    assert lines.where("ord = 0").count() == scored.count()
