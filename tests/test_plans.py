"""Plan-shape checks: the physical plans we rely on for scale."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(p):
    """A physical plan's nodes, through adaptive wrappers."""
    if p.nodeName() == "AdaptiveSparkPlan":
        p = p.initialPlan()
    yield p
    for i in range(p.children().size()):
        yield from nodes(p.children().apply(i))


def test_scorecard_has_no_python_and_drops_body(spark):
    df = E.queries()["c8_page_scorecard"](spark, SF)
    found = list(nodes(df._jdf.queryExecution().executedPlan()))
    assert not any("Python" in n.nodeName() or "Pandas" in n.nodeName() for n in found)
    exchanges = [n for n in found if n.nodeName() == "Exchange"]
    assert exchanges
    for n in exchanges:  # what an exchange carries, not what it is dealt by
        carried = {n.output().apply(i).name() for i in range(n.output().size())}
        assert not carried & {"html", "body", "_masked", "_nocomment"}, carried


def test_top_domains_is_take_ordered(spark):
    p = plan(E.queries()["t6_top_domains"](spark, SF))
    assert "TakeOrderedAndProject" in p


def test_statistics_view_never_shuffles_the_users(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only the hints are left
    try:
        df = E.queries()["t9_view_week_p1"](spark, SF)
        found = [n.nodeName() for n in nodes(df._jdf.queryExecution().executedPlan())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in found and found.count("BroadcastHashJoin") == 2


def test_period_filter_pushed_to_scan(spark):
    df = E.queries()["t1_period_week"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
