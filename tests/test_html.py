"""Hand-written expectations for awkward HTML (not derived from the patterns)."""

import time

import pytest
from pyspark.sql import functions as F

from sitelens.functions.text import truncate_bytes, unescape_entities
from sitelens.operators.extract import extract_elements, with_page_features
from sitelens.sources.captures import normalize_crawl

PAGES = {
    "refs": "<title>A &#8211; B &mdash; C</title><meta name='description' content='x &amp;lt; &eacute;&#x20AC;&bogus; &#xD800; 5 &lt 6'>",
    "tight": '<meta name="description"content="hello"><img alt="a > b" src=/i.png>',
    "inside": '<img title="x alt=none"><img ALT=first alt=second><a title=\'href="/x"\'>no</a><a href=/y>yes</a>',
    "metas": '<META NAME=viewport CONTENT=width><meta property="og:title" content="one"><meta property="og:type" content=web><meta property="og:title" content="two">',
    "heads": "<h1 class='a>b'>One <b>bold</b></h1><h2>A</h2><h2></h2><!-- <h1>no</h1> --><script>var s='<h1>no</h1>';</script>",
    "ld": '<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{}</script><script>x</script>',
    "broken": '<img alt="open src=x><p>text < 3 <a href="',
    "empty": "",
    "quote": "<a href=/x title=it's>q</a><img src=\"a.png\" alt=\"pic\"><p>don't</p><img alt = 'b > c' src==odd>",
    "names": '<a-b href="/no">c</a-b><imgx src=x><img/src=/s.png/ alt><link rel=canonical href=https://s.test/c?a=1&amp;b=2>',
    "open": "<h3>open <i>one</i><h4>next</h4> after <H5 id=x>five</h5 ><h6>to the end <b>bold</b>",
    "raw": '<script>var s = "<!--";</script><img alt=seen><!-- <script> --><img alt=too><style>p > a {}<img></style><script>"</p><h1>"',
    "comment": '<img alt=kept><!-- open <img alt=lost> <h1>lost</h1>',
    "cut": '<img alt=kept><a href="/y">y</a><img alt="never closed> <h1>x</h1>',
    "angle": "<title>1 < 2 & 3 <> 4</title><h1>a <b>b</b> < c</h1>",
}


@pytest.fixture(scope="module")
def seo(spark):
    df = spark.createDataFrame([(k, "https://s.test/", v) for k, v in PAGES.items()], "page_id string, url string, body string")
    return {r["page_id"]: r["seo"].asDict(recursive=True) for r in with_page_features(df).collect()}


def test_character_references(seo):
    assert seo["refs"]["title"] == "A – B — C" and seo["refs"]["title_length"] == 9
    assert seo["refs"]["meta_description"] == "x &lt; é€&bogus; &#xD800; 5 &lt 6"


def test_attributes(seo):
    assert seo["tight"]["meta_description"] == "hello"
    assert [(i["src"], i["alt"]) for i in seo["tight"]["images"]] == [("/i.png", "a > b")]
    assert [(i["alt"], i["has_alt"]) for i in seo["inside"]["images"]] == [("", False), ("first", True)]
    assert seo["inside"]["internal_links"] == 1
    assert seo["metas"]["viewport"] == "width"
    assert seo["metas"]["open_graph"] == {"og:title": "two", "og:type": "web"}


def test_headings_scripts_and_rubbish(seo):
    assert seo["heads"]["headings"]["h1"] == ["One bold"] and seo["heads"]["headings"]["h2"] == ["A", ""]
    assert seo["ld"]["schema"] == ['{"a": 1}']
    assert seo["broken"]["title"] == "" and seo["empty"]["total_images"] == 0


def test_quotes_open_values_only_after_the_sign(seo):
    assert [(i["src"], i["alt"]) for i in seo["quote"]["images"]] == [("a.png", "pic"), ("=odd", "b > c")]
    assert seo["quote"]["internal_links"] == 1
    assert [(i["src"], i["alt"]) for i in seo["names"]["images"]] == [("/s.png/", "")]
    assert seo["names"]["internal_links"] == 0 and seo["names"]["canonical"] == "https://s.test/c?a=1&b=2"


def test_what_is_not_closed(seo):
    heads = seo["open"]["headings"]
    assert (heads["h3"], heads["h4"], heads["h5"], heads["h6"]) == (["open one"], ["next"], ["five"], ["to the end bold"])
    assert [i["alt"] for i in seo["raw"]["images"]] == ["seen", "too"] and seo["raw"]["headings"]["h1"] == []
    assert [i["alt"] for i in seo["comment"]["images"]] == ["kept"] and seo["comment"]["headings"]["h1"] == []
    assert [i["alt"] for i in seo["cut"]["images"]] == ["kept"] and seo["cut"]["internal_links"] == 1
    assert seo["angle"]["title"] == "1 < 2 & 3 <> 4" and seo["angle"]["headings"]["h1"] == ["a b < c"]


OPENERS = ["<!--", "<!-- a -", "<h1>", "<h1 ", "<script>", "<script ", "<style>", "<title>", "<title ", "<a ", '<a href="', "<img alt='", "<a b=", "< ", "</script", "&#", "<h1>x<h2 ", "= '"]


@pytest.mark.parametrize("opener", OPENERS)
def test_time_is_linear_in_what_is_left_open(spark, opener):
    def seconds(size):
        df = spark.createDataFrame([(1, "https://s.test/", opener * (size // len(opener)))], "page_id int, url string, body string")
        t = time.perf_counter()
        with_page_features(df).select("seo").collect()
        extract_elements(df).count()
        return time.perf_counter() - t

    seconds(1000)
    # four times the page: quadratic work would take sixteen times as long
    small, large = seconds(150_000), seconds(600_000)
    assert large < 6 * small + 2


def test_elements_end_outside_quotes(spark):
    df = spark.createDataFrame([("p", '<p data-x="1>2">hi</p><br>')], "page_id string, body string")
    assert [(r["tag"], r["text"]) for r in extract_elements(df).orderBy("pos").collect()] == [("p", "hi"), ("br", "")]


def test_thousands_of_attributes_and_large_pages(spark):
    wide = "<a " + " ".join(f'd{i}="v > {i}"' for i in range(20000)) + ' href="/z">z</a>'
    big = "<h1>ü</h1>" + "é" * 700_000 + '<img alt="end">'
    rows = [(1, "https://s.test/", wide, {"A": "1", "a": "2"}), (2, "https://s.test/", big, None)]
    df = normalize_crawl(spark.createDataFrame(rows, "page_id int, url string, body string, headers map<string,string>"))
    got = {r["page_id"]: r for r in with_page_features(df).collect()}
    assert got[1]["seo"]["internal_links"] == 1 and list(got[1]["headers"]) == ["a"]
    assert got[2]["seo"]["images"][0]["alt"] == "end" and got[2]["html_meta"]["page_size_bytes"] == len(big.encode())


def test_truncation_never_splits_a_character(spark):
    texts = ["aé€😀" * 5, "", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for cap in range(1, 14):
        got = [r["c"] for r in df.select(truncate_bytes("t", cap).alias("c")).collect()]
        assert got == [t.encode()[:cap].decode(errors="ignore") for t in texts]


def test_no_page_scan_in_a_lambda(spark):
    df = with_page_features(spark.createDataFrame([(1, "u", "b")], "page_id int, url string, body string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("regexp_replace(body") == 1
    for at in [i for i in range(len(plan)) if plan.startswith("lambdafunction(", i)]:
        depth, j = 0, at
        while True:
            depth += {"(": 1, ")": -1}.get(plan[j], 0)
            j += 1
            if depth == 0 and plan[j - 1] == ")":
                break
        assert "regexp_extract_all(" not in plan[at:j]


def test_time_is_linear_in_links(spark):
    def seconds(n):
        body = "".join(f'<a href="/page/{i}" title="t">text {i}</a>' for i in range(n))
        df = with_page_features(spark.createDataFrame([(1, "https://s.test/", body)], "page_id int, url string, body string"))
        t = time.perf_counter()
        assert df.select(F.col("seo.internal_links")).first()[0] == n
        return time.perf_counter() - t

    seconds(1000)
    small, large = min(seconds(5000) for _ in range(2)), min(seconds(20000) for _ in range(2))
    assert large < 8 * small + 1


def test_unescape_is_applied_once(spark):
    df = spark.createDataFrame([("&amp;lt; &amp;#60; & &; &#; &#0; &#1114112; &AMP;",)], "t string")
    assert df.select(unescape_entities("t")).first()[0] == "&lt; &#60; & &; &#; &#0; &#1114112; &AMP;"
