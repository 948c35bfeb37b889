import pytest

from sitelens.llm import url_filter as uf
from sitelens.llm.q_url import RULES

URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.b.NET/x?y", "https://example.net/en/1", "https://sub.example.net/en",
    "http://example.com/de/x#f", "http://x.example.com/fr/", "http://w.org/fr/a", "http://notnet/", "http://planet/", "http://a.net", "x://y://net/", "http://org/fr/",
]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    tail = rest[n:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("most", [uf.MAX_FILTER_BLOCKS, 0])
def test_every_row_is_judged(spark, most):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge_urls(pages, rules, max_filter_blocks=most).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert uf.judge_urls(pages, none).first()["verdict"] == "allow"
    assert uf.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_filter_has_no_false_negatives_and_few_positives(spark):
    listed = uf.canonical_rules(spark.range(2000).selectExpr("concat('h', id, '.com') host", "'/' path", "'block' verdict"))
    blocks = uf.filter_blocks(2000)
    bloom = uf.bloom_filter(listed, blocks)
    assert uf.possible_hits(listed.select("key"), bloom, blocks).count() == 2000
    others = spark.range(20000).selectExpr("concat('o', id, '.com/') key")
    assert uf.possible_hits(others, bloom, blocks).count() < 400
