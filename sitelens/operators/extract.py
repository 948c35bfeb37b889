"""HTML feature extraction (H0-H14) as native Catalyst expressions.

No DOM: a page is scanned with regex passes inside the JVM (built-in expressions,
no Python per row) whose cost is linear in the page whatever is left open in it:

1. one scan steps over comments, scripts and styles in document order, so a comment
   opener inside a script is script text and a script inside a comment is comment;
   comments are removed and script and style bodies emptied.  What is never closed
   reaches to the end of the page, so no opener is scanned to the end twice;
2. one scan for the tags that carry features (meta, link, img, a), one split at the
   heading openers, one scan for scripts.  They stand in projections of their own and
   never inside a lambda, so a page is read a fixed number of times however many
   tags it has;
3. the pieces of a match (tag, attributes, text) and single attributes are read
   from the match itself.  A quote opens a value right after ``=`` only; a tag ends
   at the first ``>`` outside quoted values, and one that never ends is no tag.  A
   heading ends at a closing heading tag, at the next heading, or with the page.
   Repeated groups are possessive, which Java runs as a loop: no stack grows with
   the number of attributes;
4. element text has inner tags stripped, character references decoded, and is
   PHP-trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import byte_length, cp_length, dom_text, php_trim, unescape_entities
from sitelens.functions.url import url_host

# what stands between a tag's name and its closing bracket, or the end of the page
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)*+"""
_END = r"(?=[\s/>]|\z)"  # of a tag's name


def _element(name: str, group: str) -> str:
    """A raw-text element; its two tags in groups, the body between them in ``group``."""
    return rf"(<{name}{_END}{_REST}>?+){group}(</{name}\s*+>|\z)"


RAW_RE = rf"(?is)<!--.*?(?:-->|\z)|{_element('script', '.*?')}|{_element('style', '.*?')}"
SCRIPT_PARTS_RE = rf"(?is)^<script({_REST})>(.*?)(?:</script\s*+>)?+\z"
ANY_TAG_RE = rf"(?is)<[a-z][a-z0-9:_.\-]*+{_REST}>?+[^<]*+"
FEATURE_TAG_RE = rf"(?i)<(?:meta|link|img|a){_END}{_REST}>?+"
TAG_PARTS_RE = rf"(?is)^<([a-z][a-z0-9:_.\-]*+)({_REST})>(.*)\z"
TITLE_RE = rf"(?is)<title{_END}{_REST}>?+(.*?)(?:</title\s*+>|\z)"
HEADING_SPLIT_RE = r"(?i)(?=<h[1-6][\s/>])"
HEADING_PARTS_RE = rf"(?is)^<(h[1-6]){_REST}>(.*?)(?:</h[1-6]\s*+>|\z)"

LD_JSON_TYPE = "application/ld+json"
# JSON texts PHP treats as false after decoding (blank-free form).
FALSY_JSON = ["{}", "[]", "0", "0.0", "-0", '""', '"0"', "false", "null"]


_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_JUNK = r"""[\s/"'=]*+"""


def _upto(name: str) -> str:
    """Pattern from the start of an attribute string through its first ``name``:
    other attributes are stepped over whole, so text inside values is not seen."""
    other = rf"""(?!{name}(?:[\s=/"']|$))[^\s"'=>/]++(?:\s*+=\s*+{_VALUE})?+{_JUNK}"""
    return rf"(?is)^{_JUNK}(?:{other})*+{name}"


def raw_attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute ``name`` in an attribute string ('' if absent), not decoded."""
    raw = F.regexp_extract(attrs, rf"{_upto(name)}\s*+=\s*+({_VALUE})", 1)
    return F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")


def has_attr(attrs: Column, name: str) -> Column:
    return attrs.rlike(rf"""{_upto(name)}(?:[\s=/"']|$)""")


def mask_markup(body: Column) -> Column:
    """Comments removed, script/style bodies emptied (their tags kept)."""
    return F.regexp_replace(body, RAW_RE, "$1$2$3$4")


def extract_elements(pages: DataFrame, id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """H0: one row per start tag in document order: (id, pos, tag, attrs, text).

    ``text`` is the character data right after the tag, up to the next tag.
    Comments and script/style bodies are not scanned.
    """
    found = F.regexp_extract_all(mask_markup(F.col(body_col)), F.lit(ANY_TAG_RE), 0)
    # a last tag that never ends is none
    z = pages.select(id_col, F.posexplode(found).alias("pos", "e")).where(F.col("e").rlike(TAG_PARTS_RE))
    return z.select(
        id_col,
        F.col("pos").cast("bigint").alias("pos"),
        F.lower(F.regexp_extract("e", TAG_PARTS_RE, 1)).alias("tag"),
        F.regexp_extract("e", TAG_PARTS_RE, 2).alias("attrs"),
        F.regexp_extract("e", TAG_PARTS_RE, 3).alias("text"),
    )


def _first(arr: Column, pred, field: str) -> Column:
    hit = F.get(F.filter(arr, pred), 0)
    return F.coalesce(php_trim(hit.getField(field)), F.lit(""))


def _last_by_key(metas: Column, field: str, prefix: str) -> Column:
    """Map of the metas whose ``field`` has the prefix: places by first, values by last occurrence."""
    some = F.filter(metas, lambda m: m[field].startswith(prefix))
    keys = F.array_distinct(F.transform(some, lambda m: m[field]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(some, lambda m: m[field] == k), -1)["content"]))


def with_page_features(crawl: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """Adds a ``seo`` struct and ``html_meta`` struct; drops the body.

    Works row-by-row (no shuffle); the heavy body column is dropped at the end
    so nothing downstream (joins, shuffles) carries it.
    """
    body = F.col(body_col)
    stage1 = crawl.select(
        "*",
        mask_markup(body).alias("_masked"),
        F.regexp_extract_all(body, F.lit(RAW_RE), 0).alias("_raw"),
    )
    scanned = stage1.select(
        "*",
        F.regexp_extract_all(F.col("_masked"), F.lit(FEATURE_TAG_RE), 0).alias("_found_tags"),
        F.split(F.col("_masked"), HEADING_SPLIT_RE, -1).alias("_found_heads"),
        F.filter("_raw", lambda r: F.lower(F.substring(r, 1, 7)) == "<script").alias("_found_scripts"),
        dom_text(F.regexp_extract(F.col("_masked"), TITLE_RE, 1)).alias("_title_text"),
        byte_length(body).alias("_bytes"),
    ).drop("_masked", "_raw", body_col)
    stage2 = scanned.select(
        "*",
        F.transform(
            "_found_tags",
            lambda t: F.struct(F.lower(F.regexp_extract(t, TAG_PARTS_RE, 1)).alias("tag"), F.regexp_extract(t, TAG_PARTS_RE, 2).alias("a")),
        ).alias("_tags"),
        F.transform(
            "_found_heads",
            lambda h: F.struct(F.lower(F.regexp_extract(h, HEADING_PARTS_RE, 1)).alias("level"), dom_text(F.regexp_extract(h, HEADING_PARTS_RE, 2)).alias("text")),
        ).alias("_heads"),
        F.transform(
            "_found_scripts",
            lambda s: F.struct(raw_attr(F.regexp_extract(s, SCRIPT_PARTS_RE, 1), "type").alias("type"), F.regexp_extract(s, SCRIPT_PARTS_RE, 2).alias("text")),
        ).alias("_scripts"),
    ).drop("_found_tags", "_found_heads", "_found_scripts")

    # the attributes that count, by tag: three values and whether the last named one is there
    def values(t: Column) -> Column:
        is_meta, is_link, is_img, a = t["tag"] == "meta", t["tag"] == "link", t["tag"] == "img", t["a"]
        href = F.when(is_link | (t["tag"] == "a"), raw_attr(a, "href")).otherwise("")
        return F.struct(
            t["tag"].alias("tag"),
            F.array(
                F.when(is_meta, raw_attr(a, "name")).when(is_link, raw_attr(a, "rel")).when(is_img, raw_attr(a, "src")).otherwise(""),
                F.when(is_meta, raw_attr(a, "property")).when(is_img, raw_attr(a, "alt")).otherwise(href),
                F.when(is_meta, raw_attr(a, "content")).otherwise(""),
            ).alias("v"),
            F.when(is_meta, has_attr(a, "content")).otherwise(~is_img & has_attr(a, "href")).alias("has"),
        )

    n_heads = F.size("_heads")
    read = stage2.select("*", F.transform("_tags", values).alias("_read")).drop("_tags")
    # references are decoded here and nowhere else
    decoded = read.select(
        "*",
        F.transform("_read", lambda t: F.struct(t["tag"].alias("tag"), F.transform(t["v"], unescape_entities).alias("v"), t["has"].alias("has"))).alias("_done"),
        F.transform(
            F.concat(F.array("_title_text"), F.col("_heads.text"), F.col("_scripts.type")), unescape_entities
        ).alias("_texts"),
    ).drop("_read", "_title_text")

    def of(tag: str, *names: str) -> Column:
        some = F.filter("_done", lambda t: (t["tag"] == tag) & (t["has"] if tag == "a" else F.lit(True)))
        return F.transform(some, lambda t: F.struct(*[F.get(t["v"], k).alias(n) for k, n in enumerate(names)], t["has"].alias("has")))

    stage3 = decoded.select(
        *[c for c in decoded.columns if c not in ("_done", "_texts", "_heads", "_scripts")],
        of("meta", "name", "property", "content").alias("_metas"),
        of("link", "rel", "href").alias("_links"),
        of("img", "src", "alt").alias("_imgs"),
        F.transform(of("a", "_", "href"), lambda t: url_host(t["href"])).alias("_hrefs"),
        php_trim(F.get("_texts", 0)).alias("_title"),
        F.zip_with("_heads", F.slice("_texts", F.lit(2), n_heads), lambda h, t: F.struct(h["level"].alias("level"), php_trim(t).alias("text"))).alias("_heads"),
        F.zip_with("_scripts", F.slice("_texts", n_heads + 2, F.size("_scripts")), lambda s, t: F.struct(t.alias("type"), s["text"].alias("text"))).alias("_scripts"),
    )

    metas, heads, imgs = F.col("_metas"), F.col("_heads"), F.col("_imgs")
    page_host = url_host(F.col(url_col))

    def meta_named(v: str) -> Column:
        return _first(metas, lambda m: (m["name"] == v) & m["has"], "content")

    def level(lv: str) -> Column:
        return F.transform(F.filter(heads, lambda h: h["level"] == lv), lambda h: h["text"])

    images = F.transform(imgs, lambda i: F.struct(i["src"].alias("src"), i["alt"].alias("alt"), (i["alt"] != "").alias("has_alt")))
    og = _last_by_key(metas, "property", "og:")
    tw = _last_by_key(metas, "name", "twitter:")
    schema = F.transform(
        F.filter(
            F.col("_scripts"),
            lambda s: (s["type"] == LD_JSON_TYPE)
            & F.try_parse_json(s["text"]).isNotNull()
            & ~F.regexp_replace(s["text"], r"\s", "").isin(*FALSY_JSON),
        ),
        lambda s: s["text"],
    )
    canonical = _first(F.col("_links"), lambda ln: (ln["rel"] == "canonical") & ln["has"], "href")
    robots_meta = meta_named("robots")
    hrefs = F.col("_hrefs")
    external = F.size(F.filter(hrefs, lambda h: (h != "") & (h != page_host)))
    n_without_alt = F.size(F.filter(imgs, lambda i: i["alt"] == ""))

    seo = F.struct(
        F.col("_title").alias("title"),
        cp_length(F.col("_title")).alias("title_length"),
        meta_named("description").alias("meta_description"),
        cp_length(meta_named("description")).alias("meta_desc_length"),
        canonical.alias("canonical"),
        robots_meta.alias("robots_meta"),
        meta_named("viewport").alias("viewport"),
        F.struct(*[level(f"h{k}").alias(f"h{k}") for k in range(1, 7)]).alias("headings"),
        images.alias("images"),
        n_without_alt.cast("bigint").alias("images_without_alt"),
        F.size(imgs).cast("bigint").alias("total_images"),
        og.alias("open_graph"),
        (F.size(og) > 0).alias("has_og"),
        tw.alias("twitter_card"),
        (F.size(tw) > 0).alias("has_twitter"),
        schema.alias("schema"),
        (F.size(schema) > 0).alias("has_schema"),
        (F.size(hrefs) - external).cast("bigint").alias("internal_links"),
        external.cast("bigint").alias("external_links"),
        F.lower(robots_meta).contains("noindex").alias("is_noindex"),
    )
    html_meta = F.struct(
        F.col("_bytes").alias("page_size_bytes"),
        F.round(F.col("_bytes") / F.lit(1024.0), 2).alias("page_size_kb"),
    )
    return stage3.select("*", seo.alias("seo"), html_meta.alias("html_meta")).drop(
        "_metas", "_links", "_imgs", "_hrefs", "_heads", "_scripts", "_title", "_bytes"
    )
