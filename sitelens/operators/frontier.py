"""URL frontier validation (U1-U13) and redirect resolution.

A frontier table of submitted URLs becomes ``(url, error_code)``: every rule is
a column expression, the first failing rule wins (``coalesce`` of ``when``s),
and the DNS rules are a lookup join against per-host facts computed once per
host (a partial + final aggregate over the DNS table, never an array per host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import MAX_REQUESTS
from sitelens.functions.ip import first_forwarded, is_ip, is_public_ip
from sitelens.functions.text import php_empty, php_trim
from sitelens.functions.url import url_host, url_path, url_port, url_scheme, url_userinfo
from sitelens.operators.lookup import lookup_join, one_per_key
from sitelens.storage import written

# Error codes in rule order.
E_EMPTY, E_INVALID, E_SCHEME = "wa_empty_url", "wa_invalid_url", "wa_invalid_scheme"
E_CREDENTIALS, E_PORT, E_HOST = "wa_credentials_url", "wa_blocked_port", "wa_blocked_host"
E_DNS, E_PRIVATE = "wa_dns_failed", "wa_private_target"
TOO_MANY_REDIRECTS = "Too many redirects."
# Blocked host names and suffixes; allowed ports.
BLOCKED_HOSTS = ["localhost", "localhost.localdomain"]
BLOCKED_SUFFIXES = [".local", ".localhost", ".internal"]
ALLOWED_PORTS = [80, 443]

# authority = [userinfo@]host[:port]; port digits required after ':'
AUTHORITY_OK_RE = r"^(?:[^@/?#\s]*@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._~%!$&'()*+,;=\-]+)(?::[0-9]+)?$"
AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


_TRIMMED = "_trimmed_url"


def normalize_url(raw: Column) -> Column:
    """PHP-trim, then ``https://`` unless the scheme is http(s)."""
    t = php_trim(raw)
    return F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def syntax_error(url: Column, trimmed: Column) -> Column:
    """U1-U7 on a normalized URL: first failing rule's code, else null."""
    authority = F.regexp_extract(url, AUTHORITY_RE, 1)
    host = url_host(url)
    norm_host = F.lower(F.rtrim(host, F.lit(".")))
    scheme = url_scheme(url)
    port = url_port(url)
    ip_literal = is_ip(norm_host)
    blocked = (
        norm_host.isin(*BLOCKED_HOSTS)
        | F.exists(F.array(*[F.lit(s) for s in BLOCKED_SUFFIXES]), lambda s: norm_host.endswith(s))
        | (ip_literal & ~is_public_ip(norm_host))
    )
    return (
        F.when(trimmed == "", F.lit(E_EMPTY))
        .when(url.rlike(r"\s") | ~authority.rlike(AUTHORITY_OK_RE) | (scheme == "") | (host == ""), F.lit(E_INVALID))
        .when(~F.lower(scheme).isin("http", "https"), F.lit(E_SCHEME))
        .when(~php_empty(url_userinfo(url)), F.lit(E_CREDENTIALS))
        .when(~php_empty(port) & ~F.coalesce(port.try_cast("int").isin(*ALLOWED_PORTS), F.lit(False)), F.lit(E_PORT))
        .when(blocked, F.lit(E_HOST))
    )


def normalize_frontier(frontier: DataFrame, raw_col: str = "raw_url") -> DataFrame:
    """Adds ``url`` (normalized), ``host`` (lower-case, no trailing dots) and the syntax error."""
    # the URL is a column before its parts are taken: each rule names it, and it would
    # be normalized again in each
    trimmed = php_trim(F.coalesce(F.col(raw_col), F.lit("")))
    known = frontier.select("*", normalize_url(F.coalesce(F.col(raw_col), F.lit(""))).alias("url"), trimmed.alias(_TRIMMED))
    return known.select(
        *[known[c] for c in frontier.columns],
        "url",
        F.lower(F.rtrim(url_host("url"), F.lit("."))).alias("host"),
        syntax_error(F.col("url"), F.col(_TRIMMED)).alias("syntax_error"),
    )


def dns_by_host(dns: DataFrame) -> DataFrame:
    """U8/U10 facts per host: any address, all addresses public (A and AAAA merged)."""
    ip = php_trim(F.coalesce(F.col("ip"), F.lit("")))
    return (
        dns.select(F.lower(F.rtrim(F.col("host"), F.lit("."))).alias("host"), ip.alias("ip"))
        .where(F.col("ip") != "")
        .groupBy("host")
        .agg(F.lit(True).alias("resolves"), F.bool_and(is_public_ip(F.col("ip"))).alias("all_public"))
    )


def validate_frontier(frontier: DataFrame, dns: DataFrame, raw_col: str = "raw_url", row_id: str = "request_id") -> DataFrame:
    """``request_id, raw_url, url, host, error_code, valid_url`` for every submitted URL."""
    n = normalize_frontier(frontier, raw_col)
    j = lookup_join(n, dns_by_host(dns), ["host"], [row_id])
    literal = is_ip(F.col("host"))
    err = F.coalesce(
        F.col("syntax_error"),
        F.when(~literal & ~F.coalesce(F.col("resolves"), F.lit(False)), F.lit(E_DNS)),
        F.when(literal & ~is_public_ip(F.col("host")), F.lit(E_PRIVATE)),
        F.when(~literal & ~F.coalesce(F.col("all_public"), F.lit(True)), F.lit(E_PRIVATE)),
    )
    return j.select(
        *[c for c in frontier.columns],
        "url", "host", err.alias("error_code"), F.when(err.isNull(), F.col("url")).alias("valid_url"),
    )


def split_frontier(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted / rejected halves of a validated frontier."""
    return validated.where(F.col("error_code").isNull()), validated.where(F.col("error_code").isNotNull())


def client_ip(cols: list[str]) -> Column:
    """First non-empty field whose (first comma-separated) value is a valid IP, else 0.0.0.0."""
    cands = []
    for c in cols:
        v = F.col(c)
        val = first_forwarded(v)
        cands.append(F.when(~php_empty(v) & is_ip(val), val))
    return F.coalesce(*cands, F.lit("0.0.0.0"))


# ------------------------------------------------------------------ redirects


def redirect_target(base_url: Column, location: Column) -> Column:
    """Absolute URL of a Location header relative to the current URL.

    Absolute (http/https) kept; ``//x`` gets the scheme; ``/x`` the scheme and
    host; otherwise the directory of the current path.  The port is dropped and
    dot segments are not resolved, as in the reference.
    """
    loc = php_trim(location)
    scheme = F.when(url_scheme(base_url) == "", F.lit("https")).otherwise(url_scheme(base_url))
    host = url_host(base_url)
    path = F.when(url_path(base_url) == "", F.lit("/")).otherwise(url_path(base_url))
    directory = F.regexp_replace(path, r"/[^/]*$", "/")
    return (
        F.when(loc.rlike(r"(?i)^https?://"), loc)
        .when(loc.startswith("//"), F.concat(scheme, F.lit(":"), loc))
        .when(loc.startswith("/"), F.concat(scheme, F.lit("://"), host, loc))
        .otherwise(F.concat(scheme, F.lit("://"), host, directory, loc))
    )


def _validated(rows: DataFrame, raw_col: str, dns_facts: DataFrame, row_id: list[str]) -> DataFrame:
    """U11 on ``raw_col``: adds ``_err`` and ``_url`` (null where the URL is rejected)."""
    j = lookup_join(normalize_frontier(rows, raw_col), dns_facts, ["host"], row_id)
    literal = is_ip(F.col("host"))
    err = F.coalesce(
        F.col("syntax_error"),
        F.when(~literal & ~F.coalesce(F.col("resolves"), F.lit(False)), F.lit(E_DNS)),
        F.when(literal & ~is_public_ip(F.col("host")), F.lit(E_PRIVATE)),
        F.when(~literal & ~F.coalesce(F.col("all_public"), F.lit(True)), F.lit(E_PRIVATE)),
    )
    staged = j.select(*rows.columns, "url", err.alias("_err"))
    return staged.select(*rows.columns, "_err", F.when(F.col("_err").isNull(), F.col("url")).alias("_url"))


def redirect_edges(redirects: DataFrame, dns_facts: DataFrame) -> DataFrame:
    """Each captured hop once: ``url -> next_url`` or ``next_error``, ready to be followed.

    The target is resolved and validated here, so following a chain needs neither
    DNS nor URL rules.  Repeated captures are reduced to one.
    """
    hops = redirects.where(F.col("status").between(300, 399)).select("url", "location", *[c for c in redirects.columns if c == "fetched_at"])
    one = one_per_key(hops, ["url"]).select(F.col("url").alias("_hop"), "location")
    ends = F.coalesce(F.col("location"), F.lit("")).isin("", "0")
    target = one.withColumn("_target", F.when(~ends, redirect_target(F.col("_hop"), F.col("location"))))
    ok = _validated(target, "_target", dns_facts, ["_hop"])
    return ok.select(
        "_hop",
        F.when(F.col("_target").isNull(), F.lit(TOO_MANY_REDIRECTS)).otherwise(F.col("_err")).alias("_next_error"),
        F.when(F.col("_target").isNotNull(), F.col("_url")).alias("_next_url"),
        F.col("_target").isNotNull().alias("_moves"),
    )


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Follow ``first`` and, from where it has not ended, ``second``."""
    nxt = second.select(
        F.col("_hop").alias("_at"), F.col("_to").alias("_to2"), F.col("_err").alias("_err2"), F.col("_moved").alias("_moved2"), F.col("_done").alias("_done2")
    )
    # what has ended keeps a key of its own that no URL equals
    at = F.when(F.col("_done"), F.concat(F.lit("\n"), F.col("_hop"))).otherwise(F.col("_to"))
    j = first.withColumn("_at", at).join(nxt, "_at", "left")
    on = F.col("_done2").isNotNull()
    return j.select(
        "_hop",
        F.when(on, F.col("_to2")).otherwise(F.col("_to")).alias("_to"),
        F.when(on, F.col("_err2")).otherwise(F.col("_err")).alias("_err"),
        (F.col("_moved") + F.coalesce("_moved2", F.lit(0))).alias("_moved"),
        F.coalesce("_done2", F.lit(True)).alias("_done"),  # a URL without a captured redirect is final
    )


def redirect_paths(edges: DataFrame) -> DataFrame:
    """Where ``MAX_REQUESTS`` requests lead from every URL that redirects:
    ``_hop, _to, _err, _moved``.

    The edge table is composed with itself (1, 2, 4 hops, then the last ones), with
    the number of moves carried, so only edges take part in these joins."""
    one = edges.select(
        "_hop", F.col("_next_url").alias("_to"), F.col("_next_error").alias("_err"), F.col("_moves").cast("int").alias("_moved"),
        F.col("_next_error").isNotNull().alias("_done"),
    )
    power, reach, left = one, None, MAX_REQUESTS - 1
    while left:
        if left & 1:
            reach = power if reach is None else _then(reach, power)
        left >>= 1
        if left:
            power = _then(power, power)
    # a further redirect is one too many
    last = one.select("_hop", F.lit(None).cast("string").alias("_to"), F.lit(TOO_MANY_REDIRECTS).alias("_err"), "_moved", F.lit(True).alias("_done"))
    return _then(reach, last).drop("_done")


def resolve_redirects(
    starts: DataFrame, redirects: DataFrame, dns: DataFrame, url_col: str = "submitted_url", row_id: str = "request_id"
) -> DataFrame:
    """Follow captured redirects for at most six requests.

    Every URL is validated once: the submitted ones and the targets of the captured
    hops (``redirect_edges``, written once).  Chains are followed among the edges by
    path doubling (``redirect_paths``); the submitted URLs look up where their chain
    ends.  A 3xx without a Location, or on the sixth request, fails with "Too many
    redirects."; a URL without a captured redirect is final.
    """
    dns_facts = dns_by_host(dns)
    edges = written(redirect_edges(redirects, dns_facts), "redirect-edges")
    paths = redirect_paths(edges)
    first = _validated(starts.select(F.col(row_id), F.col(url_col).alias("submitted_url")), "submitted_url", dns_facts, [row_id])
    # a refused URL keeps a key of its own
    asked = first.select(row_id, "submitted_url", F.col("_err").alias("_refused"), F.coalesce("_url", F.concat(F.lit("\n"), F.col(row_id).cast("string"))).alias("_hop"), "_url")
    j = lookup_join(asked, paths, ["_hop"], [row_id])
    error = F.coalesce("_refused", "_err")
    return j.select(
        row_id, "submitted_url", F.when(error.isNull(), F.coalesce("_to", "_url")).alias("final_url"), error.alias("error"),
        F.coalesce("_moved", F.lit(0)).cast("bigint").alias("redirects"),
    )
