"""URL parsing as regex column expressions.

``parse_url``/``try_parse_url`` follow java.net.URI and return NULL for hosts
with ``_`` or URLs with a space, unlike PHP's ``parse_url``; a single RFC 3986
style regex gives PHP-like pieces and runs identically in RE2 (the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import col_

# groups: 1 scheme, 2 userinfo, 3 host, 4 port, 5 path, 6 query, 7 fragment
URL_RE = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
# presence of an authority ("//") part
HAS_AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"


def url_part(c, group: int) -> Column:
    return F.regexp_extract(col_(c), URL_RE, group)


def url_scheme(c) -> Column:
    return url_part(c, 1)


def url_userinfo(c) -> Column:
    return url_part(c, 2)


def url_host(c) -> Column:
    """Host as written ('' when the URL has no authority)."""
    c = col_(c)
    return F.when(c.rlike(HAS_AUTHORITY_RE), url_part(c, 3)).otherwise(F.lit(""))


def url_port(c) -> Column:
    return url_part(c, 4)


def url_path(c) -> Column:
    return url_part(c, 5)


def site_base(c) -> Column:
    """``scheme://host`` of a URL (port dropped), 'https' when the scheme is missing."""
    c = col_(c)
    scheme = F.when(url_scheme(c) == "", F.lit("https")).otherwise(url_scheme(c))
    return F.concat(scheme, F.lit("://"), url_host(c))


def domain_of(c) -> Column:
    """Host of a URL, else the URL itself (statistics domain)."""
    c = col_(c)
    h = url_host(c)
    return F.when(h != "", h).otherwise(c)


def strip_scheme_and_slash(c) -> Column:
    """JS ``url.replace(/^https?:\\/\\//, '').replace(/\\/$/, '')``."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"^https?://", ""), r"/$", "")
