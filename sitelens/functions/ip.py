"""IP literal predicates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import col_, php_trim

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# IPv4 ranges treated as non-public (private + reserved):
# 0.0.0.0/8, 10.0.0.0/8, 127.0.0.0/8, 169.254.0.0/16, 172.16.0.0/12,
# 192.168.0.0/16, 240.0.0.0/4.
# IPv6 prefixes treated as non-public: "::", "::1", fc00::/7, fe80::/10,
# "::ffff:" mapped addresses, 2001:db8::/32.


def is_ipv4(c) -> Column:
    return col_(c).rlike(IPV4_RE)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value bound once, so that nested uses do not multiply
    the expression (a host is itself a long expression)."""
    return F.get(F.transform(F.array(value), use), 0)


def _pair(octets: Column, i: int) -> Column:
    n = F.get(octets, i).try_cast("int") * 256 + F.get(octets, i + 1).try_cast("int")
    return F.lower(F.lpad(F.hex(n), 4, "0"))


def _groups(half: Column) -> Column:
    return F.filter(F.split(half, ":", -1), lambda g: half != "")


def _hex_digits(sides: Column) -> Column:
    """32 digits from the two sides of ``::`` (one side: no ``::``), else null."""
    given = F.size(F.flatten(sides))
    ok = F.forall(F.flatten(sides), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(sides) == 2, given <= 7).otherwise(
        (F.size(sides) == 1) & (given == 8)
    )
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
    groups = F.concat(F.get(sides, 0), zeros, F.coalesce(F.get(sides, 1), F.array().cast("array<string>")))
    return F.when(ok, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def expand_ipv6(c) -> Column:
    """All 32 hexadecimal digits of an IPv6 literal, null if it is not one.

    ``::`` stands for one or more groups of zeros and may occur once; the last two
    groups may be written as an IPv4 address; no zone index.
    """

    def undotted(x: Column) -> Column:
        # a dotted tail becomes two groups; a malformed one keeps its dots, which no group allows
        tail = F.substring_index(x, ":", -1)
        two = _let(F.split(tail, r"\."), lambda o: F.concat(_pair(o, 0), F.lit(":"), _pair(o, 2)))
        return F.when(tail.rlike(IPV4_RE), F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(tail)), two)).otherwise(x)

    digits = lambda x: _let(F.transform(F.split(undotted(x), "::", -1), _groups), _hex_digits)
    return _let(F.lower(col_(c)), lambda x: F.when(x.contains(":"), digits(x)))


def is_ipv6(c) -> Column:
    return expand_ipv6(c).isNotNull()


def is_ip(c) -> Column:
    """FILTER_VALIDATE_IP."""
    return is_ipv4(c) | is_ipv6(c)


def _octet(c: Column, i: int) -> Column:
    # evaluated for every row by common-subexpression elimination, so it must not raise
    return F.get(F.split(c, r"\."), i).try_cast("int")


def is_public_ipv4(c) -> Column:
    def public(x: Column) -> Column:
        a, b = _octet(x, 0), _octet(x, 1)
        private = (
            (a == 0)
            | (a == 10)
            | (a == 127)
            | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | (a >= 240)
        )
        return is_ipv4(x) & ~F.coalesce(private, F.lit(False))

    return _let(col_(c), public)


def is_public_ipv6(c) -> Column:
    return _let(
        expand_ipv6(c),
        lambda full: full.isNotNull()
        & ~F.coalesce(full.rlike("^(?:0{31}[01]$|f[cd]|fe[89ab]|0{20}ffff|20010db8)"), F.lit(False)),
    )


def is_public_ip(c) -> Column:
    return is_public_ipv4(c) | is_public_ipv6(c)


def first_forwarded(c) -> Column:
    """First entry of a comma list, trimmed (X-Forwarded-For)."""
    c = col_(c)
    return F.when(c.contains(","), php_trim(F.split(c, ",").getItem(0))).otherwise(c)
