"""String column functions with PHP/JS semantics, all native Catalyst expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# PHP trim() strips space, tab, newline, carriage return, NUL and
# vertical tab (Spark's trim strips spaces only).
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"

# Named character references of HTML 4, from the standard library's table.
NAMED_REFERENCES = {f"{name};": chr(cp) for name, cp in sorted(name2codepoint.items())} | {"apos;": "'"}

_REFERENCE_TEXT = "\x02".join(f"{name}\x01{char}" for name, char in NAMED_REFERENCES.items())


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def php_trim(c) -> Column:
    """PHP ``trim``."""
    return F.btrim(col_(c), F.lit(PHP_TRIM_CHARS))


def php_empty(c) -> Column:
    """PHP ``empty`` for a string: null, '' or '0'."""
    c = col_(c)
    return c.isNull() | (c == "") | (c == "0")


def _code_point(n: Column) -> Column:
    """The character of a code point, null where there is none."""
    ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n)), 8, "0")), "UTF-32"))


def unescape_entities(c) -> Column:
    """Character references decoded once, left to right: ``&#8211;``, ``&#x2013;`` and
    the named ones of HTML 4 (which need their semicolon).  Anything else stays."""
    c = col_(c)
    named = F.str_to_map(F.lit(_REFERENCE_TEXT), F.lit("\x02"), F.lit("\x01"))  # folded to one literal

    def piece(s: Column) -> Column:
        ref = F.regexp_extract(s, r"^(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;)", 0)
        digits = F.regexp_extract(ref, r"^#([0-9]+)", 1)
        hexits = F.regexp_extract(ref, r"^#[xX]([0-9a-fA-F]+)", 1)
        char = (
            F.when(digits != "", _code_point(digits.try_cast("bigint")))
            .when(hexits != "", _code_point(F.conv(hexits, 16, 10).try_cast("bigint")))
            .when(ref != "", F.try_element_at(named, ref))
        )
        return F.coalesce(F.concat(char, F.substring(s, F.length(ref) + 1, F.length(s))), F.concat(F.lit("&"), s))

    parts = F.split(c, "&", -1)
    decoded = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_tags(c) -> Column:
    """Markup removed, text kept (PHP ``strip_tags``): a ``<`` before white space is text,
    and a tag that never ends reaches to the end."""
    return F.regexp_replace(col_(c), r"<(?!\s)[^>]*+(?:>|\z)", "")


def dom_text(c) -> Column:
    """Markup removed as a parser would: only ``<`` before a letter, ``/``, ``!`` or ``?`` opens some."""
    return F.regexp_replace(col_(c), r"<[a-zA-Z/!?][^>]*+(?:>|\z)", "")


def text_content(c) -> Column:
    """textContent of an element's inner HTML: tags removed, entities decoded, PHP-trimmed."""
    return php_trim(unescape_entities(dom_text(c)))


def _without_elements(c: Column, name: str) -> Column:
    """Whole elements removed; what has no closing tag after it stays, and isn't searched."""
    closed = F.regexp_extract(c, rf"(?is)^(.*</{name}\s*+>)", 1)
    kept = F.regexp_replace(closed, rf"(?is)<{name}\b[^>]*+>.*?</{name}\s*+>", "")
    return F.concat(kept, F.substring(c, F.length(closed) + 1, F.length(c)))


def wp_strip_all_tags(c) -> Column:
    """WordPress ``wp_strip_all_tags``: script/style elements dropped, tags removed, trimmed."""
    return php_trim(strip_tags(_without_elements(_without_elements(col_(c), "script"), "style")))


def cp_length(c) -> Column:
    """Length in code points (``mb_strlen``), as bigint."""
    return F.char_length(col_(c)).cast("bigint")


def byte_length(c) -> Column:
    """Length in bytes (``strlen``), as bigint."""
    return F.octet_length(col_(c)).cast("bigint")


def js_round(c) -> Column:
    """JS ``Math.round`` for non-negative doubles: floor(x + 0.5)."""
    return F.floor(col_(c) + F.lit(0.5)).cast("bigint")


def truncate_bytes(c, cap: int) -> Column:
    """At most ``cap`` UTF-8 bytes, cut between characters."""
    c = col_(c)
    raw = F.encode(c, "UTF-8")

    def inside(at: int) -> Column:  # whether byte ``at`` (from 1) continues a character
        return F.hex(F.substring(raw, at, 1)).rlike("^[89AB]")

    cut = F.lit(cap)
    for k in range(1, 4):
        whole = [inside(cap + 1 - j) for j in range(k)]
        all_inside = whole[0]
        for w in whole[1:]:
            all_inside = all_inside & w
        cut = F.when(all_inside, F.lit(cap - k)).otherwise(cut)
    return F.when(F.octet_length(c) <= cap, c).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))
