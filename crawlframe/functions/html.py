"""Titles and links of HTML pages, by regular expressions over the whole text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from .binding import let
from .urls import resolve_all

# Elements whose content is text to a browser: tags in there are not tags.
_RAW_TEXT = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp"
# One that is not closed before the page ends takes the rest with it, as does a comment; so every pattern here goes on
# where its last match ended, and none looks at the rest of the page again and again.
_RAW_OR_COMMENT = (rf"(?is)<(?:!--.*?(?:-->|\z)|(?:{_RAW_TEXT})\b[^>]*+\z"
                   rf"|({_RAW_TEXT})\b([^>]*+)>.*?(?:</\1\s*>|\z))")
# Walks from the start of the page to the first title outside comments and raw text.
_TITLE = (r"(?is)^(?:[^<]++|<!--.*?(?:-->|\z)|<(script|style|textarea)\b[^>]*+(?:>.*?(?:</\1\s*>|\z)|\z)"
          r"|<(?!title\b))*+<title\b[^>]*+>(.*?)(?:</title|\z)")
# An attribute: a quote opens a value only behind "=", and elsewhere is part of a name. A value that is not closed goes
# on to the end of the page.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)?+"""
# A tag, its first group, or the rest of the page from one that is never closed. Possessive, so long tags cannot exhaust
# the stack.
_TAG = rf"(<[A-Za-z][^\s/>]*+(?:[\s/]++|{_ATTRIBUTE})*+>)|(?s:<[A-Za-z].*+)"
_ATTRIBUTE_VALUE = r"""(?s)^[^\s=]+\s*=\s*(?:"(.*)"|'(.*)'|(.*))$"""

# Names that are references without a semicolon too, longest first. In text the longest such name at the place is
# decoded; in an attribute only a whole name with neither "=" nor a letter or digit behind it.
_LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NUMERIC_OR_NAMED = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*+;"
_TEXT_TOKEN = rf"{_NUMERIC_OR_NAMED}|&(?:{_LEGACY})|[^&]+|&"
_ATTRIBUTE_TOKEN = rf"{_NUMERIC_OR_NAMED}|&(?:{_LEGACY})(?![A-Za-z0-9=])|[^&]+|&"
# References seen so often that they are not looked up.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}


# Named character references from the standard library, and what the code points 128-159 mean in
# numeric references, as lines "name=text". One string literal is cheaper to plan with than a map
# literal, and a lookup is only made for references that occur.
_NAMED = "".join(f"\n{name}={chars}" for name, chars in html5.items() if "\n" not in chars) + "\n"
_WINDOWS_1252 = "".join(
    f"\n{code}={bytes([code]).decode('cp1252')}" for code in range(128, 160)
    if bytes([code]).decode("cp1252", errors="ignore")) + "\n"


def _look_up(table: str, name: Column) -> Column:
    """Text of a name in a table of lines, '' if it is not there."""
    pattern = F.concat(F.lit("\n"), name, F.lit("=([^\n]+)"))
    return F.call_function("regexp_extract", F.lit(table), pattern, F.lit(1))


def _code_point(code: Column) -> Column:
    invalid = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(invalid, "�") \
            .when(code.between(128, 159), F.coalesce(
                F.nullif(_look_up(_WINDOWS_1252, code.cast("string")), F.lit("")), utf32)) \
            .otherwise(utf32)


def _decode_token(token: Column) -> Column:
    digits = F.regexp_extract(token, "^&#([0-9]+)", 1)
    hex_digits = F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+)", 1)
    code = F.when(digits != "", digits.try_cast("bigint")) \
            .otherwise(F.conv(hex_digits, 16, 10).try_cast("bigint"))
    named = F.coalesce(F.nullif(_look_up(_NAMED, F.substring(token, 2, 1 << 30)), F.lit("")), token)
    decoded = F.when(~F.startswith(token, F.lit("&")) | (token == "&"), token)
    for reference, chars in _COMMON.items():
        decoded = decoded.when(token == reference, chars)
    return decoded.when(F.startswith(token, F.lit("&#")), _code_point(code)).otherwise(named)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Replace character references in one pass, so that decoded text is not decoded again.

    In an attribute ``&copy=2`` stays as it is, as in every query string; in text ``&copy2`` is a sign and a digit.
    Text whose only references are ``&amp;`` takes a plain replacement.
    """
    tokens = F.regexp_extract_all(text, F.lit(_ATTRIBUTE_TOKEN if attribute else _TEXT_TOKEN), F.lit(0))
    return F.when(~F.contains(text, F.lit("&")), text) \
            .when(~F.rlike(text, F.lit("&(?!amp;)")), F.replace(text, F.lit("&amp;"), F.lit("&"))) \
            .otherwise(F.array_join(F.transform(tokens, _decode_token), ""))


def extract_title(html: Column) -> Column:
    """Text of the first title element, decoded and trimmed; '' without one."""
    inner = decode_entities(F.regexp_extract(html, _TITLE, 2))
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name, not decoded, NULL if the tag has none."""
    attributes = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]++|>$", ""), F.lit(_ATTRIBUTE), F.lit(0))
    named = F.filter(attributes, lambda a: F.rlike(a, F.lit(rf"(?i)^{name}(\s*=|$)")))
    return let(F.try_element_at(named, F.lit(1)), lambda a: F.concat(*[
        F.regexp_extract(a, _ATTRIBUTE_VALUE, i) for i in (1, 2, 3)]))


def _references(tags: Column) -> Column:
    anchors = F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<a[\s/]")) &
                       F.rlike(t, F.lit(r"(?i)\bhref\b")))
    sources = F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)\bsrc\b")))
    found = F.concat(F.transform(anchors, lambda t: _attribute(t, "href")),
                     F.transform(sources, lambda t: _attribute(t, "src")))
    return F.transform(F.filter(found, lambda r: r.isNotNull()), lambda r: decode_entities(r, attribute=True))


def raw_references(html: Column) -> Column:
    """``a[href]`` values in document order, then all ``[src]`` values, unresolved; in time near the page's length.

    A tag that the page ends in is dropped with all that it swallows, as a parser does.
    """
    live = F.regexp_replace(html, _RAW_OR_COMMENT, "<$1$2>")
    return let(F.regexp_extract_all(live, F.lit(_TAG), F.lit(1)), _references)


def extract_links(html: Column, base_url: Column) -> Column:
    """Absolute http(s) links of a page, distinct, in order of first appearance."""
    return resolve_all(base_url, raw_references(html))
