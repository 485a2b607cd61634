"""Character references of HTML as expressions: every number, and every name of the standard."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from kireme.functions.arrays import let

REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
CLOSED = r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]{0,30};)"
LONGEST = 33


@cache
def _windows() -> dict[str, str]:
    """Numbers from 128 to 159 mean the characters of the Windows code page where it has one."""
    named = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    return {str(n): c if c != "�" else chr(n) for n, c in named.items()}


def _constant(table: dict[str, str]) -> Column:
    """A map that is made once, when the plan is."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def character(cp: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 8, "0")), "UTF-32")


def _numeric(cp: Column) -> Column:
    gone = cp.between(1, 8) | (cp == 11) | cp.between(14, 31) | (cp == 127) | cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(cp.isNull() | (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF), F.lit("�"))
        .when(cp.between(0x80, 0x9F), F.element_at(_constant(_windows()), cp.cast("string"))).when(gone, F.lit("")).otherwise(character(cp))
    )


def _named(name: Column) -> Column:
    """The whole name, or the longest beginning that is a name without a semicolon; others stay as they are."""
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    longest = max(map(len, old))
    whole = F.element_at(_constant(html5), name)
    known = lambda n: F.map_contains_key(_constant(old), F.substring(name, 1, n))
    sizes = F.filter(F.sequence(F.least(F.char_length(name), F.lit(longest)), F.lit(1), F.lit(-1)), lambda n: (n > 1) & known(n))
    begun = let(F.get(sizes, F.lit(0)), lambda n: F.concat(F.element_at(_constant(old), F.substring(name, 1, n)), F.substring(name, n + 1, F.char_length(name))))
    return F.coalesce(whole, begun, F.concat(F.lit("&"), name))


def _decoded(ref: Column, closed: bool = False) -> Column:
    """A reference without its ampersand; ``closed`` knows whole names only."""
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
    # more digits than a code point has are beyond the last one
    cp = F.when(F.char_length(digits) > 9, F.lit(0x110000)).otherwise(number.cast("long"))
    return F.when(ref.startswith("#"), let(cp, _numeric)).otherwise(F.coalesce(F.element_at(_constant(html5), ref), F.concat(F.lit("&"), ref)) if closed else _named(ref))


def unescape_references(text: Column, closed: bool = False) -> Column:
    """A text with its character references decoded; null for null. Ampersands that begin none stay.

    ``closed`` leaves those without a semicolon as they are, as also names that only begin with a known one.
    """
    pattern = CLOSED if closed else REFERENCE
    refs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    parts = F.split(text, pattern, -1)
    joined = F.zip_with(parts, F.transform(refs, lambda r: _decoded(r, closed)), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)
