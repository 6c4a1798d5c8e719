"""HTML character references as expressions: the whole standard table, without Python in the plan.

A text is split into alternating pieces and references; each reference is resolved by itself.
Named references are looked up by their first letter and then by name, so a lookup compares
with some dozens of names instead of all of them. A name without its semicolon is resolved
as far as one of the names that allow it reaches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference: decimal, hexadecimal, or a name of at most 32 characters.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

UNKNOWN = "�"
LAST_POINT = 0x10FFFF
#: Names that stand without a semicolon, and the longest of them.
OPEN_NAMES = sorted(name for name in html5 if not name.endswith(";"))
LONGEST_OPEN = max(map(len, OPEN_NAMES))

#: Numbers 0x80 to 0x9f mean what the old Windows code page has there, else themselves.
CONTROLS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]
#: Ranges of numbers that mean nothing; besides, the last two of every plane.
NOTHING = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _table(names: tuple[str, ...]) -> str:
    by_first: dict[str, list[str]] = defaultdict(list)
    for name in names:
        by_first[name[0]] += [_quoted(name), _quoted(html5[name])]
    return "map(" + ", ".join(f"{_quoted(c)}, map({', '.join(pairs)})" for c, pairs in by_first.items()) + ")"


def _lookup(names: Iterable[str], name: Column) -> Column:
    return F.element_at(F.element_at(F.expr(_table(tuple(names))), F.left(name, F.lit(1))), name)


def _character(n: Column) -> Column:
    nothing = (n % 0x10000).isin(0xFFFE, 0xFFFF)
    for low, high in NOTHING:
        nothing = nothing | n.between(low, high)
    return (
        F.when((n == 0) | (n > LAST_POINT) | n.between(0xD800, 0xDFFF), F.lit(UNKNOWN))
        .when(n.between(0x80, 0x9F), F.get(F.array(*map(F.lit, CONTROLS)), (n - 0x80).cast("int")))
        .when(nothing, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _number(digits: Column, base: int) -> Column:
    """The number, or one beyond the last code point where there are too many digits."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(short == "", F.lit(0)).when(F.length(short) > 8, F.lit(LAST_POINT + 1)).otherwise(F.conv(short, base, 10)).cast("bigint")


def _resolved(reference: Column) -> Column:
    name = F.substr(reference, F.lit(2))
    digits = F.rtrim(name, F.lit(";"))
    numeric = F.when(
        F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x", _character(_number(F.substr(digits, F.lit(3)), 16))
    ).otherwise(_character(_number(F.substr(digits, F.lit(2)), 10)))
    named = [_lookup(html5, name)]
    for n in range(LONGEST_OPEN, 1, -1):
        longer = F.concat(_lookup(OPEN_NAMES, F.left(name, F.lit(n))), F.substr(name, F.lit(n + 1)))
        named.append(F.when(F.length(name) > n, longer))
    return F.when(name.startswith("#"), numeric).otherwise(F.coalesce(*named, reference))


def unescape(text: Column) -> Column:
    """The text with all character references resolved, as a browser resolves them."""
    pieces = F.split(text, REFERENCE, -1)
    references = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _resolved)
    joined = F.zip_with(pieces, references, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text)
